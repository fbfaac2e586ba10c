"""URL filtering by association rules.

Transactions are the tokens of labelled urls plus the label; Spark's FP-growth mines the frequent
combinations. Tokens that the same labelled urls have - the parts of one path, say - are one item: all
combinations of them have the same support and confidence, and n of them would make 2^n combinations. Rules "items -> label"
are pruned by support and confidence. Every rule is posted in an inverted index under its rarest item only; a url meets the
postings of its items and a rule fits if the url has the rest of it as well. The most confident fitting rule decides. All
DataFrame code.

What is broadcast is bounded by the mining: an item is in at least ``min_support`` of the labelled urls, so there are at most
(tokens of a url) / ``min_support`` of them; postings are broadcast if they are ``MOST_POSTINGS`` or fewer, else shuffled.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import HOT, durable, join_hot

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.9
LABEL = "label="
#: Rules and items that are broadcast.
MOST_POSTINGS = 20_000


def split_url(url: Column) -> tuple[Column, Column, Column, Column]:
    """(scheme, host, path, query and fragment); all empty if the url is null or has no ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    more = F.regexp_extract(rest, "^[^?#]*(?s)(.*)$", 1)
    return F.when(at > 0, F.substring(u, F.lit(1), at - 1)).otherwise(F.lit("")), host, path, more


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule ``(verdict, "host/path")`` that fits; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """A url's distinct tokens: scheme, host labels, path parts, names in the query."""
    scheme, host, path, more = split_url(url)
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.transform(F.split(more, "[?&#]"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    return F.array_distinct(F.concat(named("s:", F.array(F.lower(scheme))), named("h:", F.split(host, "\\.")), named("p:", F.split(F.lower(path), "[/.]")), named("q:", query)))


def alike(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """``(token, item, freq)`` for the tokens of at least ``min_support`` of a stored table's rows (``_at`` a number of the row, ``tokens``):
    tokens that exactly the same rows have are one item, named by the first of them."""
    least = max(1, math.ceil(min_support * labelled.count() - 1e-9))
    each = labelled.select("_at", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("freq"), F.bit_xor(F.xxhash64("_at")).alias("a"), F.bit_xor(F.xxhash64("_at", F.lit(1))).alias("b"))
    often = durable(seen.where(F.col("freq") >= least), "tokens")
    return often.join(often.groupBy("freq", "a", "b").agg(F.min("token").alias("item")), ["freq", "a", "b"]).select("token", "item", "freq")


def as_items(urls: DataFrame, items: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(_at, item)``: the distinct items of rows."""
    each = urls.select("_at", F.explode(tokens).alias("token"))
    return each.join(_small(items.select("token", "item")), "token").select("_at", "item").distinct()


def _small(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST_POSTINGS else df


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules from ``(tokens array<string>, label string)``: ``rule_id, items, label, confidence, support, rarest``; and the items,
    see :func:`alike`. Both are stored tables.

    Rows with a null label or no tokens are left out. Without labelled rows there are no rules.
    ``rarest`` is the rule's item that the fewest labelled rows have (of equals, the first by name).
    """
    found = labelled.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).select(F.array_distinct("tokens").alias("tokens"), "label", F.monotonically_increasing_id().alias("_at"))
    rows = durable(found, "labelled")
    items = durable(alike(rows, min_support), "items")
    sets = as_items(rows, items).groupBy("_at").agg(F.collect_set("item").alias("items"))
    # rows without a frequent token count in the supports
    baskets = rows.select("_at", "label").join(sets, "_at", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(durable(baskets, "baskets"))
    rules = model.associationRules.select(F.sort_array("antecedent").alias("items"), F.element_at("consequent", 1).alias("says"), "confidence", "support")
    rules = rules.where(F.col("says").startswith(LABEL) & ~F.exists("items", lambda x: x.startswith(LABEL)))
    rules = durable(rules.select(F.sha2(F.array_join("items", "\n"), 256).alias("rule_id"), "items", F.substring("says", len(LABEL) + 1, 1 << 20).alias("label"), "confidence", "support"), "rules")
    rarest = rules.select("rule_id", F.explode("items").alias("item")).join(items.where("token = item"), "item").groupBy("rule_id").agg(F.min(F.struct("freq", "item"))["item"].alias("rarest"))
    return durable(rules.join(rarest, "rule_id"), "rules"), items


def match_rules(urls: DataFrame, rules: DataFrame, items: DataFrame, url: str = "url") -> DataFrame:
    """``url, label, rule_items, confidence`` for each url that a rule fits; ``urls`` has each once, ``rules`` and ``items`` are
    as :func:`mine_rules` gives them.

    Of several fitting rules the one with the highest confidence, then support, then the most items,
    then the first by name decides.
    """
    rows = urls.select(F.col(url).alias("_at"), url_tokens(F.col(url)).alias("tokens"))
    has = as_items(rows, items).groupBy("_at").agg(F.collect_set("item").alias("has"))
    postings = _small(rules.select(F.col("rarest").alias("item"), "rule_id", "items", "label", "confidence", "support"))
    met = has.withColumn("item", F.explode("has")).join(postings, "item").where(F.size(F.array_except("items", "has")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("items").alias("n"), "rule_id", "label", "items"))
    return met.groupBy("_at").agg(best.alias("b")).select(F.col("_at").alias("url"), F.col("b.label").alias("label"), F.col("b.items").alias("rule_items"), F.col("b.confidence").alias("confidence"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row for each row of ``pages``: the columns ``keep``, ``host, path, rule, verdict, confidence``.

    Fixed rules decide first. The urls they decide are the labelled ones that association rules are
    mined from, and those decide the rest; a url that none fits gets ``default``. Null urls and urls
    without ``://`` have an empty host and path and no tokens, and get ``default``. Repeated urls get the same verdict.
    """
    _, host, path, _ = split_url(F.col(url))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(*keep, F.coalesce(F.col(url), F.lit("")).alias("_url"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("_fixed", verdict)
    mined, items = mine_rules(judged.where("_fixed IS NOT NULL").select(url_tokens(F.col("_url")).alias("tokens"), F.col("_fixed").alias("label")), min_support, min_confidence)
    # rows that a fixed rule or nothing can decide take no part in the join; a url may be that of a third of all rows
    open_ = F.col("_fixed").isNull() & F.contains(F.col("_url"), F.lit("://"))
    urls = durable(judged.where(open_).groupBy("_url").agg(F.count("*").alias("n")), "urls")
    fits = match_rules(urls, mined, items, "_url").select(F.col("url").alias("_url"), "label", "confidence")
    total = urls.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # urls that no rule fits are left out, but for hot ones: their rows stay where they are as well
    fits = durable(urls.join(fits, "_url", "left").where(F.col("label").isNotNull() | (F.col("n") * HOT > total)).select("_url", "n", "label", "confidence"), "fits")
    told = join_hot(judged.where(open_), fits, ["_url"], "n", total, "left").select(*judged.columns, "label", "confidence")
    out = told.unionByName(judged.where(~open_).select("*", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence")))
    return out.select(*keep, "host", "path", "rule", F.coalesce("_fixed", "label", F.lit(default)).alias("verdict"), "confidence")
