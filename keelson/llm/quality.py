"""Quality rules: text statistics, and line frequency across the documents of a host.

Everything is DataFrame expressions. One reading of the texts stores the statistics of every row and the hashes of its
normalised lines; repeated windows are found by sorting (window hash, position) pairs inside the row, so a long
text costs n log n and no row is exploded for them. Across documents, the distinct documents of a host that have a line are
counted, lines above the limit are removed from all but the host's first document with them, and a document that loses too
much of its words is rejected. As the first document keeps its lines, no content disappears altogether.

The limit of a host: a line is above it if more than ``LINE_SHARE`` of the host's documents have it, but never with
``LINE_LEAST`` documents or fewer and always with more than ``LINE_MOST``: on a large host, boilerplate needn't be in a large
part of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import SPACES, durable, fresh, join_hot, marked, words_text

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words
SYMBOLS = "#*$%&|<>"
LINE_LEAST, LINE_MOST = 5, 50
LINE_SHARE = 0.05
#: A document is depleted if fewer than this share of its words is left.
MIN_LEFT = 0.5
_NO_ID = -(1 << 63)


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is worked out once (a plain reference would be inlined into lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "")


def repeated_words(ws: Column, window: int = 3) -> Column:
    """Words that lie in a window of ``window`` words that the text has at least twice."""

    def of(w):
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + d) for d in range(window)]))

        def count(h):
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def positions(p):
                same = lambda a, b: (b >= 1) & (b <= F.size(p)) & (F.get(p, a)["h"] == F.get(p, b - 1)["h"])
                return F.sort_array(F.transform(F.filter(F.transform(p, lambda x, j: F.struct(x["i"].alias("i"), (same(j, j) | same(j, j + 2)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))

            def covered(at):
                steps = F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window))))
                return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(pairs, lambda p: _let(positions(p), covered)))

        return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(_let(hashes, count))

    return _let(ws, of)


def statistics(text: Column) -> list[Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text; null counts as empty."""
    t = words_text(text)
    has_word = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\n\u000b\f\r", "") != "")
    return [
        F.size(words(t)).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(has_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words(t)).alias("n_repeat_words"),
    ]


def _key(docs: DataFrame, text: str, doc_id: str, host: str) -> list[Column]:
    """``doc_id, _host, _row`` of a row; ``_row`` is a hash of the text."""
    return [F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.xxhash64(words_text(text)).alias("_row")]


def normalised_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), f"{SPACES}+", " "))


def _lines(text: Column) -> Column:
    """(hash, words) of the lines of a text that have a word, normalised."""
    normal = F.filter(F.transform(F.split(text, "\n"), normalised_line), lambda x: x != "")
    return F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).cast("long").alias("in_line")))


def _judged(docs: DataFrame, text: str, doc_id: str, host: str, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, line_least: int = LINE_LEAST, line_most: int = LINE_MOST, line_share: float = LINE_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """:func:`judge_quality` with the key's ``_host`` and ``_gone``, the hashes of the row's lines above the limits."""
    read = docs.select(*_key(docs, text, doc_id, host), *statistics(F.col(text)), _lines(words_text(text)).alias("lines"), F.monotonically_increasing_id().alias("_at"))
    base = durable(read, "lines")
    # a document is an id, or a text where there is no id; rows of documents that have several are counted apart
    who = base.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("_row")).alias("_null_row"), "_host", F.array_distinct(F.transform("lines", lambda x: x["line"])).alias("each"))
    several = durable(who.groupBy("doc_id", "_null_row").count().where("count > 1").select(F.xxhash64("doc_id", "_null_row").alias("who")), "several")
    told = marked(who, F.xxhash64("doc_id", "_null_row"), several, F.col("who"), "_several")
    least = F.coalesce("doc_id", F.lit(_NO_ID)).alias("least")
    lines = told.select("_host", F.explode("each").alias("line"), least, "_null_row", "_several")
    once = lines.where("NOT _several").groupBy("_host", "line").agg(F.count("*").alias("n"), F.min("least").alias("first"))
    more = lines.where("_several").select("_host", "line", "least", "_null_row").distinct().groupBy("_host", "line").agg(F.count("*").alias("n"), F.min("least").alias("first"))
    often = durable(once.unionByName(more).groupBy("_host", "line").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") > line_least), "often")
    one_host = told.where("NOT _several").groupBy("_host").agg(F.count("*").alias("size"))
    more_host = told.where("_several").select("_host", "doc_id", "_null_row").distinct().groupBy("_host").agg(F.count("*").alias("size"))
    sizes = one_host.unionByName(more_host).groupBy("_host").agg(F.sum("size").alias("size")).where(F.col("size") * line_share < line_most)
    sizes = durable(sizes, "hosts")
    # lines of large hosts never meet on their host: a bitmap of the small ones lets them go first
    rare = marked(often.where(F.col("n") <= line_most), F.xxhash64("_host"), sizes, F.xxhash64("_host"), "_small").where("_small").drop("_small")
    some = rare.join(sizes, "_host").where(F.col("n") > F.col("size") * line_share).select(*often.columns)
    above = durable(often.where(F.col("n") > line_most).unionByName(some), "above")
    # a line of many documents is a hot key; lines that aren't above the limits don't take part
    all_lines = base.select("doc_id", "_host", "_at", F.explode("lines").alias("x")).select("doc_id", "_host", "_at", "x.line", "x.in_line")
    known = marked(all_lines, F.xxhash64("_host", "line"), above, F.xxhash64("_host", "line"), "_known").where("_known").drop("_known")
    removed = join_hot(known, above, ["_host", "line"], "n", above.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).where(F.coalesce("doc_id", F.lit(_NO_ID)) > F.col("first"))
    lost = removed.groupBy("_at").agg(F.sum("in_line").alias("lost"), F.sort_array(F.collect_set("line")).alias("_gone"))
    out = base.drop("lines").join(lost, "_at", "left").withColumn("removed_words", F.coalesce("lost", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_words") * max_repeated < F.col("n_repeat_words") * 100))
    depleted = (F.col("removed_words") > 0) & (F.col("n_words") - F.col("removed_words") < F.col("n_words") * min_left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", (~F.col("base_failed") & ~depleted).alias("kept"), "_row", "_host", "_gone")


def judge_quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", **limits) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, the statistics, ``base_failed``, ``removed_words``
    (words in lines above the limits), ``kept`` and ``_row``, a key of the row's content.

    A null text is empty and fails; a null host is a host of its own. A host's first document with a
    line is the one with the smallest ``doc_id``; null ids come first. Rows of one id are one document when documents are
    counted, and so are rows without an id that have one text; each row is judged by its own text. Line and text identities are 64-bit hashes. Other columns are left out. ``limits``: ``min_words,
    max_repeated, line_least, line_most, line_share, min_left`` for the constants of these names.
    """
    return _judged(docs, text, doc_id, host, **limits).drop("_host", "_gone")


def keep_good(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_quality` keeps, with all their columns; ``text`` is without the lines above
    the limits. Texts without such lines, and all other columns, stay as they are.

    A bitmap of the rows to drop or to rewrite lets the others pass while scanning; only rows that it marks are shuffled.
    """
    mark, d, h, r, bad, gone = fresh(docs.columns, "_marked", "_d", "_h", "_r", "_bad", "_gone")
    judged = _judged(docs, text, doc_id, host, **limits).where("NOT kept OR removed_words > 0")
    told = judged.select(F.col("doc_id").alias(d), F.col("_host").alias(h), F.col("_row").alias(r), (~F.col("kept")).alias(bad), F.when(F.col("kept"), F.col("_gone")).alias(gone))
    told = durable(told.distinct(), "told")
    key = _key(docs, text, doc_id, host)
    rows = marked(docs, F.xxhash64(*key), told, F.xxhash64(d, h, r), mark)
    same = key[0].eqNullSafe(F.col(d)) & (key[1] == F.col(h)) & (key[2] == F.col(r))
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col(gone), F.xxhash64(normalised_line(x)))), "\n")
    doubtful = rows.where(F.col(mark)).select(*docs.columns).join(told, same, "left").where(~F.coalesce(F.col(bad), F.lit(False)))
    doubtful = doubtful.withColumn(text, F.when(F.col(gone).isNotNull(), left).otherwise(F.col(text)))
    return rows.where(~F.col(mark)).select(*docs.columns).unionByName(doubtful.select(*docs.columns))
