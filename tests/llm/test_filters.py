"""Quality rules, url rules, toxicity and language-model scores."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from keelson.llm import hmm, quality, toxicity, url_rules
from keelson.llm.queries import URL_RULES
from pyspark.sql import functions as F

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def base_statistics(text):
    text = text or ""
    w = SPLIT.findall(text)
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    at = {i + d for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at)


def test_quality_statistics(docs, corpus):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge_quality(docs).collect())
    wanted = Counter()
    for d, t, *_ in corpus:
        s = base_statistics(t)
        wanted[(d, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert got == wanted


def test_line_frequency(spark):
    own = lambda i: " ".join(f"u{i}_{k}" for k in range(60))
    nav = " ".join(f"nav{k}" for k in range(10))
    page = "\n".join([nav, " ".join(f"boiler{k}" for k in range(60))])
    rows = [(i, f"{nav.upper()}\n{own(i)}", "a") for i in range(100)]
    rows += [(1000 + i, f"{page}\nx{i}", "a") for i in range(100)]
    rows += [(2000 + i, page, "b") for i in range(100)]  # copies are documents of their own
    rows += [(3000, page, None), (3000, page, None), (None, page, "a")]
    out = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i]["kept"] and out[i]["removed_words"] == (10 if i else 0) or out[i]["removed_words"] == 10 for i in range(100))
    # the page's long line goes from all but the host's first document with it (the row without an id)
    assert [i for i in range(1000, 1100) if out[i]["kept"]] == []
    assert out[None]["kept"] and out[3000]["kept"]
    assert [i for i in range(2000, 2100) if out[i]["kept"]] == [2000]


def test_line_limit_goes_by_the_host_s_size(spark):
    """At most 5 documents on a small host, a twentieth of a larger one, 50 on the largest."""
    own = lambda h, i: " ".join(f"{h}{i}_{k}" for k in range(60))
    rows = []
    for host, size in (("small", 20), ("middle", 400), ("large", 2000)):
        for i in range(size):
            lines = [f"line {n} of all" for n in (5, 6, 20, 21, 50, 51) if i < n]
            rows.append((len(rows), "\n".join([*lines, own(host, i)]), host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality.judge_quality(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("removed_words").alias("n")).collect()
    gone = lambda n: 4 * (n - 1)
    assert {r["source"]: r["n"] for r in out} == {"small": gone(6) + 4 * gone(20), "middle": gone(21) + gone(50) + gone(51), "large": gone(51)}


def test_quality_removes_lines_from_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert quality.judge_quality(docs).where("removed_words > 0").count() > 50


def test_quality_nothing(empty):
    assert quality.judge_quality(empty).count() == 0
    assert quality.keep_good(empty).columns == empty.columns


def test_keep_good_keeps_columns(docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.judge_quality(docs).where("kept").count()


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Net/EN/x", "http://example.net/en/x?q#f", "http://a.example.net/en", "http://a.example.net/de/1", "http://net", "http://net/", "http://x.net?y=/en/", "http://b.org/fr/2", "http://borg/fr/2", "http://b.example.com/de/3#z", "http://b.example.com/de?3", "x://é.net/ü", "http://a://b.net/"]


def rule_of(url):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = "".join(c.lower() if c.isascii() else c for c in re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[len(host) :])[0]
    best = None
    for says, r in URL_RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (says, r)
    return host, path, best


def test_url_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, f"https://h{i % 7}.example.{['com', 'net', 'org'][i % 3]}/{['de', 'en', 'fr'][i % 5 % 3]}/{i}") for i in range(300)]
    out = {r["page_id"]: r for r in url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert len(out) == len(rows)
    for i, u in rows:
        host, path, best = rule_of(u)
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] in ("allow", "block") and (best is None or r["verdict"] == best[0])


def brute_rules(rows, support, confidence):
    """All token combinations by counting."""
    from itertools import combinations

    sets, labels = Counter(), Counter()
    for tokens, label in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                sets[c] += 1
                labels[c, label] += 1
    least = math.ceil(support * len(rows))
    return {(c, lab): n / sets[c] for (c, lab), n in labels.items() if n >= least and n / sets[c] >= confidence}


def test_mined_rules_and_matches(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(200):
        t = sorted({f"t{k}" for k in rng.integers(0, 6, 4)})
        rows.append((t, "block" if "t1" in t and "t2" in t else "allow"))
    frame = spark.createDataFrame(rows, "tokens array<string>, label string")
    found, items = url_rules.mine_rules(frame, 0.02, 0.9)
    wanted = brute_rules(rows, 0.02, 0.9)
    got = {(tuple(r["items"]), r["label"]): r["confidence"] for r in found.collect()}
    assert got == pytest.approx(wanted)
    urls = spark.createDataFrame([("x://a.b/c/d",), ("x://b.a/d",), ("",)], "url string")
    rules = spark.createDataFrame([("1", ["h:a", "p:c"], "block", 1.0, 0.1, "p:c"), ("2", ["h:a"], "allow", 0.95, 0.2, "h:a")], "rule_id string, items array<string>, label string, confidence double, support double, rarest string")
    items = spark.createDataFrame([("h:a", "h:a", 2), ("p:c", "p:c", 1)], "token string, item string, freq long")
    assert {r["url"]: r["label"] for r in url_rules.match_rules(urls, rules, items).collect()} == {"x://a.b/c/d": "block", "x://b.a/d": "allow"}


def test_long_paths_that_recur_are_one_item(spark):
    """30 parts that always occur together: the rules are those of one part, and any of the parts fits them."""
    path = "/".join(f"part{i}" for i in range(30))
    rows = [(["h:a", f"p:own{i}"], "allow") for i in range(390)] + [(["h:a", *[f"p:{x}" for x in path.split("/")]], "block")] * 10
    found, items = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.005, 0.9)
    short = [(["h:a"], "allow")] * 390 + [(["h:a", "p:part0"], "block")] * 10
    assert {(tuple(r["items"]), r["label"]): r["confidence"] for r in found.collect()} == pytest.approx(brute_rules(short, 0.005, 0.9))
    urls = spark.createDataFrame([("x://b/part29",), ("x://a/else",)], "url string")
    assert {r["url"]: r["label"] for r in url_rules.match_rules(urls, found, items).collect()} == {"x://b/part29": "block", "x://a/else": "allow"}


def test_urls_nothing(spark):
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi").limit(2500).cache()
    model = toxicity.fit(docs, labels)
    out = toxicity.score_texts(docs, model).join(labels, "doc_id").withColumn("held", toxicity.held_out("doc_id")).toPandas()
    assert out["score"].between(0, 1).all()
    held = out[out["held"] & out["toxic"].notna()]
    right = ((held["score"] >= 0.5) == (held["toxic"] == 1)).mean()
    assert len(held) > 300 and right > 0.95
    assert ((held["score"] >= 0.5) & (held["toxic"] == 0)).sum() <= 3


def test_toxicity_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_texts(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    assert toxicity.score_texts(empty, toxicity.fit(empty, none)).count() == 0
    some = spark.createDataFrame([(1000, 1), (1000, 0), (1001, 0), (1002, None), (None, 1), (1003, 0)], "doc_id long, toxic int")
    out = toxicity.score_texts(docs, toxicity.fit(docs, some)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return SPLIT.findall(low)


@pytest.mark.parametrize("head", [1, 400_000])
def test_language_model_base(docs, corpus, head):
    counts = Counter()
    for d, t, *_ in corpus:
        if not is_held(d):
            counts.update([*tokens(t), ""])
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((str(d), len(tokens(t)) + 1, sum(counts[w] > 0 for w in [*tokens(t), ""]), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*tokens(t), ""])) for d, t, *_ in corpus)
    got = hmm.score_corpus(docs, head_words=head, steps=1).collect()
    assert {r["train_tokens"] for r in got} == {n}
    rows = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    assert [r[:3] for r in rows] == [r[:3] for r in wanted]
    assert [r[3] for r in rows] == pytest.approx([r[3] for r in wanted])


def test_forward_is_exact_and_scores_rare_words(spark):
    """Scores against a plain sum over all state paths."""
    from itertools import product

    train = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b a a", "c b"] * 3)], "doc_id long, text string")
    lexicon = hmm.token_counts(train).cache()
    classes, totals = hmm.make_classes(lexicon, top_words=2, suffixes=3)
    coded = lambda df: hmm.code(df.withColumn("train", F.lit(True)), lexicon, classes, head_words=1)
    model, _ = hmm.fit(coded(train), hmm.first_model(classes, totals, 2))
    texts = ["a b", "", "c zz a", "b"]
    out = {r["doc_id"]: r["score"] for r in hmm.score(coded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), model, lexicon).collect()}
    counts = {r["word"]: r["n"] for r in lexicon.collect()}
    for i, t in enumerate(texts):
        seq = [*tokens(t), ""]
        sym = [0 if w == "" else model.classes.of(w) for w in seq]
        p = 0.0
        for path in product(range(2), repeat=len(seq)):
            q = model.start[path[0]]
            for k, s in enumerate(path):
                q *= model.emit[s, sym[k]] * (model.move[path[k - 1], s] if k else 1)
            p += q
        for w, s in zip(seq, sym):
            if s > len(model.classes.top):
                p *= (counts.get(w, 0) + 1) / model.classes.denominators[s - 1 - len(model.classes.top)]
        assert out[i] == pytest.approx(math.log10(p))


def test_expected_counts_in_parts():
    """Counts and likelihoods don't depend on how many positions are kept at a time, or on which are scaled."""
    rng = np.random.default_rng(0)
    classes = hmm.Classes({f"w{i}": i + 1 for i in range(6)}, 1, np.ones(1))
    model = hmm.first_model(classes, np.ones(classes.size), 3)
    seqs = [np.concatenate([(np.arange(n) + rng.integers(6)) % 6 + 1, [0]]) for n in [0, 0, *rng.integers(1, 70, 40)]]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    log = 0.0
    for s in seqs:  # plain recursion
        a = model.start * model.emit[:, s[0]]
        for x in s[1:]:
            a = (a @ model.move) * model.emit[:, x]
        log += math.log(a.sum())
    found = []
    for cells in (10**9, 100, 1):
        counts, total = 0.0, 0.0
        for g in hmm.groups(lengths, 500):
            more, part = hmm.expected(model, *hmm.side_by_side(flat, starts, lengths, g), cells)
            counts, total = counts + more, total + part
        assert total == pytest.approx(log)
        assert counts[:3].sum() == pytest.approx(len(seqs)) and counts[3:12].sum() == pytest.approx(lengths.sum() - len(seqs))
        assert np.bincount(flat, minlength=8) == pytest.approx(counts[12:].reshape(3, 8).sum(0))
        found.append(counts)
    assert found[0] == pytest.approx(found[1]) and found[0] == pytest.approx(found[2])


def test_every_baum_welch_step_climbs_and_counts_all(spark):
    """``fit`` itself: the likelihood of the training texts never falls, and every step counts every token once."""
    train = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b", "b a a", "c b", "", "zz a"] * 20)], "doc_id long, text string").repartition(4)
    lexicon = hmm.token_counts(train).cache()
    classes, totals = hmm.make_classes(lexicon, top_words=3, suffixes=2)
    coded = hmm.code(train.withColumn("train", F.lit(True)), lexicon, classes).cache()
    model, logs = hmm.fit(coded, hmm.first_model(classes, totals, 2), steps=8, smoothing=1e-9)
    assert len(logs) == 8 and all(b >= a - 1e-6 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0]
    counts, log = hmm.gather(coded, model)
    assert log >= logs[-1] - 1e-6
    assert counts[2 + 4 :].reshape(2, -1).sum(0) == pytest.approx(totals)
    last = hmm.updated(model, counts)
    assert hmm.fit(coded, model, steps=1)[0].emit == pytest.approx(last.emit)


def test_language_model_nothing(empty):
    assert hmm.score_corpus(empty).count() == 0


def test_drop_toxic_filters_rows(spark, docs, empty):
    some = spark.createDataFrame([(1000 + i, i % 3 == 0) for i in range(60)], "doc_id long, t boolean").select("doc_id", F.col("t").cast("int").alias("toxic"))
    model = toxicity.fit(docs, some)
    kept = toxicity.drop_toxic(docs, some)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.score_texts(docs, model).where("score < 0.5").count()
    assert toxicity.drop_toxic(empty, some.limit(0)).count() == 0


def test_keep_good_removes_lines(spark):
    """Lines above the limits are gone from the kept texts, except in the host's first document with them."""
    own = lambda i: " ".join(f"u{i}_{k}" for k in range(60))
    rows = [(i, f"Nav  bar\n{own(i)}\n\n nav BAR\t\nlast {i}\n", "a", i) for i in range(100)]
    rows += [(5, rows[5][1], "a", 5), (1000, rows[7][1], "b", 0), (1001, f"{own(0)}\n\n{own(1)}", "a", 0), (1002, "nav bar", "a", 0), (1003, None, "a", 0)]
    rows += [(5, rows[5][1], "b", 1)]  # the same id and text on a host where the line is rare
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other long").repartition(3)
    wanted = Counter()
    for d, t, host, other in rows:
        if d in (1002, 1003):
            continue
        if host == "a" and 0 < d < 100:
            t = "\n".join(x for x in t.split("\n") if " ".join(x.lower().split()) != "nav bar")
        wanted[d, t, host, other] += 1
    assert Counter(map(tuple, quality.keep_good(docs).collect())) == wanted
    # null ids: all of them are the first document
    nulls = spark.createDataFrame([(None, t, h, o) for _, t, h, o in rows[:100]], docs.schema)
    assert {r["text"] for r in quality.keep_good(nulls).collect()} == {r[1] for r in rows[:100]}
    assert quality.keep_good(docs, line_most=1000, line_share=1).where("source = 'a' AND text LIKE 'Nav%'").count() == 101


def test_toxicity_bound_leaves_the_class_ratio(spark):
    """A sample that takes one class at a lower rate scores as one that takes all: with features, and without any."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"{'bad' if k < (6 if i % 10 == 0 else 2) else 'w'}{rng.integers(4)}" for k in rng.integers(0, 10, 4))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(3000)], "doc_id long, toxic int")
    whole, part = toxicity.fit(docs, labels), toxicity.fit(docs, labels, most_toxic=4000, most_other=300)
    assert part.intercept == pytest.approx(whole.intercept, abs=0.7)  # the rates are 1 and about 1/7: 2 in log-odds
    odds = lambda m: np.mean(m.scorer()([t for _, t in rows]))
    assert odds(whole) == pytest.approx(0.1, abs=0.02) and odds(part) == pytest.approx(0.1, abs=0.04)
    plain = docs.withColumn("text", F.lit(""))
    a, b = toxicity.fit(plain, labels), toxicity.fit(plain, labels, most_other=300)
    assert a.intercept == pytest.approx(b.intercept, abs=1e-9)
