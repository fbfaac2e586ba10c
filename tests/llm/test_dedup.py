"""Exact and near copies against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from keelson.llm import exact_dedup, ngram_join
from keelson.llm import common, quality
from keelson.llm.common import components, join_hot, marked
from pyspark.sql import functions as F


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("all_", [True, False])
def test_exact_groups(docs, corpus, all_):
    groups = defaultdict(list)
    for d, t, *_ in corpus:
        groups[norm(t)].append(d)
    wanted = Counter()
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            wanted[i, first, len(ids), i == first, hashlib.sha256(text.encode()).hexdigest() if all_ or len(ids) > 1 else None] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(docs, digest_all=all_).collect()) == wanted


def test_exact_keeps_columns(docs, corpus):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert kept.select(exact_dedup.normalised("text")).distinct().count() == len({norm(t) for _, t, *_ in corpus})


def test_nothing(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert ngram_join.near_groups(empty).count() == 0


def sets_of(text, n=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    return set() if not w else {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    n = len(rows)
    root, links, same = list(range(n)), [0] * n, [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 5 * k >= 4 * len(sets[i] | sets[j]):
                for x in (i, j):
                    links[x] += 1
                    same[x] += sets[i] == sets[j]
                root[find(i)] = find(j)
    first = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)].append(d)
    return Counter((d, min(first[find(i)], default=None), links[i], same[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2, 256])
def test_near_groups(spark, corpus, block):
    rng = np.random.default_rng(1)
    rows = [(d, t) for d, t, *_ in corpus]
    base = [f"w{i}" for i in range(120)]
    for k in range(60):  # one group of near copies, some at the threshold
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            w[at] = f"v{rng.integers(1e6)}"
        rows.append((5000 + k, " ".join(w)))
    rows += [(6000 + k, " ".join(base) + f" tail{k // 20}") for k in range(40)]
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_near_keeps_first(docs):
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < docs.count()


def test_posterior_bounds():
    # the fewest matches grow with n, and a pair whose values all match is never dropped
    found = ngram_join.least_matches(240, 16, (4, 5), 1e-9)
    assert list(found.values()) == sorted(found.values()) and all(m <= n for n, m in found.items())
    assert found[240] < 0.8 * 240 * 0.95


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    touched = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in touched}


def test_bitmap_has_no_false_negatives(spark):
    rows = spark.range(2000)
    odd = rows.where("id % 2 = 1")
    out = marked(rows, F.xxhash64("id"), odd, F.xxhash64("id"), "m")
    assert out.where("id % 2 = 1 AND NOT m").count() == 0
    assert out.where("id % 2 = 0 AND m").count() < 60


def test_too_many_keys_for_a_bitmap(spark, docs, monkeypatch):
    wanted = Counter(tuple(r) for r in exact_dedup.exact_groups(docs, digest_all=True).collect())
    monkeypatch.setattr(common, "MOST_BITS", -2)
    rows = spark.range(20)
    assert marked(rows, F.xxhash64("id"), rows.where("id < 3"), F.xxhash64("id"), "m").where("m").count() == 20
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(docs, digest_all=True).collect()) == wanted
    told = rows.where("id < 3").select(F.col("id").alias("doc_id"), F.lit("d").alias("digest"), F.lit(1).alias("n"), F.lit(False).alias("stays"))
    assert common.keep_told(rows, told, F.col("id"), F.lit("d")).count() == 17


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot(spark, how):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("x"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("top")).where("top % 2 = 1")
    got = Counter(tuple(r) for r in join_hot(rows, facts, ["k"], "n", 3000, how).collect())
    assert got == Counter(tuple(r) for r in rows.join(facts.drop("n"), "k", how).collect())


CLASHES = ["_bucket", "_bits", "_marked", "_key", "_gone", "_d", "_h", "_r", "_bad", "_row", "_host", "_at", "text_sha256", "class_id", "kept", "line", "n"]


def test_clashing_columns(docs):
    """Rows of documents may have columns of any names: the stages that drop rows keep them."""
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    for drop in (exact_dedup.drop_exact_copies, ngram_join.drop_near_copies, quality.keep_good):
        out = drop(wide)
        assert out.columns == wide.columns
        assert Counter(map(tuple, out.select(docs.columns).collect())) == Counter(map(tuple, drop(docs).collect()))
        assert {tuple(r) for r in out.select(CLASHES).collect()} == {tuple(range(len(CLASHES)))}
