"""Rows that stages keep: shared ids, repeated rows, missing ids; and odd tables through every operator and stage."""

from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from keelson.llm import bpe, conversations, exact_dedup, fill_in_middle, hmm, ngram_join, packing, pii, quality, token_counts, toxicity, url_rules, warc

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
A = " ".join(WORDS)
NEAR_A = " ".join(WORDS + ["fifteen"])
B = "only here are these words in this order and they stand nowhere else at all"


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", {"k": 1}) for r in rows], "doc_id long, text string, n string, stays map<string,int>").repartition(parts)


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, ngram_join.drop_near_copies])
def test_ids_with_two_texts_and_repeated_rows(spark, drop):
    rows = [(3, A), (3, A), (5, A), (5, B), (5, B), (9, B), (None, A), (None, "alone in all its words here"), (None, "alone in all its words here")]
    out = drop(table(spark, rows))
    assert out.columns == ["doc_id", "text", "n", "stays"]
    assert kept(out) == Counter([(3, A), (5, B), (None, "alone in all its words here")])
    assert kept(drop(table(spark, [(7, A)]))) == Counter([(7, A)]) and drop(table(spark, []).limit(0)).count() == 0


def test_exact_stage_by_normalised_text(spark):
    rows = [(1, "a  b"), (1, "a b"), (2, "a\tb"), (2, "c"), (None, None), (None, ""), (4, ""), (4, " ")]
    out = kept(exact_dedup.drop_exact_copies(table(spark, rows)))
    assert sum(out.values()) == 4 and {(i, exact_key(t)) for i, t in out} == {(1, "a b"), (2, "c"), (4, ""), (4, " ")}


def exact_key(t):
    import re

    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_near_stage_by_group(spark):
    rows = [(3, A), (5, NEAR_A), (5, B), (2, NEAR_A), (2, B + " too"), (None, NEAR_A), (None, ""), (None, "")]
    out = kept(ngram_join.drop_near_copies(table(spark, rows)))
    assert out == Counter([(2, NEAR_A), (2, B + " too"), (None, ""), (None, "")])


def test_hot_repeated_row(spark):
    """A third of all rows is one row; it stays once."""
    rows = [(1, A)] * 1500 + [(k, f"text {k} " + B) for k in range(2, 3000)]
    out = kept(exact_dedup.drop_exact_copies(table(spark, rows)))
    assert out[(1, A)] == 1 and sum(out.values()) == 2999


def test_line_frequency_counts_documents(spark):
    """Seven rows of one document and another one are two documents; rows without an id are told by their text."""
    own = lambda i: " ".join(f"u{i}_{k}" for k in range(60))
    rows = [(1, f"menu line\n{own(1)}", "h")] * 7 + [(30, f"menu line\n{own(30)}", "h")]
    rows += [(None, f"other line\n{own(50)}", "h")] * 7 + [(100 + k, f"third line\n{own(100 + k)}", "h") for k in range(6)] + [(100, f"third line\n{own(7)}", "h")]
    out = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["removed_words"]) for r in out) == Counter({(1, 0): 7, (30, 0): 1, (None, 0): 7, (100, 0): 2, **{(100 + k, 2): 1 for k in range(1, 6)}})


LONG = ["x" * 1_500_000, "word " * 300_000, "line\n" * 200_000, "\n" * 500_000, " " * 1_000_000]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("_key", "n", "key", "score", "_text", "area")])


@pytest.fixture(scope="module")
def odd(spark):
    """Very long texts, ties, repeated rows and ids, nulls in every column, and columns named like the operators' own."""
    rows = [(i, t, "en", "s", None) for i, t in enumerate(LONG)]
    rows += [(20, B, None, "s", 1), (20, B, None, "s", 1), (20, A, None, None, 1), (21, B, "en", "s", None), (None, None, None, None, None), (None, A, None, "s", 2), (22, "", "", "", 0)]
    rows += [(30 + k, " ".join(f"w{k}_{j}" for j in range(80)), "en", "s", 3) for k in range(20)]
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(30 + k, 1, k % 2) for k in range(20)] + [(20, None, 1), (None, 1, 1), (31, 1, 1), (31, 1, 1)], "doc_id long, quality int, toxic int")


BYTE, RANKS, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
BY_ROW = {
    "op2": lambda d, x: token_counts.count_tokens(d, BYTE),
    "op3": lambda d, x: ngram_join.near_groups(d),
    "op4": lambda d, x: exact_dedup.exact_groups(d),
    "op5": lambda d, x: bpe.round_trip(d, WORD).select("doc_id"),
    "op8": lambda d, x: quality.judge_quality(d),
    "op9": lambda d, x: toxicity.score_texts(d, toxicity.fit(d, x)).select("doc_id", "score"),
    "op10": lambda d, x: hmm.score_corpus(d).select("doc_id", "score"),
    "op11": lambda d, x: fill_in_middle.digested(d),
    "op12": lambda d, x: pii.digested(d),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_operators_take_odd_tables(odd, labels, name):
    """One row out for each row in, and the rows that are repeated have one result."""
    rows = BY_ROW[name](odd, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())


def test_packing_takes_odd_tables(odd):
    pieces = packing.pack_documents(odd, BYTE, RANKS, keep_ids=False)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("most")).collect()
    assert {r["doc_id"] for r in whole} == {r["doc_id"] for r in odd.select("doc_id").collect()} and all(r["n"] >= r["most"] for r in whole)


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_take_odd_tables(spark, odd, labels, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, odd, str(tmp_path))
    assert out.columns == odd.columns
    got = Counter((r["doc_id"], len(r["text"] or "")) for r in out.select("doc_id", "text").collect())
    assert all(got[(30 + k, n)] <= 1 for k in range(20) for n in (None, 0))
    assert sum(got.values()) <= odd.count() and (stage in (1,) or all(any(i == 30 + k for i, _ in got) for k in range(20)))


def test_pages_and_talks_with_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/" + "x/" * 200_000, "h" * 1_000_000, "c"), (1, None, None, "c"), (None, "http://a.net/x", "", None), (2, "http://a.net/x", "<p>", "c"), (2, "http://a.net/x", "<p>", "c")], "page_id long, url string, html string, host string")
    assert url_rules.judge_urls(pages, [("block", "net/")]).count() == 5
    assert warc.archived(pages).count() == 5
    assert url_rules.judge_urls(pages.limit(0), [("block", "net/")]).count() == warc.archived(pages.limit(0)).count() == 0
    talks = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, None, "user", "x" * 1_000_000)], "conv_id long, turn long, role string, text string")
    assert conversations.repair_after_damage(talks).count() == 2
