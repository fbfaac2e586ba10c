import pytest

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType())])

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "  a \n b  ", "it's we'll I'D 'tis", "Hello  Wörld <|endoftext|> x<|startoftext|>y", "tab\tand\x0bvertical\x0cfeed\r\n",
    "non\u00a0breaking\u2003space \u3000 x", "file\x1cgroup \x1d sep !\x1e!", "e\u0301 combining É \u0130 ß Σίσυφος ΣΑΣ", "日本語のテキスト 123４５ ½ ²", "emoji 😀👩‍👩‍👧 done", "x" * 300 + " " + "word " * 400, "#*$%&|<> ##", "\u00a0", "1 22 333 4444", "a\n\na\n a \nA",
]


@pytest.fixture(scope="session")
def corpus():
    """Odd texts, ties and repeats, and some real documents."""
    import pyarrow.parquet as pq

    rows = [(i, t, "en", f"s{i % 2}", None, "clash") for i, t in enumerate(ODD)]
    rows += [(100, "same text here", None, None, 1, "x"), (100, "same text here", None, None, 1, "x"), (None, "no id", "en", "s1", 2, None), (101, "same  text\there", "en", "s0", 3, None)]
    real = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    return rows + [(1000 + r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "z") for r in real]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
