"""Exact deduplication by progressive refinement.

Rows are grouped by the length of their normalised text; of lengths that more than one row has, by a hash of the first
characters; only rows whose (length, prefix) group has company have their whole content hashed. That set goes to the second
reading of the texts as a bitmap of bounded size, so no text is shuffled. (If the groups with company are too many for
a bitmap, all rows are hashed: the same result.) A full group is its SHA-256. Groups are counted with partial sums; their
results go back to the rows by a join that keeps the rows of large groups where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import SPACES, durable, join_hot, keep_told, marked, words_text

PREFIX_CHARS = 64


def normalised(text: str):
    """Each run of the contract's white space as one space; null as empty."""
    return F.regexp_replace(words_text(text), f"{SPACES}+", " ")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest_all: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal texts (after :func:`normalised`; null is empty) form a group; the row with the smallest
    ``doc_id`` stays, null ids after all others. ``text_sha256`` is null for a row that the first two
    steps already showed to be alone, unless ``digest_all``. Repeated ids: each row counts in
    ``group_size``, and of a group's rows with the smallest id all are ``kept`` (they are the same
    row). A group of null ids keeps them all. Other columns are left out.
    """
    # projected before the bitmap join, so that only these columns meet it
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("_text")).withColumn("_len", F.length("_text")).withColumn("_prefix", F.xxhash64("_len", F.substring("_text", 1, PREFIX_CHARS)))
    prefixes = durable(rows.groupBy("_len", "_prefix").agg(F.count("*").alias("n")), "prefixes")
    lengths = prefixes.groupBy("_len").agg(F.sum("n").alias("rows")).where("rows > 1").select("_len")
    crowded = durable(prefixes.where("n > 1").join(lengths, "_len", "left_semi").select("_prefix"), "crowded")
    maybe = marked(rows, F.col("_prefix"), crowded, F.col("_prefix"), "_maybe")
    sha = F.sha2(F.encode("_text", "UTF-8"), 256)
    table = durable(maybe.select("doc_id", F.col("_maybe").alias("maybe"), (sha if digest_all else F.when(F.col("_maybe"), sha)).alias("text_sha256")), "digests")
    together = table.where("maybe").select("doc_id", "text_sha256")
    groups = durable(together.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("n", F.col("group_size")), "groups")
    found = join_hot(together, groups, ["text_sha256"], "n", together.count())
    alone = table.where("NOT maybe").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return found.unionByName(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` less its exact copies, with all columns: of each group of equal texts one row, with the smallest ``doc_id``.

    A row is told by its id and text, so rows that share an id but not a text are judged apart. Of repeated rows, and of rows without
    an id in a group that has no other, one stays.
    """
    rows = exact_groups(docs, text, doc_id).where("text_sha256 IS NOT NULL")
    told = rows.groupBy("doc_id", F.col("text_sha256").alias("digest")).agg(F.count("*").alias("n"), F.max("kept").alias("stays")).where("NOT stays OR n > 1")
    return keep_told(docs, told, F.col(doc_id), F.sha2(F.encode(normalised(text), "UTF-8"), 256))
