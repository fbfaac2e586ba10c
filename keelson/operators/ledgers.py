"""Ledgers and task graphs: exact-key merges, partition checks, what can run next."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.sources.durable import durable


def merged_ledger(expected: DataFrame, existing: DataFrame, backfill: DataFrame, key: str) -> DataFrame:
    """JOI-28: every expected key (with its ``position``) from exactly one of two sources; ``fault`` says neither or
    both. Keys that aren't expected appear with fault ``unexpected``."""
    a, b = existing.select(key, F.col("value").alias("a"), F.lit(True).alias("in_a")), backfill.select(key, F.col("value").alias("b"), F.lit(True).alias("in_b"))
    x = expected.withColumn("wanted", F.lit(True)).join(a, key, "full").join(b, key, "full")
    fault = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("in_a").isNull() & F.col("in_b").isNull(), "missing").when(F.col("in_a") & F.col("in_b"), "in_both")
    return x.select(key, "position", F.coalesce("a", "b").alias("value"), F.when(F.col("in_a") & F.col("in_b").isNull(), "existing").when(F.col("in_b") & F.col("in_a").isNull(), "backfill").alias("origin"), fault.alias("fault"))


def bound_hypotheses(exact: DataFrame, prepared: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """JOI-29, JOI-30: full outer match on the keys with the fault: one side lacking, or another identity."""
    x = exact.select(*keys, F.col(identity).alias("a")).join(prepared.select(*keys, F.col(identity).alias("b")), keys, "full")
    return x.select(*keys, F.when(F.col("a").isNull(), "not_exact").when(F.col("b").isNull(), "not_prepared").when(F.col("a") != F.col("b"), "identity").alias("fault"))


def matrix_faults(rows: DataFrame, key: str, axes: dict[str, list]) -> DataFrame:
    """JOI-36: cells of the expected cross product of the axes that a key lacks, has twice, or has beyond it.

    The product's size is the axes' alone; it is joined to the keys, of which each has so many cells."""
    cells = rows.select(key).distinct()
    for name, values in axes.items():
        cells = cells.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    names = list(axes)
    have = rows.groupBy(key, *names).agg(F.count("*").alias("n"))
    x = cells.withColumn("wanted", F.lit(True)).join(have, [key, *names], "full")
    fault = F.when(F.col("wanted").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return x.withColumn("fault", fault).where("fault IS NOT NULL").select(key, *names, "fault")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """JOI-32: rows of either side that the other lacks, counted."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).union(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def partition_faults(requested: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """CLU-23, CMP-02: keys that are in none or several of the parts of a partition, or not requested."""
    every = None
    for name, part in parts.items():
        p = part.select(key, F.lit(name).alias("part"))
        every = p if every is None else every.union(p)
    x = requested.select(key).distinct().withColumn("wanted", F.lit(True)).join(every.groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts")), key, "full")
    fault = F.when(F.col("wanted").isNull(), "not_requested").when(F.col("parts").isNull(), "in_none").when(F.size("parts") > 1, "in_several")
    return x.withColumn("fault", fault).where("fault IS NOT NULL").select(key, "parts", "fault")


def ready_tasks(tasks: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """CLU-26, STR-04: tasks not done whose parents all are; ``first`` marks the one with the lowest ordinal.
    ``task, ordinal``; ``task, parent``; ``task``."""
    open_ = tasks.join(done.select("task"), "task", "left_anti")
    waiting = edges.join(done.select(F.col("task").alias("parent")), "parent", "left_anti").select("task")
    ready = open_.join(waiting, "task", "left_anti")
    low = ready.agg(F.min("ordinal").alias("low"))
    return ready.join(F.broadcast(low)).select("task", "ordinal", (F.col("ordinal") == F.col("low")).alias("first"))


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """CLU-26: the depth of every task below the roots: one join a level over the new tasks only, each level stored
    so that the plan doesn't grow. A task that several levels reach has the largest. A cycle is an error: no chain is longer
    than there are tasks."""
    most = edges.select("task").distinct().count()
    front = durable(roots.select("task", F.lit(0).alias("level")), "level")
    found = [front]
    for level in count(1):
        front = durable(edges.join(front.select(F.col("task").alias("parent")), "parent").select("task", F.lit(level).alias("level")).distinct(), "level")
        if front.isEmpty():
            break
        if level > most:
            raise ValueError("the tasks' dependencies have a cycle")
        found.append(front)
    return reduce(DataFrame.union, found).groupBy("task").agg(F.max("level").alias("level"))


def stage_counts(tasks: DataFrame, expected: dict[str, int]) -> DataFrame:
    """AGG-49: tasks a stage against the expected number (null: a stage that isn't expected)."""
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    n = tasks.groupBy("stage").agg(F.count("*").alias("n"))
    return n.select("stage", "n", F.try_element_at(want, F.col("stage")).alias("expected")).withColumn("agrees", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)))


def offsets(parts: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """AGG-48: where each part begins when a group's parts are laid end to end."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("begin", F.coalesce(F.sum(size).over(w), F.lit(0)))


def pair_key(df: DataFrame, column: str, separator: str = "_to_") -> DataFrame:
    """CMP-19: the two halves of "a_to_b"; null unless there is exactly one separator."""
    parts = F.split(column, separator)
    ok = F.size(parts) == 2
    return df.withColumn("source", F.when(ok, F.get(parts, F.lit(0)))).withColumn("reference", F.when(ok, F.get(parts, F.lit(1))))


def row_hash(df: DataFrame, key: list[str]) -> DataFrame:
    """FUN-13, FUN-21: SHA-256 of a row as JSON with its columns in order of name; this engine's own text, not
    comparable with other programs' hashes."""
    return df.select(*key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("row_sha256"))
