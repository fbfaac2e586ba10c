"""Experiment rows: counts, paired comparison, gates, bootstrap.

Runs: ``dataset, split, pair_id, arm, repeat, status, accepted, rre, rte, coverage, combo``. A failed row has no
metrics and stays in every denominator (SEM-05); a ratio without a base is null (SEM-06).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.se3 import grade


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def outcomes(runs: DataFrame) -> DataFrame:
    """CMP-04, VAL-09: adds ``strict, relaxed, catastrophic, accepted_correct, accepted_error, structured``."""
    strict, relaxed, bad = grade(F.col("rre"), F.col("rte"))
    x = runs.withColumn("strict", strict).withColumn("relaxed", relaxed).withColumn("catastrophic", bad).withColumn("structured", F.col("status") == "completed")
    return x.withColumn("accepted_correct", F.col("accepted") & F.col("strict")).withColumn("accepted_error", F.col("accepted") & ~F.col("strict"))


def violations(rows: DataFrame) -> DataFrame:
    """VAL-09: rows whose flags contradict each other, with the rules they break."""
    rules = [(F.col("strict") & ~F.col("relaxed"), "strict_not_relaxed"), (~F.col("structured") & (F.col("strict") | F.col("accepted")), "outcome_without_result"), (F.col("accepted_correct") != (F.col("accepted") & F.col("strict")), "accepted_correct"), (F.col("catastrophic") & F.col("relaxed"), "catastrophic_but_relaxed")]
    x = rows.withColumn("broken", F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in rules])))
    return x.where(F.size("broken") > 0)


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """AGG-13, AGG-14, AGG-20 to AGG-22, AGG-43, CMP-02: counts and rates of outcomes by any keys."""
    n = {c: F.count_if(c) for c in ("structured", "accepted", "strict", "relaxed", "catastrophic", "accepted_correct", "accepted_error")}
    x = rows.groupBy(*keys).agg(F.count("*").alias("requested"), *[v.alias(k) for k, v in n.items()], F.median("rre").alias("median_rre"), F.median("rte").alias("median_rte"), F.avg("coverage").alias("mean_coverage"))
    return x.withColumn("failed", F.col("requested") - F.col("structured")).withColumn("rejected", F.col("structured") - F.col("accepted")).withColumn("precision", ratio(F.col("accepted_correct"), F.col("accepted"))).withColumn("recall", F.col("strict") / F.col("requested"))


def replay(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """AGG-13: every rule over every row (``accepted`` becomes the rule's word), summed up by rule."""
    verdicts = F.array(*[F.struct(F.lit(name).alias("rule"), (F.col("structured") & F.coalesce(ok, F.lit(False))).alias("says")) for name, ok in rules.items()])
    x = rows.withColumn("v", F.explode(verdicts)).withColumn("rule", F.col("v.rule")).withColumn("accepted", F.col("v.says")).drop("v")
    x = x.withColumn("accepted_correct", F.col("accepted") & F.col("strict")).withColumn("accepted_error", F.col("accepted") & ~F.col("strict"))
    return confusion(x, "rule")


def ablation(rows: DataFrame) -> DataFrame:
    """AGG-22: combination by split, with totals over either and over both (null keys)."""
    return rows.cube("combo", "split").agg(F.count("*").alias("requested"), F.count_if("structured").alias("structured"), F.count_if("accepted").alias("accepted"), F.count_if("accepted_correct").alias("accepted_correct"), F.median("rre").alias("median_rre"))


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row with the highest ``repeat`` of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col("repeat").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def paired(rows: DataFrame, a: str = "baseline", b: str = "candidate") -> DataFrame:
    """CMP-01, CMP-12: a pair's last run of either arm side by side: rescue, destruction, wrong accepts brought in or
    removed, a changed repeat (null-safe). A pair that lacks an arm appears with nulls."""
    x = latest(rows, "pair_id", "arm")
    side = lambda arm: x.where(F.col("arm") == arm).select("pair_id", *[F.col(c).alias(f"{arm}_{c}") for c in ("accepted_correct", "accepted_error", "strict", "repeat", "rre")])
    both = side(a).join(side(b), "pair_id", "full")
    yes = lambda arm, c: F.coalesce(F.col(f"{arm}_{c}"), F.lit(False))
    return both.select(
        "pair_id", (yes(b, "accepted_correct") & ~yes(a, "accepted_correct")).alias("rescue"), (yes(a, "accepted_correct") & ~yes(b, "accepted_correct")).alias("destruction"), (yes(b, "accepted_error") & ~yes(a, "accepted_error")).alias("wrong_in"),
        (yes(a, "accepted_error") & ~yes(b, "accepted_error")).alias("wrong_out"), (~F.col(f"{a}_repeat").eqNullSafe(F.col(f"{b}_repeat"))).alias("changed"), (F.col(f"{b}_rre") - F.col(f"{a}_rre")).alias("rre_delta"),
    )


def primary_cost(rows: DataFrame) -> DataFrame:
    """AGG-21: mean over requested pairs of rre / 5 + rte / 0.2, a failure counting 100, by data set and arm."""
    cost = F.when(F.col("structured") & F.col("rre").isNotNull(), F.col("rre") / 5 + F.col("rte") / 0.2).otherwise(100.0)
    return rows.groupBy("dataset", "arm").agg(F.avg(cost).alias("cost"), F.count_if("catastrophic").alias("catastrophic"), (F.count_if("strict") / F.count("*")).alias("recall"))


def flips(rows: DataFrame) -> DataFrame:
    """CMP-05, AGG-44: pairs whose repeats disagree on ``strict``; whether they all, some or never accept."""
    return rows.groupBy("pair_id", "arm").agg(F.count("*").alias("repeats"), (F.count_distinct("strict") > 1).alias("flips"), F.count_if("accepted_error").alias("accepted_errors"), F.when(F.every("accepted"), "all").when(F.bool_or("accepted"), "mixed").otherwise("none").alias("repeatability"))


def sign_stability(rows: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """AGG-18, AGG-19: the median, and whether all values beyond the tolerance have one sign (none: stable)."""
    sign = F.when(F.abs(F.col(value)) > tolerance, F.signum(value))
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.median(value).alias("median"), (F.count_distinct(sign) <= 1).alias("stable"))


def determinism(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """CMP-03: rows of two runs that differ: missing on one side, another status or verdict, or a moved error."""
    cols = ["status", "accepted", "rre"]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in cols], F.lit(True).alias(f"{p}_here"))
    x = side(first, "a").join(side(second, "b"), keys, "full")
    what = F.when(F.col("a_here").isNull(), "only_second").when(F.col("b_here").isNull(), "only_first").when(~F.col("a_status").eqNullSafe(F.col("b_status")), "status").when(~F.col("a_accepted").eqNullSafe(F.col("b_accepted")), "verdict").when(~F.col("a_rre").eqNullSafe(F.col("b_rre")), "error")
    return x.withColumn("difference", what).where("difference IS NOT NULL").select(*keys, "difference", F.abs(F.col("b_rre") - F.col("a_rre")).alias("moved"))


def failure_histogram(rows: DataFrame) -> DataFrame:
    """AGG-42: rows by "stage:reason"; a row counts under each of its reasons. ``stage, reasons array``."""
    return rows.select("stage", F.explode("reasons").alias("reason")).groupBy(F.concat_ws(":", "stage", "reason").alias("failure")).agg(F.count("*").alias("n"))


def leaderboard(rows: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    """WIN-12, WIN-14, CMP-11: the first ``n`` of each key by an order that ends in an id; ``tied`` marks a row
    whose measures (all of the order but the id) others share."""
    w = Window.partitionBy(key).orderBy(*order)
    t = Window.partitionBy(key).orderBy(*order[:-1])
    x = rows.withColumn("place", F.row_number().over(w)).withColumn("rank", F.rank().over(t))
    return x.withColumn("tied", F.count("*").over(Window.partitionBy(key, "rank")) > 1).where(F.col("place") <= n)


def ordinal_share(rows: DataFrame, key: str, value: str) -> DataFrame:
    """WIN-12: (dense rank - 1) over the largest, 0 if all are equal."""
    r = F.dense_rank().over(Window.partitionBy(key).orderBy(value)) - 1
    x = rows.withColumn("r", r)
    return x.withColumn("share", F.col("r") / F.greatest(F.max("r").over(Window.partitionBy(key)), F.lit(1))).drop("r")


def strata(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """WIN-13: pairs by role, each role taking its first of those no earlier role took: the most dispersed, those
    nearest the bound, those furthest inside. ``pair_id, dispersion, margin``."""
    order = {"dispersed": [F.col("dispersion").desc(), F.col("pair_id")], "near_boundary": [F.abs("margin"), F.col("pair_id")], "high_margin": [F.col("margin").desc(), F.col("pair_id")]}
    left, out = rows, None
    for role, n in sizes.items():
        got = left.orderBy(*order[role]).limit(n).select("pair_id", F.lit(role).alias("role"))
        left = left.join(got, "pair_id", "left_anti")
        out = got if out is None else out.union(got)
    return out


#: Where a Poisson(1) count steps up, on 32-bit numbers.
POISSON_STEPS = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(7)]
#: Groups whose sums a task holds at a time, and rows that it draws for at a time.
GROUPS_HELD, ROWS_DRAWN = 32, 64


def resample_weights(ids: np.ndarray, samples: int) -> np.ndarray:
    """(rows, samples) Poisson(1) counts from 32-bit row hashes, by two rounds of congruential steps and shifts."""
    mask = np.uint64(0xFFFFFFFF)
    x = ids.astype(np.uint64)[:, None] ^ ((np.arange(samples, dtype=np.uint64) * np.uint64(2654435769)) & mask)
    x = (x * np.uint64(1664525) + np.uint64(1013904223)) & mask
    x ^= x >> np.uint64(16)
    x = (x * np.uint64(22695477) + np.uint64(1)) & mask
    x ^= x >> np.uint64(15)
    return np.searchsorted(np.array(POISSON_STEPS, np.uint64), x, side="right").astype(np.float64)


def paired_bootstrap(pairs: DataFrame, baseline: str, candidate: str, group: str, key: str, samples: int = 10_000) -> DataFrame:
    """AGG-12: relative improvement of the mean (1 - candidate / baseline) over paired rows, with the 2.5 and 97.5
    percentiles over ``samples`` resamples, and the gate (at least 10 %, lower end above 0).

    A resample weighs every row by a Poisson(1) count drawn from the resample's number and a hash of ``key``. Rows stay where
    they are: a task adds weights times values to one array of ``samples`` sums a group and side, and hands the arrays on;
    only those sums are shuffled, ``samples`` rows a group and task, whatever the number of rows. Resamples whose
    baseline sums to 0 are left out."""
    x = pairs.where(F.col(baseline).isNotNull() & F.col(candidate).isNotNull())
    rows = x.select(F.col(group).cast("string").alias("group"), F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long").alias("id"), F.col(baseline).cast("double").alias("b"), F.col(candidate).cast("double").alias("c"))

    def partial(it):
        held: dict = {}

        def handed_on():
            for name, sums in held.items():
                yield pa.RecordBatch.from_pydict({"group": pa.array([name] * samples, pa.string()), "rep": pa.array(range(samples), pa.int32()), "b": sums[0], "c": sums[1]})
            held.clear()

        for batch in it:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            ids, b, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for name in dict.fromkeys(names):
                at = np.flatnonzero(names == name) if name is not None else np.flatnonzero([n is None for n in names])
                if name not in held and len(held) >= GROUPS_HELD:
                    yield from handed_on()
                sums = held.setdefault(name, np.zeros((2, samples)))
                for k in range(0, len(at), ROWS_DRAWN):
                    part = at[k : k + ROWS_DRAWN]
                    sums += np.stack([b[part], c[part]]) @ resample_weights(ids[part], samples)
        yield from handed_on()

    sums = rows.mapInArrow(partial, "group string, rep int, b double, c double").groupBy("group", "rep").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    ci = sums.where("b <> 0").groupBy("group").agg(F.percentile(1 - F.col("c") / F.col("b"), F.lit(0.025)).alias("low"), F.percentile(1 - F.col("c") / F.col("b"), F.lit(0.975)).alias("high"))
    seen = x.groupBy(group).agg(F.count("*").alias("n"), (1 - F.avg(candidate) / F.avg(baseline)).alias("improvement"))
    return seen.join(ci.withColumnRenamed("group", "_group"), F.col(group).cast("string").eqNullSafe(F.col("_group"))).drop("_group").withColumn("passed", (F.col("improvement") >= 0.10) & (F.col("low") > 0))


def gate(summary: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """CLU-27, CLU-28, CMP-08 to CMP-10: the sorted names of the failed checks; a null check fails."""
    failed = F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])))
    return summary.withColumn("failed_checks", failed).withColumn("passed", F.size("failed_checks") == 0)


def three_way_cycles(estimates: DataFrame) -> DataFrame:
    """JOI-23: triples a < b < c of a group's nodes: available if all three estimates are there (either way round),
    with the closure error of going round. ``grp, i, j, t`` (t: from i to j)."""
    from keelson.functions import se3

    both = estimates.select("grp", "i", "j", "t").union(estimates.select("grp", F.col("j"), F.col("i"), se3.inverse("t"))).dropDuplicates(["grp", "i", "j"])
    nodes = both.select("grp", "i").distinct()
    n = lambda c: nodes.select("grp", F.col("i").alias(c))
    tri = n("a").join(n("b"), "grp").where("a < b").join(n("c"), "grp").where("b < c")
    e = lambda p, q: both.select("grp", F.col("i").alias(p), F.col("j").alias(q), F.col("t").alias(f"{p}{q}"))
    x = tri.join(e("a", "b"), ["grp", "a", "b"], "left").join(e("b", "c"), ["grp", "b", "c"], "left").join(e("a", "c"), ["grp", "a", "c"], "left")
    there = F.col("ab").isNotNull() & F.col("bc").isNotNull() & F.col("ac").isNotNull()
    round_ = F.when(there, se3.compose("ab", "bc"))
    return x.select("grp", "a", "b", "c", there.alias("available"), se3.rotation_distance(round_, F.col("ac")).alias("dr"), se3.translation_distance(round_, F.col("ac")).alias("dt"))
