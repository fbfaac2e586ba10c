"""Point correspondences: capping, re-weighting, geometric compatibility.

``pair_id, node_pair, idx, sx, sy, sz, rx, ry, rz, score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators import grouped


def best_correspondences(corr: DataFrame, most: int = 1000, least: int = 40) -> DataFrame:
    """SRC-14: a pair's ``most`` best by score, ties by idx; ``too_few`` marks pairs with under ``least`` rows."""
    w = Window.partitionBy("pair_id").orderBy(F.col("score").desc(), "idx")
    return corr.withColumn("rank", F.row_number().over(w)).withColumn("too_few", F.count("*").over(Window.partitionBy("pair_id")) < least).where(F.col("rank") <= most)


def cap_per_node_pair(corr: DataFrame, total: int = 1000) -> DataFrame:
    """WIN-03, WIN-16: floor(total / node pairs) of each node pair, at least one, by score. A row is shuffled and sorted once; ranks and
    numbers of node pairs are found where a pair's rows are."""
    rest = [c for c in corr.columns if c != "pair_id"]

    def solve(rows, at):
        first = grouped.starts(rows, ["pair_id", "node_pair"])
        rank = np.arange(rows.num_rows) - np.repeat(first, np.diff(np.r_[first, rows.num_rows])) + 1
        many = np.diff(np.searchsorted(first, at))
        group = np.repeat(np.arange(len(at) - 1), np.diff(at))
        keep = np.flatnonzero(rank <= np.maximum(total // many, 1)[group])
        return {"group": group[keep]} | {c: rows.column(c).take(pa.array(keep)) for c in rest} | {"rank": rank[keep].astype(np.int32)}

    found = grouped.whole_groups(corr.where("pair_id IS NOT NULL"), ["pair_id"], ["node_pair", "score", "idx"], solve, f"{grouped.kinds(corr, rest)}, rank int", descend=("score",))
    return found.select(*corr.columns, "rank")


def rescored(corr: DataFrame, prior: DataFrame, beta: float = 1.0) -> DataFrame:
    """WIN-05: score over the node pair's best, times exp(beta z) of the node pair's standardised prior
    (population deviation over distinct node pairs; under 1e-8 it counts as 1). ``prior``: ``pair_id, node_pair, prior``."""
    p = prior.groupBy("pair_id").agg(F.avg("prior").alias("m"), F.stddev_pop("prior").alias("sd"))
    z = prior.join(p, "pair_id").select("pair_id", "node_pair", ((F.col("prior") - F.col("m")) / F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd"))).alias("z"))
    top = F.max("score").over(Window.partitionBy("pair_id", "node_pair"))
    return corr.withColumn("top", top).join(z, ["pair_id", "node_pair"]).withColumn("weight", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0) * F.exp(beta * F.col("z"))).drop("top", "z")


def global_top(weighted: DataFrame, k: int = 1000) -> DataFrame:
    """WIN-04: the pair's k best by weight."""
    w = Window.partitionBy("pair_id").orderBy(F.round("weight", 9).desc(), "node_pair", "idx")
    return weighted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _length(a: str, b: str, side: str) -> Column:
    d = [F.col(f"{a}_{side}{c}") - F.col(f"{b}_{side}{c}") for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def compatible_pairs(corr: DataFrame, tolerance: float = 0.05, separation: float = 0.02, relative: float = 0.0) -> DataFrame:
    """JOI-09, JOI-10: two correspondences of a pair are compatible if they keep their distance: lengths on
    both sides at least ``separation`` and apart by at most max(tolerance, relative x the longer one).

    Joined within the pair, idx a < idx b; a pair's rows are capped before (see :func:`best_correspondences`)."""
    side = lambda p: corr.select("pair_id", *[F.col(c).alias(f"{p}_{c}") for c in ("idx", "sx", "sy", "sz", "rx", "ry", "rz")])
    x = side("a").join(side("b"), "pair_id").where("a_idx < b_idx").withColumn("ds", _length("a", "b", "s")).withColumn("dr", _length("a", "b", "r"))
    bound = F.greatest(F.lit(tolerance), F.lit(relative) * F.greatest("ds", "dr"))
    return x.where((F.abs(F.col("ds") - F.col("dr")) <= bound) & (F.least("ds", "dr") >= separation)).select("pair_id", F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), "ds", "dr")


def region_compatible(candidates: DataFrame, centres: DataFrame, edges: DataFrame, tolerance: float = 0.10, share: float = 0.20) -> DataFrame:
    """JOI-11, JOI-12: two candidates (s1, r1), (s2, r2) of a pair support each other if they are one to one,
    their centre distances differ by at most max(tolerance, share x the longer), and the objects are
    neighbours on both graphs. ``candidates``: ``pair_id, s, r``; ``centres``: ``node, cx, cy, cz``; ``edges``: ``low, high``."""
    c = candidates
    for side in "sr":
        c = c.join(centres.select(F.col("node").alias(side), *[F.col(f"c{k}").alias(f"{side}{k}") for k in "xyz"]), side)
    of = lambda p: c.select("pair_id", *[F.col(k).alias(f"{p}_{k}") for k in ("s", "r", "sx", "sy", "sz", "rx", "ry", "rz")])
    x = of("a").join(of("b"), "pair_id").where("a_s < b_s AND a_r <> b_r").withColumn("ds", _length("a", "b", "s")).withColumn("dr", _length("a", "b", "r"))
    x = x.where(F.abs(F.col("ds") - F.col("dr")) <= F.greatest(F.lit(tolerance), F.lit(share) * F.greatest("ds", "dr")))
    for side in "sr":
        e = edges.select(F.col("low").alias("_low"), F.col("high").alias("_high"))
        x = x.join(e, (F.least(f"a_{side}", f"b_{side}") == F.col("_low")) & (F.greatest(f"a_{side}", f"b_{side}") == F.col("_high")), "left_semi")
    return x.select("pair_id", F.col("a_s").alias("s1"), F.col("a_r").alias("r1"), F.col("b_s").alias("s2"), F.col("b_r").alias("r2"))


def residuals(corr: DataFrame, transform: str = "transform", inlier: float = 0.10) -> DataFrame:
    """AGG-39, AGG-46: per pair median, mean, p90 and rms of the residuals under the pair's transform, and
    the share of those strictly under ``inlier``."""
    from keelson.functions.se3 import apply

    moved = apply(transform, F.col("sx"), F.col("sy"), F.col("sz"))
    d = [m - F.col(f"r{c}") for m, c in zip(moved, "xyz")]
    x = corr.withColumn("res", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return x.groupBy("pair_id").agg(F.count("*").alias("n"), F.median("res").alias("median"), F.avg("res").alias("mean"), F.percentile("res", F.lit(0.9)).alias("p90"), F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rmse"), F.count_if(F.col("res") < inlier).alias("inliers"), F.avg((F.col("res") < inlier).cast("double")).alias("inlier_ratio"))


def array_difference(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """CMP-06: per key whether two arrays have one length, the largest difference, and the first position beyond the tolerance."""
    x = left.select(key, F.col(value).alias("a")).join(right.select(key, F.col(value).alias("b")), key, "full")
    d = F.zip_with("a", "b", lambda p, q: F.abs(p - q))
    beyond = F.filter(F.transform(d, lambda v, i: F.when(F.coalesce(v, F.lit(float("inf"))) > tolerance, i)), lambda i: i.isNotNull())
    return x.select(key, F.coalesce(F.size("a") == F.size("b"), F.lit(False)).alias("same_shape"), F.array_max(d).alias("largest"), F.get(beyond, F.lit(0)).alias("first_beyond"))


def array_statistics(rows: DataFrame, key: str, value: str) -> DataFrame:
    """CMP-07: statistics of all numbers under a key; NaNs and infinities are counted and left out of the rest."""
    x = rows.select(key, F.explode(value).alias("v")).withColumn("ok", ~F.isnan("v") & (F.abs("v") < float("inf")))
    good = F.when(F.col("ok"), F.col("v"))
    return x.groupBy(key).agg(
        F.count("*").alias("n"), F.min(good).alias("least"), F.max(good).alias("most"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"), F.sum(F.abs(good)).alias("l1"), F.sqrt(F.sum(good * good)).alias("l2"),
        F.count_if(good == 0).alias("zeros"), F.count_if((F.abs(good) > 0) & (F.abs(good) < 1.17549435e-38)).alias("subnormal"), F.count_if(F.isnan("v")).alias("nans"), F.count_if(F.abs("v") == float("inf")).alias("infs"),
    )


def largest_remainder(lengths: DataFrame, total: int) -> DataFrame:
    """WIN-17: shares of ``total`` in proportion to ``length``, at least one each; what rounding down leaves goes
    to the largest remainders, ties to the lowest item. ``pair_id, item, length``."""
    w = Window.partitionBy("pair_id")
    x = lengths.withColumn("exact", F.col("length") * total / F.sum("length").over(w)).withColumn("quota", F.greatest(F.floor("exact"), F.lit(1)))
    x = x.withColumn("rest", F.lit(total) - F.sum("quota").over(w))
    x = x.withColumn("rank", F.row_number().over(w.orderBy(F.round(F.col("exact") - F.floor("exact"), 9).desc(), "item")))
    return x.select("pair_id", "item", "length", (F.col("quota") + F.when(F.col("rank") <= F.col("rest"), 1).otherwise(0)).alias("target"))
