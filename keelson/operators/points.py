"""Labelled point clouds: ``scan_id, label, row_id, x, y, z`` (metres).

Neighbour searches with a radius are equi joins on voxel cells of that size (a point meets the 27 cells
around it), never all pairs of a scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators import grouped, sparse


def cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(size)).cast("long")


def segments(points: DataFrame, min_points: int = 50) -> DataFrame:
    """SRC-01, SRC-12: points of labels other than 0 with at least ``min_points`` points in their scan."""
    p = points.where("label <> 0")
    big = p.groupBy("scan_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("scan_id", "label")
    return p.join(big, ["scan_id", "label"], "left_semi").select(points.columns)


def exact_dedup(points: DataFrame) -> DataFrame:
    """SRC-13: one row a bit-identical position, the first; ``conflict`` if its rows disagree on the label."""
    return points.groupBy("scan_id", "x", "y", "z").agg(F.min("row_id").alias("row_id"), F.min_by("label", "row_id").alias("label"), F.count("*").alias("rows"), (F.count_distinct("label") > 1).alias("conflict"))


def object_statistics(points: DataFrame) -> DataFrame:
    """AGG-04, AGG-05, AGG-07, AGG-08: per object the count, distinct millimetre positions, centre, extent."""
    mm = [F.rint(F.col(c) * 1000) for c in "xyz"]
    span = F.sqrt(sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in "yz"), (F.max("x") - F.min("x")) * (F.max("x") - F.min("x"))))
    return points.groupBy("scan_id", "label").agg(F.count("*").alias("n"), F.count_distinct(*mm).alias("distinct_mm"), *[F.avg(c).alias(f"c{c}") for c in "xyz"], span.alias("extent"))


def voxel_aggregate(points: DataFrame, size: float) -> DataFrame:
    """AGG-06: per cell (from the origin) the mean position and the sorted source rows."""
    return points.groupBy("scan_id", *[cell(c, size).alias(f"i{c}") for c in "xyz"]).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n"), F.array_sort(F.collect_list("row_id")).alias("rows"))


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """CMP-29: means of cells that are anchored half a cell below the scan's smallest coordinates."""
    low = points.groupBy("scan_id").agg(*[(F.min(c) - size / 2).alias(f"o{c}") for c in "xyz"])
    p = points.join(low, "scan_id")
    return p.groupBy("scan_id", *[F.floor((F.col(c) - F.col(f"o{c}")) / size).cast("long").alias(f"i{c}") for c in "xyz"]).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n"))


def voxel_iou(points: DataFrame, pairs: DataFrame, size: float = 0.05) -> DataFrame:
    """JOI-33: occupied cells in common over occupied cells, for ``pairs`` (``scan_id, a, b``) of labels; 0 if empty."""
    cells = points.select("scan_id", "label", *[cell(c, size).alias(f"i{c}") for c in "xyz"]).distinct()
    sizes = cells.groupBy("scan_id", "label").agg(F.count("*").alias("n"))
    a = pairs.join(cells.withColumnRenamed("label", "a"), ["scan_id", "a"])
    common = a.join(cells.withColumnRenamed("label", "b"), ["scan_id", "b", "ix", "iy", "iz"]).groupBy("scan_id", "a", "b").agg(F.count("*").alias("common"))
    x = pairs.join(sizes.select("scan_id", F.col("label").alias("a"), F.col("n").alias("na")), ["scan_id", "a"], "left").join(sizes.select("scan_id", F.col("label").alias("b"), F.col("n").alias("nb")), ["scan_id", "b"], "left").join(common, ["scan_id", "a", "b"], "left").fillna(0, ["na", "nb", "common"])
    union = F.col("na") + F.col("nb") - F.col("common")
    return x.select("scan_id", "a", "b", F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("iou"))


def nearest_within(source: DataFrame, target: DataFrame, radius: float, block: int = 16) -> DataFrame:
    """JOI-13: every source point's distance to the nearest target point of its scan, null beyond ``radius``.

    Points are shuffled by blocks ``block`` radii wide: a source point once, a target point also to the neighbours whose rim it lies in. Source rows
    with one ``row_id`` all have the least of their distances."""
    width, reach = block * radius, radius * (1 + 1e-9)
    kind, axes = dict(source.dtypes)["row_id"], [F.col(c).cast("double").alias(c) for c in "xyz"]
    s = source.select("scan_id", *[cell(F.col(c).cast("double"), width).alias(f"i{c}") for c in "xyz"], F.lit(0).alias("side"), F.col("row_id").alias("s"), *axes)
    t = target.select("scan_id", *axes).where(" AND ".join(f"abs({c}) < double('infinity')" for c in "xyz"))
    for c in "xyz":
        t = t.withColumn(f"i{c}", F.explode(F.sequence(cell(F.col(c) - reach, width), cell(F.col(c) + reach, width))))
    t = t.select("scan_id", "ix", "iy", "iz", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("s"), *"xyz")

    def solve(rows, at):
        side, points = rows.column("side").to_numpy(), grouped.numbers(rows, ["x", "y", "z"])
        mine = np.flatnonzero(side == 0)
        d = np.full(len(side), np.inf)
        for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
            half = low + int(np.searchsorted(side[low:high], 1))
            if low < half < high:
                d[low:half] = sparse.Grid(points[half:high], radius).nearest(points[low:half])[1]
        group = np.repeat(np.arange(len(at) - 1), np.diff(at))[mine]
        return {"group": group, "s": rows.column("s").take(pa.array(mine)), "d": pa.array(d[mine], mask=~(d[mine] <= radius))}

    found = grouped.whole_groups(s.unionByName(t), ["scan_id", "ix", "iy", "iz"], ["side"], solve, f"s {kind}, d double")
    return found.select("scan_id", "s", F.min("d").over(Window.partitionBy("scan_id", "s")).alias("d"))


def surface_metrics(forward: DataFrame, backward: DataFrame, threshold: float, trim: float = 0.9) -> DataFrame:
    """AGG-31..35: per scan overlaps both ways (share within ``threshold``, strictly), their least, F-score,
    the mean of the nearest ``trim`` of the distances found, their median and 90th percentile; distances
    beyond the search radius count as misses."""

    def one(df, name):
        rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.col("d").asc_nulls_last(), "s"))
        n = F.count("d").over(Window.partitionBy("scan_id"))
        x = df.withColumn("keep", F.greatest(F.floor(n * F.lit(trim)), F.lit(1))).withColumn("k", rank)
        return x.groupBy("scan_id").agg(
            F.avg(F.coalesce((F.col("d") < threshold).cast("double"), F.lit(0.0))).alias(f"{name}_overlap"), F.avg(F.when(F.col("k") <= F.col("keep"), F.col("d"))).alias(f"{name}_trimmed"),
            F.median("d").alias(f"{name}_median"), F.percentile("d", F.lit(0.9)).alias(f"{name}_p90"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias(f"{name}_rmse"),
        )

    x = one(forward, "forward").join(one(backward, "backward"), "scan_id")
    p, r = F.col("forward_overlap"), F.col("backward_overlap")
    return x.withColumn("least_overlap", F.least(p, r)).withColumn("f_score", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def overlap_ratio(source: DataFrame, target: DataFrame, radius: float = 1e-7) -> DataFrame:
    """JOI-15, JOI-16, SET-05: share of a scan's distinct source positions that occur in the target on a grid of ``radius``; 4 digits."""
    keys = [F.rint(F.col(c) / radius).cast("long").alias(f"i{c}") for c in "xyz"]
    s, t = source.select("scan_id", *keys).distinct(), target.select("scan_id", *keys).distinct().withColumn("hit", F.lit(1))
    return s.join(t, ["scan_id", "ix", "iy", "iz"], "left").groupBy("scan_id").agg(F.count("*").alias("n"), F.bround(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("overlap"))


def grid_membership(picked: DataFrame, raw: DataFrame, grid: float = 0.001) -> DataFrame:
    """JOI-31: picked points to raw rows on a millimetre grid: ``status`` is one, missing or ambiguous."""
    key = [F.rint(F.col(c) / grid).cast("long").alias(f"i{c}") for c in "xyz"]
    r = raw.select("scan_id", *key, "row_id").groupBy("scan_id", "ix", "iy", "iz").agg(F.count("*").alias("n"), F.min("row_id").alias("raw_row"))
    p = picked.select("scan_id", F.col("row_id").alias("picked"), *key).join(r, ["scan_id", "ix", "iy", "iz"], "left")
    return p.select("scan_id", "picked", F.when(F.col("n") == 1, F.col("raw_row")).alias("raw_row"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("one").alias("status"))


def box_neighbours(points: DataFrame, padding: float) -> DataFrame:
    """JOI-20: labels of a scan whose padded boxes overlap; as many boxes as objects, joined within the scan."""
    b = points.groupBy("scan_id", "label").agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    a, c = b.select("scan_id", *[F.col(k).alias(f"a_{k}") for k in b.columns[1:]]), b.select("scan_id", *[F.col(k).alias(f"b_{k}") for k in b.columns[1:]])
    x = a.join(c, "scan_id").where("a_label <> b_label")
    for k in "xyz":
        x = x.where((F.col(f"a_lo{k}") - padding <= F.col(f"b_hi{k}")) & (F.col(f"b_lo{k}") <= F.col(f"a_hi{k}") + padding))
    return x.select("scan_id", F.col("a_label").alias("label"), F.col("b_label").alias("neighbour"))


def nearest_objects(centres: DataFrame, k: int = 4) -> DataFrame:
    """JOI-21, CMP-27: canonical edges (low, high) to the k nearest centres of the same scan."""
    a = centres.select("scan_id", F.col("label").alias("a"), *[F.col(f"c{c}").alias(f"a{c}") for c in "xyz"])
    b = centres.select("scan_id", F.col("label").alias("b"), *[F.col(f"c{c}").alias(f"b{c}") for c in "xyz"])
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "yz"), (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")))
    x = a.join(b, "scan_id").where("a <> b").withColumn("d2", F.round(d2, 9))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("scan_id", "a").orderBy("d2", "b"))).where(F.col("rank") <= k)
    return x.select("scan_id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()


def layer_conflict(points: DataFrame) -> DataFrame:
    """AGG-36, AGG-37: share of (x, z) 3 cm columns with two occupied 2 cm levels that lie 2 to 6 levels apart."""
    c = points.select("scan_id", cell("x", 0.03).alias("ix"), cell("z", 0.03).alias("iz"), cell("y", 0.02).alias("level")).distinct()
    # levels in order: some pair is 2..6 apart iff a level within 6 below isn't the next one down
    w = Window.partitionBy("scan_id", "ix", "iz").orderBy("level").rangeBetween(-6, -2)
    bad = c.withColumn("bad", F.count("*").over(w) > 0)
    return bad.groupBy("scan_id", "ix", "iz").agg(F.bool_or("bad").alias("bad")).groupBy("scan_id").agg(F.count("*").alias("columns"), F.avg(F.col("bad").cast("double")).alias("conflict"))


def decimate(points: DataFrame, keep: int) -> DataFrame:
    """WIN-18: rows at floor(i (n - 1) / (keep - 1)) of a label's rows in order; all of them if they are no more."""
    w = Window.partitionBy("scan_id", "label")
    x = points.withColumn("at", F.row_number().over(w.orderBy("row_id")) - 1).withColumn("n", F.count("*").over(w))
    # row `at` is kept iff some i gives it: the smallest i that reaches it gives exactly it
    i = F.ceil(F.col("at") * (keep - 1) / (F.col("n") - 1))
    hit = F.floor(i * (F.col("n") - 1) / (keep - 1)) == F.col("at")
    return x.where((F.col("n") <= keep) | hit).select(points.columns)


def normalised_cloud(points: DataFrame) -> DataFrame:
    """FUN-18: centred, and scaled to a largest radius of 1 (a single position stays at 0)."""
    w = Window.partitionBy("scan_id", "label")
    x = points
    for c in "xyz":
        x = x.withColumn(f"n{c}", F.col(c) - F.avg(c).over(w))
    r = F.max(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))).over(w)
    x = x.withColumn("radius", r)
    return x.select("scan_id", "label", "row_id", *[F.when(F.col("radius") > 0, F.col(f"n{c}") / F.col("radius")).otherwise(0.0).alias(c) for c in "xyz"])


def below_ceiling(points: DataFrame, margin: float = 1.0) -> DataFrame:
    """CMP-26: points more than ``margin`` below the scan's highest."""
    top = points.groupBy("scan_id").agg(F.max("z").alias("top"))
    return points.join(top, "scan_id").where(F.col("z") < F.col("top") - margin).select(points.columns)


def visible(points: DataFrame, fx: float, fy: float, cx: float, cy: float, width: int, height: int) -> DataFrame:
    """FUN-17: points in front of the camera that project into the frame, with pixel ``u, v``."""
    u, v = F.col("x") / F.col("z") * fx + cx, F.col("y") / F.col("z") * fy + cy
    return points.where("z > 0").withColumn("u", F.floor(u)).withColumn("v", F.floor(v)).where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))


def unproject(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float, stride: int = 4, near: float = 0.30, far: float = 4.50) -> DataFrame:
    """FUN-16: depth pixels (``frame_id, u, v, depth_m``) on a stride to camera points within the depth range."""
    p = pixels.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0) & F.col("depth_m").between(near, far))
    return p.select("frame_id", ((F.col("u") - cx) * F.col("depth_m") / fx).alias("x"), ((F.col("v") - cy) * F.col("depth_m") / fy).alias("y"), F.col("depth_m").alias("z"))


def spatial_support(centres: DataFrame) -> DataFrame:
    """AGG-09, AGG-10 (its eigenvalues): first and second singular value of a scan's centred centres, from the
    closed form for the eigenvalues of a symmetric 3 x 3 matrix; 0, 0 under three points."""
    m = {a + b: F.covar_pop(f"c{a}", f"c{b}").alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    x = centres.groupBy("scan_id").agg(F.count("*").alias("n"), *m.values())
    q = (F.col("xx") + F.col("yy") + F.col("zz")) / 3
    off = F.col("xy") * F.col("xy") + F.col("xz") * F.col("xz") + F.col("yz") * F.col("yz")
    x = x.withColumn("q", q).withColumn("p", F.sqrt(((F.col("xx") - q) * (F.col("xx") - q) + (F.col("yy") - q) * (F.col("yy") - q) + (F.col("zz") - q) * (F.col("zz") - q) + 2 * off) / 6))
    b = {k: (F.col(k) - F.col("q")) / F.col("p") for k in ("xx", "yy", "zz")} | {k: F.col(k) / F.col("p") for k in ("xy", "xz", "yz")}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    first = F.when(F.col("p") > 0, F.col("q") + 2 * F.col("p") * F.cos(phi)).otherwise(F.col("q"))
    third = F.when(F.col("p") > 0, F.col("q") + 2 * F.col("p") * F.cos(phi + 2 * 3.141592653589793 / 3)).otherwise(F.col("q"))
    value = lambda e: F.when(F.col("n") >= 3, F.sqrt(F.greatest(e, F.lit(0.0)) * F.col("n"))).otherwise(0.0)
    return x.select("scan_id", "n", value(first).alias("s1"), value(3 * F.col("q") - first - third).alias("s2"))
