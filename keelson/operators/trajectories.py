"""Time series of poses: binding, relative motion, loop edges, metrics.

Poses: ``sequence_id, ordinal, frame_id, timestamp_us, t`` (a transform). Windows are by sequence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import se3
from keelson.operators import grouped


def by_order():
    return Window.partitionBy("sequence_id").orderBy("ordinal")


def manifest_violations(frames: DataFrame, datasets: tuple[str, ...]) -> DataFrame:
    """VAL-01, STR-03: ``sequence_id, rule, rows`` for every rule that a sequence breaks: unknown dataset,
    empty or repeated frame id, timestamps that go back, missing or non-positive focal length."""
    w = Window.partitionBy("sequence_id").orderBy("ordinal")
    x = frames.withColumn("before", F.lag("timestamp_us").over(w)).withColumn("same", F.count("*").over(Window.partitionBy("sequence_id", "frame_id")))
    checks = {"dataset": ~F.col("dataset").isin(*datasets), "frame_id_empty": F.col("frame_id").isNull(), "frame_id_repeated": F.col("same") > 1, "time_goes_back": F.coalesce(F.col("timestamp_us") < F.col("before"), F.lit(False)), "focal_length": ~F.coalesce((F.col("fx") > 0) & ~F.isnan("fx"), F.lit(False))}
    found = x.select("sequence_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in checks.items()]))).alias("rule"))
    return found.groupBy("sequence_id", "rule").agg(F.count("*").alias("rows"))


def guard_empty(violations: DataFrame, message: str) -> DataFrame:
    """SEM-02: an error when the frame has a row; no row otherwise."""
    return violations.where(F.raise_error(F.concat(F.lit(message + ": "), F.to_json(F.struct("*")))).isNotNull())


def bind(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """JOI-01, CMP-23: every pose with its frame: ``status`` is bound, missing_frame, time_mismatch or repeated;
    the trajectory's order stays in ``ordinal``."""
    f = frames.groupBy("sequence_id", "frame_id").agg(F.min("timestamp_us").alias("frame_us"), F.count("*").alias("frames"))
    x = poses.withColumn("times", F.count("*").over(Window.partitionBy("sequence_id", "frame_id"))).join(f, ["sequence_id", "frame_id"], "left")
    status = F.when(F.col("frames").isNull(), "missing_frame").when((F.col("frames") > 1) | (F.col("times") > 1), "repeated").when(F.col("frame_us") != F.col("timestamp_us"), "time_mismatch").otherwise("bound")
    return x.withColumn("status", status).drop("frames", "times", "frame_us")


def uncovered(frames: DataFrame, poses: DataFrame, most: int = 10) -> DataFrame:
    """CMP-23: per sequence how many frames have no pose, and the first ``most`` of them."""
    gone = frames.join(poses, ["sequence_id", "frame_id"], "left_anti")
    r = F.row_number().over(Window.partitionBy("sequence_id").orderBy("frame_id"))
    return gone.withColumn("r", r).groupBy("sequence_id").agg(F.count("*").alias("missing"), F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col("frame_id")))).alias("first_missing"))


def relative_steps(poses: DataFrame, forward: bool = False) -> DataFrame:
    """WIN-06 (lag), WIN-08 (lead): the transform from the previous pose to this one, or from this to the next."""
    other = (F.lead if forward else F.lag)("t").over(by_order())
    a, b = (F.col("t"), F.col("other")) if forward else (F.col("other"), F.col("t"))
    return poses.withColumn("other", other).where("other IS NOT NULL").withColumn("step", se3.compose(se3.inverse(a), b)).drop("other")


def anchors(poses: DataFrame, stride: int) -> DataFrame:
    """WIN-07: every stride-th pose and the last."""
    last = F.max("ordinal").over(Window.partitionBy("sequence_id"))
    return poses.withColumn("last", last).where((F.col("ordinal") % stride == 0) | (F.col("ordinal") == F.col("last"))).drop("last")


def loop_pairs(anchor_poses: DataFrame, gap: int, radius: float, cap: int = 36) -> DataFrame:
    """JOI-08: anchors of a sequence at least ``gap`` ordinals apart within ``radius`` metres, nearest first
    (then the larger gap, then ids), ``cap`` a sequence. Joined on grid cells of the radius, not all pairs."""
    size = F.lit(float(radius))
    p = anchor_poses.select("sequence_id", "ordinal", *[se3.at("t", i, 3).alias(c) for i, c in enumerate("xyz")])
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = p.select("sequence_id", F.col("ordinal").alias("source"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    for c in "xyz":
        a = a.withColumn("d", F.explode(near)).withColumn(f"i{c}", F.floor(F.col(f"a{c}") / size) + F.col("d")).drop("d")
    b = p.select("sequence_id", F.col("ordinal").alias("target"), *[F.floor(F.col(c) / size).alias(f"i{c}") for c in "xyz"], *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "yz"), (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")))
    x = a.join(b, ["sequence_id", "ix", "iy", "iz"]).where(F.col("target") >= F.col("source") + gap).withColumn("distance", F.round(F.sqrt(d2), 9)).where(F.col("distance") <= radius)
    w = Window.partitionBy("sequence_id").orderBy("distance", F.col("source") - F.col("target"), "source", "target")
    return x.withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap).select("sequence_id", "source", "target", "distance", "position")


def best_edges(edges: DataFrame) -> DataFrame:
    """WIN-10: one edge for each unordered pair, by weight, then provenance, then position; the others get a reason."""
    w = Window.partitionBy("sequence_id", F.least("source", "target"), F.greatest("source", "target")).orderBy(F.col("weight").desc(), F.col("provenance").desc(), "pos")
    return edges.withColumn("reason", F.when(F.row_number().over(w) > 1, "duplicate_pair"))


def degree_capped(edges: DataFrame, degree: int, carry: list[str] | None = None) -> DataFrame:
    """WIN-11: edges taken in order (weight down, ends, provenance) while both ends have fewer than ``degree``; columns ``carry`` come along.

    Each choice hangs on those before, so a graph is one group: its loop edges, which :func:`loop_pairs` caps."""
    carry = carry or []
    ends = [F.col(c).cast("int").alias(c) for c in ("source", "target")]
    x = edges.select("sequence_id", *ends, F.col("weight").cast("double").alias("weight"), F.least("source", "target").alias("_lo"), F.greatest("source", "target").alias("_hi"), F.coalesce(-F.col("weight").cast("double"), F.lit(float("nan"))).alias("_neg"), F.col("provenance").isNull().alias("_none"), "provenance", *carry)

    def solve(rows, at):
        group, keep = np.repeat(np.arange(len(at) - 1), np.diff(at)), []
        used: dict[tuple, int] = {}
        for g, a, b in zip(group.tolist(), rows.column("source").to_pylist(), rows.column("target").to_pylist()):
            ok = used.get((g, a), 0) < degree and used.get((g, b), 0) < degree
            keep.append(ok)
            if ok:
                used[g, a], used[g, b] = used.get((g, a), 0) + 1, used.get((g, b), 0) + 1
        return {"group": group} | {c: rows.column(c) for c in ("source", "target", "weight", *carry)} | {"accepted": keep}

    more = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for c in carry for f in [edges.schema[c]])
    return grouped.whole_groups(x, ["sequence_id"], ["_neg", "_lo", "_hi", "_none", "provenance"], solve, f"source int, target int, weight double, {more}accepted boolean")


def loop_weight(overlap: Column, span: Column) -> Column:
    """FUN-09: overlap / 0.35 within 0.7 to 1.5; long loops (over half the anchors) are capped at 1."""
    base = F.least(F.greatest(overlap / 0.35, F.lit(0.7)), F.lit(1.5))
    return F.when(span > 0.5, F.least(base, F.lit(1.0))).otherwise(base)


def interpolated(poses: DataFrame, corrections: DataFrame) -> DataFrame:
    """WIN-09 for planar motion: ``yaw, x, y`` of the corrections (``sequence_id, ordinal, ...`` at anchors),
    linear between the anchors before and after, held beyond the outermost ones. Sequences without anchors get nulls."""
    before = Window.partitionBy("sequence_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("sequence_id").orderBy("ordinal").rowsBetween(0, Window.unboundedFollowing)
    c = corrections.select("sequence_id", "ordinal", F.struct(F.col("ordinal").alias("o"), "yaw", "x", "y").alias("c"))
    x = poses.select("sequence_id", "ordinal").join(c, ["sequence_id", "ordinal"], "left")
    x = x.withColumn("lo", F.last("c", ignorenulls=True).over(before)).withColumn("hi", F.first("c", ignorenulls=True).over(after))
    x = x.withColumn("lo", F.coalesce("lo", "hi")).withColumn("hi", F.coalesce("hi", "lo"))
    a = F.when(F.col("hi.o") > F.col("lo.o"), (F.col("ordinal") - F.col("lo.o")) / (F.col("hi.o") - F.col("lo.o"))).otherwise(0.0)
    return x.select("sequence_id", "ordinal", *[(F.col(f"lo.{k}") + a * (F.col(f"hi.{k}") - F.col(f"lo.{k}"))).alias(k) for k in ("yaw", "x", "y")])


def describe(df: DataFrame, key: str, value: str, prefix: str = "") -> DataFrame:
    """AGG-11: count, median, mean, rmse, p95, max; all null (``available`` false) without values."""
    v = F.col(value)
    return df.groupBy(key).agg(F.count(v).alias(f"{prefix}count"), (F.count(v) > 0).alias(f"{prefix}available"), F.median(v).alias(f"{prefix}median"), F.avg(v).alias(f"{prefix}mean"), F.sqrt(F.avg(v * v)).alias(f"{prefix}rmse"), F.percentile(v, F.lit(0.95)).alias(f"{prefix}p95"), F.max(v).alias(f"{prefix}max"))


def trajectory_errors(estimate: DataFrame, reference: DataFrame) -> DataFrame:
    """AGG-11, CMP-04: per common frame the rotation and translation error; ``covered`` is false for frames
    that only the estimate has. Frames of the reference that the estimate lacks are in :func:`uncovered`."""
    x = estimate.select("sequence_id", "frame_id", "ordinal", F.col("t").alias("est")).join(reference.select("sequence_id", "frame_id", F.col("t").alias("ref")), ["sequence_id", "frame_id"], "left")
    return x.select("sequence_id", "frame_id", "ordinal", F.col("ref").isNotNull().alias("covered"), se3.rotation_distance("est", "ref").alias("rre"), se3.translation_distance("est", "ref").alias("rte"))


def rebased(reference: DataFrame) -> DataFrame:
    """CMP-21, CMP-22: valid reference poses in the frame of the sequence's first valid one."""
    ok = reference.where(se3.is_valid("t"))
    first = F.first("t").over(Window.partitionBy("sequence_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    return ok.withColumn("t", se3.compose(se3.inverse(first), F.col("t")))


def edge_outcomes(edges: DataFrame, reference: DataFrame) -> DataFrame:
    """JOI-22: accepted loop edges (``source, target, t``) against the reference's relative pose; an edge without
    both reference poses is unevaluable, never safe."""
    r = lambda end: reference.select("sequence_id", F.col("ordinal").alias(end), F.col("t").alias(f"{end}_t"))
    x = edges.join(r("source"), ["sequence_id", "source"], "left").join(r("target"), ["sequence_id", "target"], "left")
    x = x.withColumn("true", F.when(F.col("source_t").isNotNull() & F.col("target_t").isNotNull(), se3.compose(se3.inverse("source_t"), "target_t")))
    rre, rte = se3.rotation_distance("t", "true"), se3.translation_distance("t", "true")
    return x.select("sequence_id", "source", "target", rre.alias("rre"), rte.alias("rte"), F.when(F.col("true").isNull(), "unevaluable").when(se3.grade(rre, rte)[2], "catastrophic").otherwise("safe").alias("outcome"))


def submap_members(poses: DataFrame, anchor_poses: DataFrame, reach: int = 20, stride: int = 4) -> DataFrame:
    """AGG-47, its join: frames within ``reach`` ordinals of an anchor on a stride, the anchor itself always, with
    the transform into the anchor's frame. A band join, turned into an equi join by listing the ordinals."""
    offsets = sorted({*range(-reach, reach + 1, stride), 0})
    a = anchor_poses.select("sequence_id", F.col("ordinal").alias("anchor"), F.col("t").alias("anchor_t")).withColumn("ordinal", F.explode(F.transform(F.array(*[F.lit(o) for o in offsets]), lambda o: (F.col("anchor") + o).cast("int"))))
    return a.join(poses.select("sequence_id", "ordinal", "t"), ["sequence_id", "ordinal"]).select("sequence_id", "anchor", "ordinal", se3.compose(se3.inverse("anchor_t"), "t").alias("into_anchor"))


def replay_summary(responses: DataFrame) -> DataFrame:
    """STR-01 in batch: per sequence how many frames were answered and tracked (valid pose), and the latency's median and p95."""
    ok = F.when(F.col("tracked"), F.col("latency"))
    return responses.groupBy("sequence_id").agg(F.count("*").alias("frames"), F.count_if("tracked").alias("tracked"), F.median(ok).alias("median_latency"), F.percentile(ok, F.lit(0.95)).alias("p95_latency"))


#: Rows of a replay without a null where one isn't defined.
WHOLE = "sequence_id IS NOT NULL AND frame IS NOT NULL AND kind IS NOT NULL AND at_us IS NOT NULL"


def replay_outcomes(rows: DataFrame, patience_us: int) -> DataFrame:
    """STR-01: what became of each frame: ``sequence_id, frame, status, latency_us``. ``rows``: ``sequence_id, frame, kind`` (request or answer),
    ``at_us, tracked``; a frame is asked for once, of several answers the earliest counts.

    ``tracked`` or ``lost`` if the answer came within ``patience_us``, else ``timeout``; ``unasked`` for an answer without a request. Only
    answered frames have a latency. Rows with a null id, frame, kind or time don't count."""
    asked = F.max(F.when(F.col("kind") == "request", F.col("at_us"))).alias("asked")
    first = F.min(F.when(F.col("kind") != "request", F.struct(F.col("at_us"), F.coalesce("tracked", F.lit(False)).alias("tracked")))).alias("answer")
    x = rows.where(WHOLE).groupBy("sequence_id", "frame").agg(asked, first).withColumn("wait", F.col("answer.at_us") - F.col("asked"))
    good = F.coalesce(F.col("wait").between(0, patience_us), F.lit(False))
    status = F.when(F.col("asked").isNull(), "unasked").when(~good, "timeout").when(F.col("answer.tracked"), "tracked").otherwise("lost")
    return x.select("sequence_id", "frame", status.alias("status"), F.when(good, F.col("wait")).alias("latency_us"))


def running(df: DataFrame, value: str, n: int) -> DataFrame:
    """AGG-45: sum, mean, population deviation over the last n rows of a sequence."""
    w = Window.partitionBy("sequence_id").orderBy("ordinal").rowsBetween(-(n - 1), 0)
    return df.select("sequence_id", "ordinal", F.sum(value).over(w).alias("sum"), F.avg(value).over(w).alias("mean"), F.stddev_pop(value).over(w).alias("std"))


def accumulated_subscans(frames: DataFrame, threshold: int) -> DataFrame:
    """STR-02: seen points are gathered over a sequence's frames; when they reach ``threshold`` a subscan ends and
    the set starts anew; the unfinished rest is dropped. ``sequence_id, ordinal, points array<long>``.

    The state is carried from frame to frame, so a sequence is one group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[int] = set()
        first, out = None, []
        for o, pts in pdf.sort_values("ordinal")[["ordinal", "points"]].itertuples(index=False):
            first = o if first is None else first
            seen.update(pts)
            if len(seen) >= threshold:
                out.append((pdf["sequence_id"].iloc[0], len(out), first, o, len(seen)))
                seen, first = set(), None
        return pd.DataFrame(out, columns=["sequence_id", "subscan", "first", "last", "points"])

    return frames.groupBy("sequence_id").applyInPandas(one, "sequence_id long, subscan int, first int, last int, points int")
