"""Decisions that are put together from the other operators, and what is checked about them afterwards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators import consensus as C
from keelson.operators import grouped


class Staged:
    """Groups' records in numpy, sorted by direction and replicate: which rows are whose, and their distances."""

    def __init__(self, rows: pa.Table, at: np.ndarray, keys: list[str]):
        self.rows, self.signature = rows, rows.column("signature").to_numpy()
        self.t, self.turned, self.shifted = C.transforms_of(rows)
        first = grouped.starts(rows, [*keys, "direction"])
        self.sides = np.r_[first, rows.num_rows]  # of a group and direction
        self.group_of = np.searchsorted(at, first, "right") - 1
        name = rows.column("direction").take(pa.array(first)).to_numpy(zero_copy_only=False)
        self.side_of = np.repeat(np.arange(len(first)), np.diff(self.sides))
        self.ends = {}  # of a group: which of its sides is forward, reverse; -1 for none
        for d in ("forward", "reverse"):
            self.ends[d] = np.full(len(at) - 1, -1)
            self.ends[d][self.group_of[name == d]] = np.flatnonzero(name == d)

    def judged(self, deg: float, m: float, quorum: int, rival: int | None, left_out: bool = False):
        """Of each side (or each row: of its side without it) what it lacks (n x 3) and its medoid's row."""
        n = self.rows.num_rows if left_out else len(self.sides) - 1
        lacks, medoid = np.ones((n, 3), bool), np.zeros(n, int)
        for g, _, place, dr, dt, known in C._of_size(self.rows, self.sides, "replicate"):
            share = np.where(known, dr / deg + dt / m, 0.0)
            for out in range(place.shape[1]) if left_out else [None]:
                at = np.arange(place.shape[1]) if out is None else np.delete(np.arange(place.shape[1]), out)
                if len(at):
                    pick = np.ix_(np.arange(len(g)), at, at)
                    _, bad, best = C.verdicts(C.clique_table(dr[pick], dt[pick], deg, m), share[pick], self.signature[place[:, at]], quorum, rival)
                    to = g if out is None else place[:, out]
                    lacks[to], medoid[to] = bad, place[np.arange(len(g)), at[best]]
        return lacks, medoid

    def crossed(self, f: np.ndarray, r: np.ndarray, deg: float, m: float) -> np.ndarray:
        """SE3-06 of rows f and r: whether rotation, translation are beyond the bounds (n x 2); not if they are null."""
        a, b = self.t[f], self.t[r]
        rot = C._cos_deg(sum(a[:, i, k] * b[:, k, i] for i in range(3) for k in range(3)))
        shift = np.sqrt(sum((sum(a[:, i, k] * b[:, k, 3] for k in range(3)) + a[:, i, 3]) ** 2 for i in range(3)))
        known = self.turned[f] & self.turned[r], self.turned[f] & self.shifted[f] & self.shifted[r]
        return np.stack([known[0] & ~(rot <= deg), known[1] & ~(shift <= m)], axis=1)


def _staged(workers: DataFrame, keys: list[str], solve, schema: str) -> DataFrame:
    rows = workers.select(*keys, "direction", "replicate", F.col("signature").cast("long").alias("signature"), "transform")
    return grouped.whole_groups(rows, keys, ["direction", "replicate"], lambda rows, at: solve(Staged(rows, at, keys), len(at) - 1), schema)


def _verdict(x: Staged, groups: int, deg: float, m: float, quorum: int, rival: int | None, cross_deg: float, cross_m: float):
    """Of each group whether it is usable, its forward medoid's row and what is missing (both directions, n x 4), lacking (n x 6) and crossing (n x 2)."""
    lacks, medoid = x.judged(deg, m, quorum, rival)
    have = [x.ends[d] >= 0 for d in ("forward", "reverse")]
    bad = [np.where(h[:, None], lacks[x.ends[d]], False) for h, d in zip(have, ("forward", "reverse"))]
    both = have[0] & have[1] & ~bad[0].any(axis=1) & ~bad[1].any(axis=1)
    f, r = medoid[x.ends["forward"]], medoid[x.ends["reverse"]]
    cross = both[:, None] & x.crossed(f, r, cross_deg, cross_m)
    faults = np.concatenate([bad[0], ~have[0][:, None], bad[1], ~have[1][:, None], cross], axis=1)
    return ~faults.any(axis=1), f, faults


REASONS = [*[f"{d}:{c}" for d in ("forward", "reverse") for c in [*C.CODES.tolist(), "missing"]], "cross:rotation", "cross:translation"]


def stage_order(workers: DataFrame, keys: list[str], deg: float = 5.0, m: float = 0.10, quorum: int = 4, rival: int | None = None, cross_deg: float = 5.0, cross_m: float = 0.20) -> DataFrame:
    """CLU-07, CLU-19, CLU-20: each direction's cluster and medoid, then forward against backward. One row a group with
    all reasons in order: per direction what its cluster lacks, then whether the medoids undo each other (SE3-06); a
    direction without records is a reason, never a pass. ``transform`` is the forward medoid's, of usable groups only.
    A record is shuffled once, and a task works on many groups together."""

    def solve(x, n):
        good, f, faults = _verdict(x, n, deg, m, quorum, rival, cross_deg, cross_m)
        kinds, kind = np.unique(faults, axis=0, return_inverse=True)
        reasons = pa.array([[c for c, on in zip(REASONS, k) if on] for k in kinds.tolist()], pa.list_(pa.string())).take(pa.array(kind.ravel()))
        transform = x.rows.column("transform").combine_chunks().take(pa.array(f, mask=~good))
        return {"group": np.arange(n), "usable": good, "reasons": reasons, "transform": transform.cast(pa.list_(pa.float64()))}

    return _staged(workers, keys, solve, "usable boolean, reasons array<string>, transform array<double>")


def stability(workers: DataFrame, keys: list[str], deg: float = 5.0, m: float = 0.10, quorum: int = 4, drift_deg: float = 1.0, drift_m: float = 0.02, rival: int | None = None, cross_deg: float = 5.0, cross_m: float = 0.20) -> DataFrame:
    """CLU-08, WIN-19: a group is stable if it is usable, stays so (with one member less in the quorum) whichever record is
    left out, and no scenario's transform drifts further than the bounds. A group of one record has one scenario, with
    nothing left in it: not usable. A record left out changes its own direction only, so the other one is judged once; no copy of a group is a row."""

    def solve(x, n):
        whole, first, _ = _verdict(x, n, deg, m, quorum, rival, cross_deg, cross_m)
        (lacks, medoid), (less, other) = x.judged(deg, m, quorum - 1, rival), x.judged(deg, m, quorum - 1, rival, left_out=True)
        group, holds, ends = x.group_of[x.side_of], np.ones(len(x.side_of), bool), []
        for d in ("forward", "reverse"):
            side = x.ends[d][group]
            own = side == x.side_of
            holds &= (side >= 0) & ~np.where(own[:, None], less, lacks[side]).any(axis=1)
            ends.append(np.where(own, other, medoid[side]))
        holds &= ~x.crossed(*ends, cross_deg, cross_m).any(axis=1)
        deg_off, m_off = C.distances(x.t[ends[0]], x.t[first[group]])
        known = [(k[ends[0]] & k[first[group]]) for k in (x.turned, x.shifted)]
        still = holds & whole[group] & known[0] & known[1] & (deg_off <= drift_deg) & (m_off <= drift_m)
        count = lambda on: np.bincount(group, on, n).astype(np.int64)
        scenarios, usable, steady = np.bincount(group, minlength=n), count(holds), count(still)
        return {"group": np.arange(n), "scenarios": scenarios, "usable_scenarios": usable, "still": steady, "usable": whole, "stable": whole & (usable == scenarios) & (steady == scenarios)}

    return _staged(workers, keys, solve, "scenarios long, usable_scenarios long, still long, usable boolean, stable boolean")


def policies(workers: DataFrame, keys: list[str], named: dict[str, dict]) -> DataFrame:
    """CLU-09: the verdict of every policy (arguments of :func:`stage_order`) on every group: ``policy, usable``."""
    standard = {"deg": 5.0, "m": 0.10, "quorum": 4, "rival": None, "cross_deg": 5.0, "cross_m": 0.20}

    def solve(x, n):
        good = [_verdict(x, n, **(standard | arguments))[0] for arguments in named.values()]
        return {"group": np.repeat(np.arange(n), len(named)), "policy": list(named) * n, "usable": np.stack(good, axis=1).ravel()}

    return _staged(workers, keys, solve, "policy string, usable boolean")


def top1_f1(ranked: DataFrame, anchors: DataFrame, requested: DataFrame, failed_as_zero: bool = True) -> DataFrame:
    """CMP-13, CMP-14: per requested pair the F1 of each source's best reference node. A pair without ranks counts 0, or
    has no metric with ``failed_as_zero`` off. ``ranked``: ``pair_id, a, b, rank``."""
    pick = ranked.where("rank = 1").select("pair_id", F.col("a").alias("s"), F.col("b").alias("r"))
    hit = pick.join(anchors, ["pair_id", "s", "r"], "left_semi").groupBy("pair_id").agg(F.count("*").alias("tp"))
    n, k = pick.groupBy("pair_id").agg(F.count("*").alias("picked")), anchors.groupBy("pair_id").agg(F.count("*").alias("anchors"))
    x = requested.select("pair_id").distinct().join(n, "pair_id", "left").join(k, "pair_id", "left").join(hit, "pair_id", "left")
    tp = F.coalesce("tp", F.lit(0))
    p, r = tp / F.greatest(F.col("picked"), F.lit(1)), tp / F.greatest(F.coalesce("anchors", F.lit(0)), F.lit(1))
    f1 = F.when(F.col("picked").isNull(), F.lit(0.0) if failed_as_zero else F.lit(None).cast("double")).when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return x.select("pair_id", f1.alias("f1"), F.col("picked").isNull().alias("failed"))


def derived_decision(outcomes: DataFrame, stored: DataFrame, group: str, needed: int) -> DataFrame:
    """CMP-15, CMP-16: the verdict worked out anew from a group's outcomes (accepted iff ``needed`` of them pass and
    none is vetoed), against the stored one; null-safe. ``group, passed, vetoed``; ``group, verdict``."""
    x = outcomes.groupBy(group).agg(F.count_if("passed").alias("passes"), F.count_if("vetoed").alias("vetoes"))
    x = x.withColumn("derived", F.when((F.col("passes") == needed) & (F.col("vetoes") == 0), "accepted").otherwise("rejected"))
    return x.join(stored.select(group, F.col("verdict").alias("stored")), group, "full").withColumn("agrees", F.col("derived").eqNullSafe(F.col("stored")))


def by_ordinals(rows: DataFrame, key: str, ordinals: list[int]) -> DataFrame:
    """CMP-17: the rows at fixed places of the order by ``ordinal``; ``found`` is false for a place that no row or
    several rows have."""
    want = rows.sparkSession.createDataFrame([(o,) for o in ordinals], "ordinal long")
    n = rows.groupBy("ordinal").agg(F.count("*").alias("n"), F.min(key).alias(key))
    return want.join(n, "ordinal", "left").select("ordinal", F.when(F.col("n") == 1, F.col(key)).alias(key), (F.coalesce("n", F.lit(0)) == 1).alias("found"))


def bag_strict(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """FUN-19: counts by vocabulary slot; a word outside it is an error. ``key, name``; ``name, slot``."""
    x = words.join(vocabulary, "name", "left")
    slot = F.when(F.col("slot").isNull(), F.raise_error(F.concat(F.lit("unknown word "), F.col("name"))).cast("int")).otherwise(F.col("slot"))
    return x.select("key", slot.alias("slot")).groupBy("key", "slot").agg(F.count("*").alias("n"))


def assignment_features(weights: DataFrame) -> DataFrame:
    """FUN-03, its features: per pair from ``pair_id, s, r, sim, weight`` the sizes, the best similarities' mean, the
    share of sources whose best is mutual, and the mean and largest weight of the best."""
    f, g = Window.partitionBy("pair_id", "s").orderBy(F.col("weight").desc(), "r"), Window.partitionBy("pair_id", "r").orderBy(F.col("weight").desc(), "s")
    x = weights.withColumn("fwd", F.row_number().over(f)).withColumn("rev", F.row_number().over(g))
    best = lambda c: F.when(F.col("fwd") == 1, F.col(c))
    return x.groupBy("pair_id").agg(F.count_distinct("s").alias("sources"), F.count_distinct("r").alias("references"), F.avg(best("sim")).alias("best_sim"), F.avg(F.when(F.col("fwd") == 1, (F.col("rev") == 1).cast("double"))).alias("mutual"), F.avg(best("weight")).alias("best_weight"), F.max("weight").alias("top_weight"))


def budget(features: DataFrame, coefficients: dict[str, float], intercept: float, least: int, most: Column) -> DataFrame:
    """FUN-03: a linear budget over features, rounded half to even, within least and most."""
    raw = F.lit(intercept)
    for name, c in coefficients.items():
        raw = raw + F.col(name) * c
    return features.withColumn("budget", F.greatest(F.lit(least), F.least(F.bround(raw, 0).cast("long"), most)))


def ordered_clusters(candidates: DataFrame, compatible: DataFrame, key: str, by_degree: bool = True, most: int | None = None) -> DataFrame:
    """CLU-14: candidates by falling degree, then id; each opens a cluster that takes every later free candidate which
    is compatible with all of its members. CLU-13: by id alone (``by_degree`` off), and all after the first ``most``
    clusters are merged into one residual. ``key, id``; ``key, a, b``. A pair's candidates are one group."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near: dict = {int(i): set() for i in left["id"]}
        for a, b in zip(right["a"], right["b"]):
            if a in near and b in near:
                near[a].add(int(b))
                near[b].add(int(a))
        free, out, place = sorted(near, key=lambda i: (-len(near[i]) * by_degree, i)), [], 0
        while free:
            got = [free[0]]
            for i in free[1:]:
                if all(i in near[g] for g in got):
                    got.append(i)
            out.append((left[key].iloc[0], place, len(got), sorted(got)))
            free = [i for i in free if i not in got]
            place += 1
        if most is not None and len(out) > most:
            rest = sorted(i for row in out[most:] for i in row[3])
            out[most:] = [(left[key].iloc[0], most, len(rest), rest)]
        return pd.DataFrame(out, columns=[key, "cluster", "size", "members"])

    return candidates.groupBy(key).cogroup(compatible.groupBy(key)).applyInPandas(one, f"{key} long, cluster int, size int, members array<long>")


def hull_vertices(p: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Indices of a cloud's convex hull's vertices, built up facet by facet; all rows of flat or tiny clouds."""
    p = p - p.mean(axis=0)
    scale = max(1.0, float(np.abs(p).max())) if len(p) else 1.0
    if len(p) < 5 or np.linalg.matrix_rank(p, tol=tolerance * scale * len(p)) < 3:
        return np.arange(len(p))
    a = int(p[:, 0].argmin())
    b = int(((p - p[a]) ** 2).sum(axis=1).argmax())
    c = int(np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1).argmax())
    d = int(np.abs((p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a])).argmax())
    inside = p[[a, b, c, d]].mean(axis=0)

    def made(f):
        """Facets turned outward, their normals, and of each the farthest point above it: its height and number."""
        f = np.array(f)
        n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
        turn = (n * (p[f[:, 0]] - inside)).sum(axis=1) <= 0
        f[turn], n[turn] = f[turn][:, [0, 2, 1]], -n[turn]
        unit = n / np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
        h = ((p - p[f[:, 0]][:, None]) @ unit[:, :, None])[:, :, 0]
        far = h.argmax(axis=1)
        return f, n, h[np.arange(len(f)), far], far

    # a facet's highest point doesn't change, so only new facets are looked at
    facets, n, height, far = made([(a, b, c), (a, b, d), (a, c, d), (b, c, d)])
    while True:
        top = int(height.argmax())
        if height[top] <= tolerance * scale:
            return np.unique(facets)
        x = far[top]
        seen = (n * (p[x] - p[facets[:, 0]])).sum(axis=1) > 0
        edges = {e for f in facets[seen].tolist() for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))}
        new = made([(i, j, x) for i, j in sorted(edges) if (j, i) not in edges])
        facets, n, height, far = (np.concatenate([old[~seen], more]) for old, more in zip((facets, n, height, far), new))


def hull_centres(points: DataFrame, key: list[str]) -> DataFrame:
    """EXT-11: the mean of an object's hull vertices (repeated positions count once)."""

    def solve(rows, at):
        every, found = grouped.numbers(rows, ["x", "y", "z"]), []
        for low, high in zip(at[:-1], at[1:]):
            p = np.unique(every[low:high], axis=0)
            v = p[hull_vertices(p)]
            found.append((len(v), *v.mean(axis=0).tolist()))
        return {"group": range(len(found))} | dict(zip(("vertices", "cx", "cy", "cz"), zip(*found)))

    return grouped.whole_groups(points.select(*key, "x", "y", "z"), key, [], solve, "vertices int, cx double, cy double, cz double")


def face_samples(triangles: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """EXT-22: ``n`` points of a mesh, spread by area: ``key, ax..cz`` corner coordinates a row. A mesh without area gives
    none; the stream of random numbers hangs on the seed and the key."""
    names = [f"{v}{c}" for v in "abc" for c in "xyz"]

    def solve(rows, at):
        every, keys = grouped.numbers(rows, names).reshape(-1, 3, 3), rows.column(key).take(pa.array(at[:-1])).to_pylist()
        sizes = np.linalg.norm(np.cross(every[:, 1] - every[:, 0], every[:, 2] - every[:, 0]), axis=1) / 2
        groups, found = [], []
        for group, (k, low, high) in enumerate(zip(keys, at[:-1], at[1:])):
            t, area = every[low:high], sizes[low:high]
            if area.sum() <= 0:
                continue
            rng = np.random.default_rng([seed, int(k)])
            f = t[rng.choice(len(t), n, p=area / area.sum())]
            u, v = rng.random((2, n))
            u = np.sqrt(u)
            groups.append(group)
            found.append((1 - u)[:, None] * f[:, 0] + (u * (1 - v))[:, None] * f[:, 1] + (u * v)[:, None] * f[:, 2])
        q = np.concatenate(found) if found else np.zeros((0, 3))
        return {"group": np.repeat(groups, n).astype(int), "place": np.tile(np.arange(n, dtype=np.int32), len(groups)), "x": q[:, 0], "y": q[:, 1], "z": q[:, 2]}

    return grouped.whole_groups(triangles.select(key, *names), [key], names, solve, "place int, x double, y double, z double")


def meter_means(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """CMP-30, AGG-30: plain means of what was appended, five digits; nothing is filtered."""
    return rows.groupBy(key).agg(*[F.round(F.avg(v), 5).alias(v) for v in values])


def verified_manifest(manifest: DataFrame, payload: list[str], stored: str = "payload_sha256") -> DataFrame:
    """SRC-09: rows whose stored hash is that of their payload columns as JSON in order of name (this engine's text);
    any other row is an error."""
    real = F.sha2(F.to_json(F.struct(*sorted(payload))), 256)
    return manifest.withColumn(stored, F.when(real.eqNullSafe(F.col(stored)), F.col(stored)).otherwise(F.raise_error(F.lit("manifest payload doesn't match its hash"))))
