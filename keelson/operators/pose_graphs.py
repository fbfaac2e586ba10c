"""EXT-09: pose graphs over rigid transforms, one sequence a group.

A group is a sequence's anchors with their odometry and at most two loops each, so it is bounded by what a recording is.
Many sequences' graphs are solved together; the normal equations of a long one are 6 x 6 blocks of the edges that are there
(:mod:`keelson.operators.sparse`), not a dense matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import grouped
from keelson.operators import trajectories as T
from keelson.operators.sparse import solved_many


def turns(v: np.ndarray) -> np.ndarray:
    """Rotation matrices (n x 3 x 3) of rotation vectors (n x 3)."""
    angle = np.linalg.norm(v, axis=1)[:, None, None]
    x, y, z = v.T
    o = np.zeros(len(v))
    k = np.array([[o, -z, y], [z, o, -x], [-y, x, o]]).transpose(2, 0, 1)
    return np.eye(3) + np.sinc(angle / np.pi) * k + 0.5 * np.sinc(angle / (2 * np.pi)) ** 2 * (k @ k)


def vectors(r: np.ndarray) -> np.ndarray:
    """Rotation vectors of rotation matrices, by unit quaternions (the largest of their four parts first)."""
    d = np.einsum("nii->ni", r)
    tr = d.sum(axis=1)
    # 4 q q^T, whose row with the largest diagonal is the quaternion up to scale
    q = np.empty((len(r), 4, 4))
    q[:, 0, 0] = 1 + tr
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        q[:, 0, i + 1] = q[:, i + 1, 0] = r[:, k, j] - r[:, j, k]
        q[:, i + 1, i + 1] = 1 + 2 * d[:, i] - tr
        q[:, j + 1, k + 1] = q[:, k + 1, j + 1] = r[:, j, k] + r[:, k, j]
    row = np.einsum("nii->ni", q).argmax(axis=1)
    q = q[np.arange(len(r)), row]
    q *= (np.where(q[:, 0] < 0, -1.0, 1.0) / np.linalg.norm(q, axis=1))[:, None]
    size = np.linalg.norm(q[:, 1:], axis=1)
    scale = np.where(size > 1e-12, 2 * np.arctan2(size, q[:, 0]) / np.maximum(size, 1e-300), 2.0)
    return q[:, 1:] * scale[:, None]


def inverses(t: np.ndarray) -> np.ndarray:
    out = t.copy()
    out[:, :3, :3] = t[:, :3, :3].transpose(0, 2, 1)
    out[:, :3, 3] = -np.einsum("nij,nj->ni", out[:, :3, :3], t[:, :3, 3])
    return out


def shifted(t: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """exp(delta) t: rotation vector first, translation apart from it (SE3-07)."""
    step = np.tile(np.eye(4), (len(t), 1, 1))
    step[:, :3, :3], step[:, :3, 3] = turns(delta[:, :3]), delta[:, 3:]
    return step @ t


def optimise_many(t0: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, z: np.ndarray, scale: np.ndarray, huber: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Poses that minimise the Huber loss (each component for itself) of the edges a -> b of many graphs at once; graph g has the poses
    ``at[g]`` to ``at[g + 1]``, its first one held. Damped Gauss-Newton with central differences, an edge's row having twelve columns;
    each graph has a damping and an end of its own. Also the residuals before and after."""
    back = inverses(z)

    def error(of, ta, tb):
        e = back[of] @ inverses(tb) @ ta
        return np.hstack([vectors(e[:, :3, :3]), e[:, :3, 3]]) * scale[of]

    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    graph, h = owner[a], 1e-6

    def loss(of, r):
        x = np.abs(r)
        return np.bincount(graph[of], np.where(x <= huber, x**2, 2 * huber * x - huber**2).sum(axis=1), len(size))

    every = np.arange(len(a))
    delta, t, damping = np.zeros((len(t0), 6)), t0.copy(), np.full(len(size), 1e-4)
    before = error(every, t[a], t[b])
    r, now = before.copy(), loss(every, before)
    going, plans = np.bincount(graph, minlength=len(size)) > 0, {}
    for _ in range(rounds):
        if not going.any():
            break
        p, e = np.flatnonzero(going[owner]), np.flatnonzero(going[graph])
        place = np.zeros(len(t0), int)
        place[p] = np.arange(len(p))
        ea, eb = place[a[e]], place[b[e]]
        tp, jac = t[p], np.empty((len(e), 6, 12))
        for c in range(6):
            step = np.zeros(6)
            step[c] = h
            up, down = shifted(t0[p], delta[p] + step), shifted(t0[p], delta[p] - step)
            jac[:, :, c] = (error(e, up[ea], tp[eb]) - error(e, down[ea], tp[eb])) / (2 * h)
            jac[:, :, 6 + c] = (error(e, tp[ea], up[eb]) - error(e, tp[ea], down[eb])) / (2 * h)
        w = np.minimum(1.0, huber / np.maximum(np.abs(r[e]), 1e-300))
        weighted = (jac * w[:, :, None]).transpose(0, 2, 1) @ jac
        diagonal, slope = np.zeros((len(p), 6, 6)), np.zeros((len(p), 6))
        for end, s in ((ea, slice(0, 6)), (eb, slice(6, 12))):
            np.add.at(diagonal, end, weighted[:, s, s])
            np.add.at(slope, end, np.einsum("eki,ek->ei", jac[:, :, s], w * r[e]))
        cross = weighted[:, :6, 6:]
        spread = np.einsum("nii->ni", diagonal) + 1e-12
        wait = going.copy()  # graphs whose step hasn't been found yet
        while True:
            wait &= damping < 1e12
            if not wait.any():
                break
            # all poses but the first of the graphs that wait
            free = wait[owner[p]] & (p > at[owner[p]])
            node = np.flatnonzero(free)
            number = np.cumsum(free) - 1
            start = np.r_[0, np.cumsum(np.where(wait, size - 1, 0))]
            links = free[ea] & free[eb]
            damped = diagonal[node] + np.eye(6) * (damping[owner[p[node]], None] * spread[node])[:, :, None]
            move = solved_many(start, damped, number[ea[links]], number[eb[links]], cross[links], -slope[node], plans)
            trial = delta[p]
            trial[node] += move
            mine = np.flatnonzero(wait[graph[e]])
            tt = shifted(t0[p], trial)
            rr = error(e[mine], tt[ea[mine]], tt[eb[mine]])
            then = loss(e[mine], rr)
            better = wait & (then <= now)
            damping[wait] *= np.where(better[wait], 0.3, 4.0)
            moved = np.flatnonzero(better[owner[p]])
            delta[p[moved]], t[p[moved]] = trial[moved], tt[moved]
            took = better[graph[e[mine]]]
            r[e[mine[took]]] = rr[took]
            furthest = np.zeros(len(size))
            np.maximum.at(furthest, owner[p[node]], np.abs(move).max(axis=1))
            done = better & ((now - then <= 1e-10 * np.maximum(then, 1e-300)) | (furthest < 1e-10))
            now = np.where(better, then, now)
            going &= ~done
            wait &= ~better
        going &= damping < 1e12
    return t, before, r


def optimise(t0: np.ndarray, a: np.ndarray, b: np.ndarray, z: np.ndarray, scale: np.ndarray, huber: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`optimise_many` of one graph."""
    return optimise_many(t0, np.array([0, len(t0)]), a, b, z, scale, huber, rounds)


def optimised(poses: DataFrame, loops: DataFrame, degree: int = 2, sigma_m: float = 0.04, sigma_deg: float = 2.0, huber: float = 2.0, rounds: int = 60) -> DataFrame:
    """EXT-09: the anchors of each sequence moved so that odometry (between neighbours, as the poses have it) and loops
    agree. Residuals are an edge's rotation vector and translation over their sigmas, times its weight.

    ``poses``: ``sequence_id, ordinal, transform`` (world from camera); ``loops``: ``sequence_id, source, target`` (ordinals),
    ``transform`` (target from source), ``weight, provenance, pos``. Loops are made sparse first (WIN-10, WIN-11): the best
    of each unordered pair, at most ``degree`` an anchor; self loops and those without both anchors don't count.
    ``sequence_id, ordinal, transform, correction_deg, correction_m, loops, before, after`` (root mean square residuals),
    ``success`` (finite and not worse). One pose alone stays as it is."""
    ends = lambda c: poses.select("sequence_id", F.col("ordinal").alias(c))
    known = loops.where("source <> target").join(ends("source"), ["sequence_id", "source"], "left_semi").join(ends("target"), ["sequence_id", "target"], "left_semi")
    best = T.best_edges(known).where("reason IS NULL")
    kept = T.degree_capped(best, degree, ["transform"]).where("accepted")

    rows = poses.select("sequence_id", F.lit(0).alias("edge"), F.col("ordinal").cast("long").alias("i"), F.lit(None).cast("long").alias("j"), "transform", F.lit(1.0).alias("weight"))
    rows = rows.unionByName(kept.select("sequence_id", F.lit(1).alias("edge"), F.col("source").cast("long").alias("i"), F.col("target").cast("long").alias("j"), "transform", F.col("weight").cast("double").alias("weight")))

    def solve(table, at):
        edge, i, j = (table.column(c).fill_null(-1).to_numpy() for c in ("edge", "i", "j"))
        ts, weight = np.asarray(table.column("transform").combine_chunks().flatten(), float).reshape(-1, 4, 4), table.column("weight").to_numpy()
        group = np.repeat(np.arange(len(at) - 1), np.diff(at))
        p, e = np.flatnonzero(edge == 0), np.flatnonzero(edge == 1)
        t0, owner = ts[p], group[p]
        start = np.searchsorted(owner, np.arange(len(at)))
        # poses are in order of sequence and ordinal: an end's place in that order
        ordinals, spot = np.unique(np.r_[i[p], i[e], j[e]], return_inverse=True)
        code = owner * len(ordinals) + spot[: len(p)]
        find = lambda s: np.searchsorted(code, group[e] * len(ordinals) + s)
        chain = np.flatnonzero(owner[1:] == owner[:-1])
        a, b = np.r_[chain, find(spot[len(p) : len(p) + len(e)])], np.r_[chain + 1, find(spot[len(p) + len(e) :])]
        z = np.concatenate([inverses(t0[chain + 1]) @ t0[chain], ts[e]])
        scale = np.r_[np.ones(len(chain)), weight[e]][:, None] * np.repeat([1 / np.radians(sigma_deg), 1 / sigma_m], 3)
        t, before, after = optimise_many(t0, start, a, b, z, scale, huber, rounds)
        edges = np.bincount(owner[a], minlength=len(at) - 1)
        rms = [np.sqrt(np.bincount(owner[a], (x**2).sum(axis=1), len(edges)) / np.maximum(6 * edges, 1)) for x in (before, after)]
        change = t @ inverses(t0)
        deg, m = np.degrees(np.linalg.norm(vectors(change[:, :3, :3]), axis=1)), np.linalg.norm(change[:, :3, 3], axis=1)
        good = np.isfinite(rms[1]) & (rms[1] <= rms[0] + 1e-9)
        loops_of = np.bincount(group[e], minlength=len(edges))
        return {"group": owner, "ordinal": i[p].astype(np.int32), "transform": t.reshape(-1, 16).tolist(), "correction_deg": deg, "correction_m": m, "loops": loops_of[owner], "before": rms[0][owner], "after": rms[1][owner], "success": good[owner]}

    return grouped.whole_groups(rows, ["sequence_id"], ["edge", "i", "j"], solve, "ordinal int, transform array<double>, correction_deg double, correction_m double, loops long, before double, after double, success boolean")
