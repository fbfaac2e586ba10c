"""Rigid transforms from correspondences of which most are wrong.

``sampled_consensus`` deals one key's trials out over tasks and stops when enough have been made for the share of inliers found;
``truncated_fit`` needs no trials: it weighs lengths between points for the rotation and counts intervals for the translation. A key is a
pair with at most 1,000 correspondences (see :func:`keelson.operators.correspondences.best_correspondences`).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators import geometry as G
from keelson.operators import grouped
from keelson.sources.durable import drop_durable, durable

SRC, REF = G.SRC, G.REF


def rotations(a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The proper rotations (n x 3 x 3) that bring each of n sets of vectors ``a`` (n x m x 3) nearest to ``b``."""
    u, _, vt = np.linalg.svd((a if w is None else a * w[..., None]).transpose(0, 2, 1) @ b)
    flip = np.tile(np.eye(3), (len(a), 1, 1))
    flip[:, 2, 2] = np.sign(np.linalg.det(u @ vt))
    return vt.transpose(0, 2, 1) @ flip @ u.transpose(0, 2, 1)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])


def triangle_turns(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`rotations` (3 x 3 x n) of n sets of three vectors (set's vector, coordinate, set) that add up to zero, and the largest squared miss
    of a set's own vectors. These lie in a plane, so it is the turn of one plane onto the other and the best angle within it. Sets (almost) on a
    line are left to the general form."""
    na, nb = _cross(a[0], a[1]), _cross(b[0], b[1])
    sa, sb = np.sqrt(_dot(na, na)), np.sqrt(_dot(nb, nb))
    lengths = [[_dot(p[k], p[k]) for k in range(3)] for p in (a, b)]
    flat = (sa > 1e-4 * (lengths[0][0] + lengths[0][1] + lengths[0][2])) & (sb > 1e-4 * (lengths[1][0] + lengths[1][1] + lengths[1][2]))
    frames, inside = [], []
    for p, normal, size, long in ((a, na, sa, lengths[0][0]), (b, nb, sb, lengths[1][0])):
        z, x = normal / np.where(flat, size, 1.0), p[0] / np.where(flat, np.sqrt(long), 1.0)
        y = _cross(z, x)
        frames.append((x, y, z))
        inside.append([(_dot(x, p[k]), _dot(y, p[k])) for k in range(3)])
    u, v = inside
    s = sum(u[k][0] * v[k][1] - u[k][1] * v[k][0] for k in range(3))
    c = sum(u[k][0] * v[k][0] + u[k][1] * v[k][1] for k in range(3))
    size = np.hypot(c, s)
    some = size > 0
    size = np.where(some, size, 1.0)
    c, s = np.where(some, c / size, 1.0), s / size
    worst = 0.0
    for (ux, uy), (vx, vy) in zip(u, v):
        dx, dy = c * ux - s * uy - vx, s * ux + c * uy - vy
        worst = np.maximum(worst, dx * dx + dy * dy)
    (xa, ya, za), (xb, yb, zb) = frames
    p, q = c * xa - s * ya, s * xa + c * ya
    out = xb[:, None] * p + yb[:, None] * q + zb[:, None] * za
    if not flat.all():
        left = np.flatnonzero(~flat)
        pa_, pb = a[:, :, left].transpose(2, 0, 1), b[:, :, left].transpose(2, 0, 1)
        turn = rotations(pa_, pb)
        out[:, :, left] = turn.transpose(1, 2, 0)
        worst[left] = ((pa_ @ turn.transpose(0, 2, 1) - pb) ** 2).sum(axis=2).max(axis=1)
    return out, worst


def triangle_rotations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotations (n x 3 x 3) of :func:`triangle_turns` of sets of three vectors (n x 3 x 3)."""
    return triangle_turns(a.transpose(1, 2, 0), b.transpose(1, 2, 0))[0].transpose(2, 0, 1)


def best_trial(s: np.ndarray, r: np.ndarray, triples: np.ndarray, inlier: float, alike: float, block: int = 4096) -> tuple[int, float, int, np.ndarray] | None:
    """``(inliers, rmse of these, place of the triple, transform)`` of the best triple: the most inliers, then the smallest rmse
    (rounded to 1e-9), then the first. A triple is fitted only if its three sides are alike in both clouds (the shorter at
    least ``alike`` x the longer), and counted only if it fits its own three points within ``inlier``. Not counted further, as they can't be the
    best: one that misses more of the first points than the best so far misses of all; and, once a triple has all points, one whose
    rmse of all points is larger: it is known from sums of products, and can't be less than that of the best turn with the shift that the lengths
    from the triple's centre to the clouds' centres leave."""
    best, n = None, len(s)
    some, ends = min(n, 24), ((0, 1), (1, 2), (2, 0))
    st, rt, sm, rm = np.ascontiguousarray(s.T), np.ascontiguousarray(r.T), s.mean(axis=0), r.mean(axis=0)
    sc, rc = st - sm[:, None], rt - rm[:, None]
    products, spread = rc @ sc.T, float((sc**2).sum() + (rc**2).sum())
    u, size, vt = np.linalg.svd(products)
    least = spread - 2 * (size[0] + size[1] + size[2] * np.sign(np.linalg.det(u @ vt)))

    def sides(la, lb):
        short = np.minimum(la, lb)
        return (short >= alike * np.maximum(la, lb)) & (short > 1e-9)

    known = sides(G.lengths(s), G.lengths(r)).ravel() if n * n <= 4 * len(triples) else None

    def squares(rot, shift, low, high):
        m = len(rot)
        d = (rot.reshape(3 * m, 3) @ st[:, low:high]).reshape(m, 3, high - low)
        d += shift[:, :, None]
        d -= rt[:, low:high]
        d *= d
        return d[:, 0] + d[:, 1] + d[:, 2]

    def bound():
        """The sum of squares of all points that may still be better than a triple that has all of them."""
        return n * (best[1] + 2e-9) ** 2 + 1e-11 * spread if best is not None and best[0] == n else np.inf

    # a first, smaller block finds something to compare with
    cuts = np.unique(np.r_[0, np.arange(block // 4, len(triples), block), len(triples)]).tolist()
    for low, high in zip(cuts[:-1], cuts[1:]):
        t = triples[low:high].T
        if known is not None:
            on = known[t[0] * n + t[1]] & known[t[1] * n + t[2]] & known[t[2] * n + t[0]]
        else:
            length = lambda p, i, j: np.sqrt(_dot(p[:, t[i]] - p[:, t[j]], p[:, t[i]] - p[:, t[j]]))  # noqa: B023, E731
            on = np.logical_and.reduce([sides(length(st, i, j), length(rt, i, j)) for i, j in ends])
        at = np.flatnonzero(on)
        if not len(at):
            continue
        a, b = (np.take(p, t[:, at].ravel(), axis=1).reshape(3, 3, -1).transpose(1, 0, 2) for p in (st, rt))
        ca, cb = (a[0] + a[1] + a[2]) / 3, (b[0] + b[1] + b[2]) / 3
        if bound() < np.inf:
            da, db = ca - sm[:, None], cb - rm[:, None]
            apart = np.sqrt(_dot(da, da)) - np.sqrt(_dot(db, db))
            own = np.flatnonzero(least + n * apart * apart <= bound())
            if not len(own):
                continue
            at, a, b, ca, cb = at[own], a[:, :, own], b[:, :, own], ca[:, own], cb[:, own]
        turn, worst = triangle_turns(a - ca, b - cb)
        own = np.flatnonzero(np.sqrt(worst) <= inlier)
        if not len(own):
            continue
        if len(own) < len(at):
            at, turn, ca, cb = at[own], turn[:, :, own], ca[:, own], cb[:, own]
        off = cb - rm[:, None] - (turn * (ca - sm[:, None])).sum(axis=1)
        total = spread + n * _dot(off, off) - 2 * (turn * products[:, :, None]).sum(axis=(0, 1))
        shift = (cb - (turn * ca).sum(axis=1)).T

        def may(part):
            """Those that may still be better than a triple that has all points."""
            return part[total[part] <= bound()]  # noqa: B023

        def count(part, first=None):
            nonlocal best
            rot, move = np.ascontiguousarray(turn[:, :, part].transpose(2, 0, 1)), shift[part]  # noqa: B023
            miss = squares(rot, move, 0, n) if first is None else np.concatenate([first, squares(rot, move, some, n)], axis=1)
            near = np.sqrt(miss) <= inlier
            inliers = near.sum(axis=1)
            rmse = np.round(np.sqrt(np.where(near, miss, 0).sum(axis=1) / np.maximum(inliers, 1)), 9)
            k = np.lexsort((part, rmse, -inliers))[0]
            x = part[k]
            if best is None or (-inliers[k], rmse[k], low + at[x]) < (-best[0], best[1], best[2]):  # noqa: B023
                m = np.eye(4)
                m[:3, :3], m[:3, 3] = rot[k], move[k]
                best = (int(inliers[k]), float(rmse[k]), int(low + at[x]), m)  # noqa: B023

        left, size = may(np.arange(len(at))), 8
        if len(left) > size:
            left = left[np.argpartition(total[left], size)]
        while len(left) and (best is None or best[0] == n or size == 8):
            count(left[:size])
            left, size = may(left[size:]), 128
        if len(left):  # no triple has all points so far
            left = np.sort(left)
            rot = np.ascontiguousarray(turn[:, :, left].transpose(2, 0, 1))
            first = squares(rot, shift[left], 0, some)
            misses = (np.sqrt(first) > inlier).sum(axis=1)
            for part in np.array_split(np.argsort(misses, kind="stable"), max(1, -(-len(left) // 128))):
                part = part[n - misses[part] >= best[0]]
                if best[0] == n:
                    part = part[np.isin(left[part], may(left[part]))]
                if len(part):
                    count(left[part], first[part])
    return best


def trials_needed(share: Column, confidence: float) -> Column:
    """After how many triples one of inliers alone has come up with ``confidence``; infinite if there are none."""
    good = F.pow(share, F.lit(3.0))
    return F.when(good >= 1, 1.0).when(good > 0, F.lit(math.log(1 - confidence)) / F.log1p(-good)).otherwise(float("inf"))


def _seeded(context: str, key, chunk: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{context}:{key}:{chunk}".encode()).digest()[:8], "little"))


def sampled_consensus(corr: DataFrame, key: str, context: str = "", inlier: float = 0.05, alike: float = 0.9, trials: int = 50_000, chunk: int = 1_000, confidence: float = 0.999, least: int = 3, together: int = 8) -> DataFrame:
    """EXT-21: ``key, n, inliers, rmse, trials, transform`` from triples of correspondences (``key, idx, sx..rz``).

    Trials come in chunks of ``chunk``, each seeded by the context, the key and its number, so it doesn't matter where one is run. In a
    round every open key has ``together`` chunks, then twice as many, and so on, dealt over tasks (a key's apart from each other where keys are few); a key is closed when it
    has had ``trials`` or as many as its best share of inliers needs for ``confidence``. The best transform is fitted
    again to its inliers (kept if that loses none). Under three correspondences, or no triple with ``least`` inliers that passes the checks
    (sides alike, own points met): ``transform`` null, ``inliers`` 0. Rows with a null or infinite coordinate don't count; ties go to the earlier trial."""
    numbers = [F.col(c).cast("double").alias(c) for c in SRC + REF]
    finite = " AND ".join(f"abs({c}) < double('infinity')" for c in SRC + REF)
    rows = durable(corr.select(key, "idx", *numbers).where(finite), "consensus-rows")

    def triples_of(k, chunks: range, n: int) -> np.ndarray:
        draw = np.concatenate([_seeded(context, k, c).random((chunk, 3))[: max(0, trials - c * chunk)] for c in chunks])
        # three different places: the second and third skip those before
        i, j = (draw[:, 0] * n).astype(int), (draw[:, 1] * (n - 1)).astype(int)
        j += j >= i
        x = (draw[:, 2] * (n - 2)).astype(int)
        low, high = np.minimum(i, j), np.maximum(i, j)
        x += x >= low
        x += x >= high
        return np.stack([i, j, x]).T

    def tried(table, at):
        s, r = grouped.numbers(table, SRC), grouped.numbers(table, REF)
        firsts, lasts, names = (table.column(c).take(pa.array(at[:-1])).to_pylist() for c in ("_chunk", "_last", key))
        out = []
        for g, (k, c, last) in enumerate(zip(names, firsts, lasts)):
            mine = slice(at[g], at[g + 1])
            n = int(at[g + 1] - at[g])
            best = best_trial(s[mine], r[mine], triples_of(k, range(c, last + 1), n), inlier, alike)
            if best is not None and best[0] >= least:
                out.append((g, best[0], best[1], c * chunk + best[2], best[3].ravel().tolist()))
        return dict(zip(("group", "inliers", "rmse", "trial", "transform"), map(list, zip(*out)))) if out else {"group": [], "inliers": [], "rmse": [], "trial": [], "transform": []}

    def again(table, at):
        every_s, every_r, out = grouped.numbers(table, SRC), grouped.numbers(table, REF), []
        for g, (first, inliers) in enumerate(zip(table.column("transform").take(pa.array(at[:-1])).to_pylist(), table.column("inliers").take(pa.array(at[:-1])).to_pylist())):
            s, r = every_s[at[g] : at[g + 1]], every_r[at[g] : at[g + 1]]
            t = np.array(first, float).reshape(4, 4)
            on = np.linalg.norm(G.moved(t, s) - r, axis=1) <= inlier
            fit = G.kabsch(s[on], r[on])
            if fit is not None and (now := np.linalg.norm(G.moved(fit, s) - r, axis=1) <= inlier).sum() >= on.sum():
                t, on = fit, now
            miss = np.linalg.norm(G.moved(t, s) - r, axis=1)[on]
            out.append((g, len(miss), float(np.sqrt((miss**2).mean())) if len(miss) else None, t.ravel().tolist()))
        return dict(zip(("group", "_inliers", "_rmse", "_transform"), map(list, zip(*out))))

    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    now = durable(sizes.select(key, "n", F.lit(0).cast("long").alias("inliers"), F.lit(None).cast("double").alias("rmse"), F.lit(None).cast("long").alias("trial"), F.lit(None).cast("array<double>").alias("transform"), (F.col("n") >= 3).alias("open"), F.lit(0).cast("long").alias("trials")), "consensus")
    done = 0
    width = together
    while done * chunk < trials:
        upto = min(done + width, -(-trials // chunk))
        many = now.where("open").count()
        if not many:
            break
        # a key's chunks are parted only where there are fewer keys than tasks can take
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = max(1, min(upto - done, (upto - done) * many // (8 * parts)))
        tasks = now.where("open").select(key, F.explode(F.sequence(F.lit(done), F.lit(upto - 1), F.lit(each))).alias("_chunk"))
        tasks = tasks.withColumn("_last", F.least(F.col("_chunk") + each, F.lit(upto)) - 1)
        found = grouped.whole_groups(rows.join(tasks, key), [key, "_chunk"], ["idx", *SRC, *REF], tried, "inliers long, rmse double, trial long, transform array<double>")
        order = F.struct((-F.col("inliers")).alias("a"), F.col("rmse").alias("b"), F.col("trial").alias("c"))
        both = now.where("transform IS NOT NULL").select(key, "inliers", "rmse", "trial", "transform").unionByName(found.drop("_chunk"))
        best = both.groupBy(key).agg(F.min_by(F.struct("inliers", "rmse", "trial", "transform"), order).alias("_b"))
        made = min(upto * chunk, trials)
        x = now.drop("inliers", "rmse", "trial", "transform").join(best, key, "left").withColumn("trials", F.when(F.col("open"), F.lit(made).cast("long")).otherwise(F.col("trials")))
        x = x.select(key, "n", F.coalesce("_b.inliers", F.lit(0).cast("long")).alias("inliers"), F.col("_b.rmse").alias("rmse"), F.col("_b.trial").alias("trial"), F.col("_b.transform").alias("transform"), "open", "trials")
        x = x.withColumn("open", F.col("open") & (trials_needed(F.col("inliers") / F.col("n"), confidence) > made))
        before, now = now, durable(x, "consensus")
        drop_durable(before)
        done, width = upto, width * 2
    fits = grouped.whole_groups(rows.join(now.where("transform IS NOT NULL").select(key, "inliers", "transform"), key), [key], ["idx", *SRC, *REF], again, "_inliers long, _rmse double, _transform array<double>")
    out = now.join(fits, key, "left")
    return out.select(key, "n", F.coalesce("_inliers", F.lit(0).cast("long")).alias("inliers"), F.col("_rmse").alias("rmse"), "trials", F.col("_transform").alias("transform"))


def graduated_rotation(a: np.ndarray, b: np.ndarray, bound: float, rounds: int = 100, growth: float = 1.4) -> tuple[np.ndarray, np.ndarray]:
    """The rotation of the least sum of min(miss^2, bound^2) over vectors a -> b, and which vectors it keeps: from a convex loss,
    made truncated step by step (graduated non-convexity), each a weighted fit."""
    w, mu = np.ones(len(a)), None
    rot = np.eye(3)
    for _ in range(rounds):
        rot = rotations(a[None], b[None], w[None])[0]
        miss = (a @ rot.T - b).T
        miss *= miss
        r2 = miss[0] + miss[1] + miss[2]
        if mu is None:
            top = 2 * r2.max() / bound**2 - 1
            if top <= 0:
                break
            mu = 1 / top
        low, high = mu / (mu + 1) * bound**2, (mu + 1) / mu * bound**2
        new = np.where(r2 >= high, 0.0, np.where(r2 <= low, 1.0, bound * np.sqrt(mu * (mu + 1) / np.maximum(r2, 1e-300)) - mu))
        if new.sum() < 1e-9 or (np.abs(new - w).max() < 1e-9 and mu > 1e4):
            w = new
            break
        if ((new == w) & ((new == 0) | (new == 1))).all():
            break  # the next fit is this one, and bounds that draw together leave weights of 0 and 1 as they are
        w, mu = new, mu * growth
    return rot, w > 0.5


def voted(values: np.ndarray, bound: float) -> tuple[float, np.ndarray]:
    """A number of the least truncated squares: of all sets of values that intervals of half width ``bound`` have in common, the mean of the one with
    the lowest cost (misses squared, ``bound``^2 for each left out), ties to the lower number. Also which values it has."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    low, high = np.searchsorted(v, v, "left"), np.searchsorted(v, v + 2 * bound, "right")
    one, two = np.r_[0, np.cumsum(v)], np.r_[0, np.cumsum(v**2)]
    n = high - low
    mean = (one[high] - one[low]) / n
    cost = np.round((two[high] - two[low]) - n * mean**2 + (len(v) - n) * bound**2, 12)
    k = np.lexsort((mean, cost))[0]
    on = np.zeros(len(v), bool)
    on[order[low[k] : high[k]]] = True
    return float(mean[k]), on


def truncated_transform(s: np.ndarray, r: np.ndarray, bound: float, seeds: int = 64) -> tuple[np.ndarray, np.ndarray] | None:
    """The transform and which correspondences it keeps; None if fewer than three agree.

    Two correspondences agree if the lengths between their ends differ by at most 2 x ``bound``; a large clique of these goes on. The rotation
    is found from the vectors between its members, the translation from what is left, axis by axis; the result is fitted to what it keeps."""
    if len(s) < 3:
        return None
    ls, lr = G.lengths(s), G.lengths(r)
    near = (np.abs(ls - lr) <= 2 * bound) & (ls > 2 * bound)
    np.fill_diagonal(near, False)
    clique = np.array(G.greedy_clique(near, seeds))
    if len(clique) < 3:
        return None
    i, j = np.triu_indices(len(clique), 1)
    a, b = s[clique], r[clique]
    rot, _ = graduated_rotation(a[i] - a[j], b[i] - b[j], 2 * bound)
    left = b - a @ rot.T
    axes = [voted(left[:, k], bound) for k in range(3)]
    t = np.eye(4)
    t[:3, :3], t[:3, 3] = rot, [x for x, _ in axes]
    # what all correspondences, not the clique alone, say of it
    for _ in range(10):
        on = np.linalg.norm(G.moved(t, s) - r, axis=1) <= 2 * bound
        fit = G.kabsch(s[on], r[on])
        if fit is None:
            return None
        if np.abs(fit - t).max() < 1e-12:
            break
        t = fit
    on = np.linalg.norm(G.moved(t, s) - r, axis=1) <= 2 * bound
    return (t, on) if on.sum() >= 3 else None


def truncated_fit(corr: DataFrame, key: str, bound: float = 0.05) -> DataFrame:
    """EXT-08: ``key, n, inliers, rmse, transform`` of :func:`truncated_transform`; ``transform`` and ``rmse`` null and ``inliers`` 0 where
    nothing agrees. Rows with a null or infinite coordinate don't count; the order of rows doesn't matter."""

    def solve(rows, at):
        every_s, every_r, found = grouped.numbers(rows, SRC), grouped.numbers(rows, REF), []
        finite = np.isfinite(every_s).all(axis=1) & np.isfinite(every_r).all(axis=1)
        for low, high in zip(at[:-1], at[1:]):
            s, r = every_s[low:high][finite[low:high]], every_r[low:high][finite[low:high]]
            got = truncated_transform(s, r, bound)
            if got is None:
                found.append((len(s), 0, None, None))
            else:
                t, on = got
                found.append((len(s), int(on.sum()), float(np.sqrt(((G.moved(t, s[on]) - r[on]) ** 2).sum(axis=1).mean())), t.ravel().tolist()))
        return {"group": range(len(found))} | dict(zip(("n", "inliers", "rmse", "transform"), zip(*found)))

    return grouped.whole_groups(corr.select(key, "idx", *SRC, *REF), [key], ["idx", *SRC, *REF], solve, "n long, inliers long, rmse double, transform array<double>")
