"""Surfaces from raw clouds: normals, histogram descriptors, point-to-plane registration. No group holds a scan.

Neighbourhoods are joins on grid cells. Normals come from sums of products over a neighbourhood, descriptors from two such
sums (a point's own histograms, then its neighbours' weighed by distance), and a registration's round is a sum of 27 numbers a
pair over its matched points, so a pair of any size uses all tasks and what is solved is a few rows of moments.
Points are ``keys..., row_id, x, y, z``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import se3
from keelson.operators import grouped, sparse
from keelson.sources.durable import drop_durable, durable

BINS = 11
#: Keys of more than one in so many rows meet their one row of facts by a broadcast: there are at most so many.
HOT = 1000
#: A block of points is so many radii wide; points within a radius of it are copied to it.
BLOCK = 16


def reaching(c: str, radius: float) -> Column:
    """The cells of twice the radius that ``radius`` around a coordinate reaches: one or two, or three if its ends lie on edges."""
    reach = radius * (1 + 1e-9)
    return F.sequence(F.floor((F.col(c) - reach) / (2 * radius)).cast("long"), F.floor((F.col(c) + reach) / (2 * radius)).cast("long"))


def near_pairs(source: DataFrame, target: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """JOI-13: all pairs within ``radius``: ``keys, s, t, dx, dy, dz`` (target less source) and ``d``. A source point is copied to the
    cells that it reaches, eight at most (but for ends on cells' edges) and 3.4 on average."""
    s = source.select(*keys, F.col("row_id").alias("s"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    for c in "xyz":
        s = s.withColumn(f"_i{c}", F.explode(reaching(f"s{c}", radius)))
    t = target.select(*keys, F.col("row_id").alias("t"), *[F.col(c).alias(f"t{c}") for c in "xyz"], *[F.floor(F.col(c) / (2 * radius)).cast("long").alias(f"_i{c}") for c in "xyz"])
    x = s.join(t, [*keys, *[f"_i{c}" for c in "xyz"]]).select(*keys, "s", "t", *[(F.col(f"t{c}") - F.col(f"s{c}")).alias(f"d{c}") for c in "xyz"])
    return x.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))).where(F.col("d") <= radius)


def _nearest(pairs: DataFrame, keys: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*keys, "s").orderBy(F.round("d", 9), "t")
    return pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def meet(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the one row of ``facts`` that their key has; keys of a large share of all rows are not shuffled."""
    sizes = durable(rows.groupBy(key).agg(F.count("*").alias("_n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = sizes.where(F.col("_n") * HOT > total).select(key)
    there = rows.join(F.broadcast(facts.join(hot, key, "left_semi")), key)
    return there.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(facts.join(hot, key, "left_anti"), key))


def _solved(moments: DataFrame, keys: list[str], solve, out: str) -> DataFrame:
    """``solve`` of the numbers behind the keys, batch by batch: (rows, m) to (rows, n), NaN for none."""
    names = out.split()
    kinds = ", ".join([f"`{k}` {dict(moments.dtypes)[k]}" for k in keys] + [f"{n} double" for n in names])

    def of(it):
        for batch in it:
            given = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in range(len(keys), batch.num_columns)]) if batch.num_rows else np.zeros((0, batch.num_columns - len(keys)))
            found = solve(given)
            columns = [pa.array(found[:, k], pa.float64(), from_pandas=True) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names=[*keys, *names])

    return moments.mapInArrow(of, kinds)


def _smallest_axis(m: np.ndarray) -> np.ndarray:
    """Unit normals of rows ``n, sums (3), sums of products (6), outward (3)``: the covariance's axis of the least spread, on the
    outward side; NaN under three points."""
    if not len(m):
        return np.zeros((0, 3))
    n = m[:, 0]
    mean = m[:, 1:4] / n[:, None]
    xx, yy, zz, xy, xz, yz = (m[:, 4 + k] / n for k in range(6))
    cov = np.empty((len(m), 3, 3))
    for (a, b), p in zip(((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)), (xx, yy, zz, xy, xz, yz)):
        cov[:, a, b] = cov[:, b, a] = p - mean[:, a] * mean[:, b]
    axis = np.linalg.eigh(cov)[1][:, :, 0]
    side = (axis * m[:, 10:13]).sum(axis=1)
    lead = axis[np.arange(len(m)), np.abs(axis).argmax(axis=1)]
    axis = axis * np.where(np.abs(side) > 1e-9, np.sign(side), np.sign(lead))[:, None]
    axis[n < 3] = np.nan
    return axis


def in_blocks(p: DataFrame, edge: float, reach: float) -> DataFrame:
    """Points in the block (of width ``edge``) that they lie in (``_own``) and in those within ``reach``: ``_bx, _by, _bz``."""
    block = lambda c: F.floor(c / edge).cast("long")
    nothing = F.array(F.lit(0).cast("long"))
    for c in "xyz":
        p = p.withColumn(f"_b{c}", F.explode(F.coalesce(F.sequence(block(F.col(c) - reach), block(F.col(c) + reach)), nothing)))
    inside = [F.coalesce(block(F.col(c)), F.lit(0)) == F.col(f"_b{c}") for c in "xyz"]
    return p.withColumn("_own", inside[0] & inside[1] & inside[2])


def normals(points: DataFrame, keys: list[str], radius: float = 0.16, most: int = 40) -> DataFrame:
    """EXT-19: ``keys, row_id, x, y, z, nx, ny, nz``: the axis of the least spread of the ``most`` nearest points within ``radius``, the
    point included, turned away from the scan's centre. Null under three points. Points go to the block they lie in and to those within
    ``radius`` (twice on average); pairs are made there and are rows of no table."""
    one = keys[0] if len(keys) == 1 else "_key"
    p = points.select(*keys, "row_id", "x", "y", "z")
    p = p if len(keys) == 1 else p.withColumn(one, F.struct(*keys))
    centre = p.groupBy(one).agg(*[F.avg(c).alias(f"_c{c}") for c in "xyz"])
    p = meet(p, centre, one).select(*keys, "row_id", "x", "y", "z", *[F.col(f"_c{c}").alias(f"o{c}") for c in "xyz"])  # a centre repeats, and so takes few bytes
    p = in_blocks(p, BLOCK * radius, radius * (1 + 1e-9))

    def solve(rows, at):
        every = grouped.numbers(rows, ["x", "y", "z"])
        out = every - grouped.numbers(rows, ["ox", "oy", "oz"])
        own, axis, groups = rows.column("_own").to_numpy(), np.full((rows.num_rows, 3), np.nan), np.repeat(np.arange(len(at) - 1), np.diff(at))
        for low, high in zip(at[:-1], at[1:]):
            there = low + np.flatnonzero(np.isfinite(every[low:high]).all(axis=1))
            mine = there[own[there]]
            if not len(mine):
                continue
            q = every[there]
            for i, j in sparse.Grid(q, radius).pairs(every[mine]):
                d = q[j] - every[mine[i]]
                order = np.lexsort((j, np.round(np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]), 9), i))
                i, d = i[order], d[order]
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                few = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < most
                i, d = i[few], d[few]
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                products = np.stack([d[:, a] * d[:, b] for a, b in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))], axis=1)
                sums = np.add.reduceat(np.concatenate([np.ones((len(i), 1)), d, products], axis=1), first, axis=0)
                who = mine[i[first]]
                axis[who] = _smallest_axis(np.concatenate([sums, out[who]], axis=1))
        numbered = lambda v: pa.array(v[own], pa.float64(), from_pandas=True)
        return {"group": groups[own], "row_id": rows.column("row_id").filter(rows.column("_own")).combine_chunks()} | {c: numbered(every[:, k]) for k, c in enumerate("xyz")} | {f"n{c}": numbered(axis[:, k]) for k, c in enumerate("xyz")}

    found = grouped.whole_groups(p, [*keys, "_bx", "_by", "_bz"], ["row_id"], solve, grouped.kinds(points, ["row_id"]) + ", x double, y double, z double, nx double, ny double, nz double")
    return found.drop("_bx", "_by", "_bz")


def _bins(line: np.ndarray, d: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The bins (3 x pairs) of the three angles of two oriented points, seen from the one whose normal is nearer to the line between them.
    Points are columns (3 x pairs); ``line`` goes from the first to the second and is ``d`` long."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cross = lambda a, b: np.stack([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])
    line = line / d
    a1, a2 = np.round(dot(n1, line), 12), np.round(dot(n2, line), 12)
    turn = np.abs(a1) < np.abs(a2)
    u, other = np.where(turn, n2, n1), np.where(turn, n1, n2)
    v = cross(np.where(turn, -line, line), u)
    size = np.sqrt(dot(v, v))
    v = np.where(size > 0, v / np.where(size > 0, size, 1.0), 0.0)
    angles = ((np.arctan2(dot(cross(u, v), other), dot(u, other)), -np.pi, 2 * np.pi), (dot(v, other), -1.0, 2.0), (np.where(turn, -a2, a1), -1.0, 2.0))
    # rounded: ties of bins go one way wherever the sums are made
    return np.stack([np.clip(np.floor((np.round(f, 9) - low) / width * BINS), 0, BINS - 1).astype(np.int64) for f, low, width in angles])


def histograms(oriented: DataFrame, keys: list[str], radius: float = 0.40, most: int = 100) -> DataFrame:
    """EXT-19: ``keys, row_id, v``: 33 numbers a point. First, for each point, how the angles to its ``most`` nearest points within
    ``radius`` fall into 3 x 11 bins, in per cent; then, of those neighbours, the mean weighed by 1 / distance^2, each eleven scaled
    to 100, plus the point's own. Points without a normal, and points that lie on one another, give nothing to each other. Points go to the block
    they lie in and to those within two radii (twice on average), where their neighbours' own histograms are made too: pairs are rows of no table."""
    reach, edge = radius * (1 + 1e-9), BLOCK * radius
    p = in_blocks(oriented.where("nx IS NOT NULL").select(*keys, "row_id", "x", "y", "z", "nx", "ny", "nz"), edge, 2 * reach)

    def neighbours(grid, p, at, ids):
        """Pairs of points ``at`` with their ``most`` - 1 nearest others, and their distances, in stretches."""
        for i, j in grid.pairs(p[at]):
            i = at[i]
            other = ids[i] != ids[j]
            i, j = i[other], j[other]
            line = p[j].T - p[i].T
            d = np.sqrt(line[0] * line[0] + line[1] * line[1] + line[2] * line[2])
            first = np.flatnonzero(np.diff(i, prepend=-1))
            count = np.diff(np.r_[first, len(i)])
            many = np.repeat(count >= most, count)
            if many.any():  # the others need no order
                few, m = np.flatnonzero(~many), np.flatnonzero(many)
                m = m[np.lexsort((ids[j[m]], np.round(d[m], 9), i[m]))]
                begin = np.flatnonzero(np.diff(i[m], prepend=-1))
                m = m[np.arange(len(m)) - np.repeat(begin, np.diff(np.r_[begin, len(m)])) < most - 1]
                kept = np.sort(np.r_[few, m])
                i, j, d = i[kept], j[kept], d[kept]
            apart = d > 0
            yield i[apart], j[apart], d[apart]

    def of_block(p, n, ids, own, low):
        grid, size = sparse.Grid(p, radius, 500_000), 3 * BINS
        seen = np.flatnonzero(((p >= low - reach) & (p <= low + edge + reach)).all(axis=1) | own)
        place, held, total = np.full(len(p), -1), [], 0
        place[seen] = np.arange(len(seen))
        counts = np.zeros((len(seen), size))
        for i, j, d in neighbours(grid, p, seen, ids):
            if len(i):
                base = place[i] * size
                bins = _bins(p[j].T - p[i].T, d, n[i].T, n[j].T) + np.arange(3)[:, None] * BINS
                at = place[i[0]]
                part = np.bincount((base + bins).ravel() - at * size, minlength=size)
                rows = -(-len(part) // size)
                counts[at : at + rows].ravel()[: len(part)] += part
                total += len(i)
                mine = own[i]
                held.append((i[mine], j[mine], d[mine]) if total < 8_000_000 else None)  # or found again below
        number = counts[:, :BINS].sum(axis=1)
        h = counts * 100.0 / np.maximum(number, 1)[:, None]
        sums = np.zeros((len(p), size))
        again = held if None not in held else neighbours(grid, p, np.flatnonzero(own), ids)
        for i, j, d in again:
            first = np.flatnonzero(np.diff(i, prepend=-1))
            if len(first):
                sums[i[first]] = np.add.reduceat(h[place[j]] * (1 / (d * d))[:, None], first, axis=0)
        who = np.flatnonzero(own & (place >= 0))
        who = who[number[place[who]] > 0]
        g = sums[who].reshape(-1, 3, BINS)
        whole = g.sum(axis=2, keepdims=True)
        return who, np.where(whole > 0, g * 100.0 / np.where(whole > 0, whole, 1.0), 0.0).reshape(-1, size) + h[place[who]]

    def solve(rows, at):
        p, n, own = grouped.numbers(rows, ["x", "y", "z"]), grouped.numbers(rows, ["nx", "ny", "nz"]), rows.column("_own").to_numpy()
        ids, corner = rows.column("row_id").to_numpy(), grouped.numbers(rows.take(pa.array(at[:-1])), ["_bx", "_by", "_bz"]) * edge
        groups, places, values = [], [], [np.zeros((0, 3 * BINS))]
        for g, (low, high) in enumerate(zip(at[:-1], at[1:])):
            if own[low:high].any():
                who, v = of_block(p[low:high], n[low:high], ids[low:high], own[low:high], corner[g])
                groups.append(np.full(len(who), g))
                places.append(low + who)
                values.append(v)
        flat = np.concatenate(values)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * 3 * BINS, pa.int32()), pa.array(flat.ravel()))
        places = np.concatenate([np.zeros(0, np.int64), *places])
        return {"group": np.concatenate([np.zeros(0, np.int64), *groups]), "row_id": rows.column("row_id").take(pa.array(places)).combine_chunks(), "v": lists}

    found = grouped.whole_groups(p, [*keys, "_bx", "_by", "_bz"], ["row_id", "x", "y", "z"], solve, grouped.kinds(oriented, ["row_id"]) + ", v array<double>")
    return found.drop("_bx", "_by", "_bz")


def _step(m: np.ndarray) -> np.ndarray:
    """Rows of ``n, 21 sums of the normal matrix, 6 of its right side, transform (16)`` as the next transform (16), the update's
    degrees and metres."""
    out = np.full((len(m), 18), np.nan)
    for row, x in zip(out, m):
        a = np.zeros((6, 6))
        a[np.triu_indices(6)] = x[1:22]
        a = a + np.triu(a, 1).T
        if x[0] < 6 or np.linalg.matrix_rank(a, tol=1e-9 * max(1.0, np.abs(a).max())) < 6:
            continue
        turn, shift = np.split(np.linalg.solve(a, -x[22:28]), 2)
        angle = float(np.linalg.norm(turn))
        k = np.array([[0, -turn[2], turn[1]], [turn[2], 0, -turn[0]], [-turn[1], turn[0], 0]]) / (angle or 1.0)
        step = np.eye(4)
        step[:3, :3] += np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)
        step[:3, 3] = shift
        row[:16] = (step @ x[28:44].reshape(4, 4)).ravel()
        row[16:] = np.degrees(angle), np.linalg.norm(shift)
    return out


#: Clouds of at most so many points, both together, are registered where they are in one task; larger ones over all tasks.
WHOLE = 100_000


def _planes_of_pairs(start: np.ndarray, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, normal: np.ndarray, reach: float, rounds: int, least_deg: float, least_m: float) -> tuple[np.ndarray, ...]:
    """The rounds of :func:`plane_registered` for many pairs at once (``ga``, ``gb``: the points' pairs, in order): transforms, rounds, which
    converged, and each source point's distance at the end (infinite beyond the reach)."""
    n, t = len(start), start.copy()
    made, converged, going = np.zeros(n, np.int64), np.zeros(n, bool), np.ones(n, bool)
    grid, (i, j) = sparse.Grids(b, gb, n, reach), np.triu_indices(6)
    for _ in range(rounds):
        if not going.any():
            break
        made += going
        at = np.flatnonzero(going[ga])
        now = np.einsum("nij,nj->ni", t[ga[at], :3, :3], a[at]) + t[ga[at], :3, 3]
        index, _ = grid.nearest(now, ga[at])
        on = np.flatnonzero(index >= 0)
        g, p, to = ga[at[on]], now[on], index[on]
        m = normal[to]
        jac = np.concatenate([np.cross(p, m), m], axis=1)
        miss = -((b[to] - p) * m).sum(axis=1)
        first = np.flatnonzero(np.diff(g, prepend=-1))
        who = g[first]
        sums = np.concatenate([np.ones((len(g), 1)), jac[:, i] * jac[:, j], jac * miss[:, None]], axis=1)
        sums = np.add.reduceat(sums, first, axis=0) if len(first) else np.zeros((0, 28))
        step = _step(np.concatenate([sums, t[who].reshape(-1, 16)], axis=1))
        good = ~np.isnan(step[:, 0])
        who, step = who[good], step[good]
        t[who] = step[:, :16].reshape(-1, 4, 4)
        small = (step[:, 16] <= least_deg) & (step[:, 17] <= least_m)
        converged[who[small]] = True
        going[:] = False
        going[who[~small]] = True
    return t, made, converged, grid.nearest(np.einsum("nij,nj->ni", t[ga, :3, :3], a) + t[ga, :3, 3], ga)[1]


def _registered_whole(source: DataFrame, onto: DataFrame, starts: DataFrame, key: str, reach: float, rounds: int, least_deg: float, least_m: float) -> DataFrame:
    """:func:`plane_registered` of pairs that a task can hold, many at once: their points are shuffled once."""
    row, nothing = dict(source.dtypes)["row_id"], F.lit(None)
    numbers = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    none = lambda *names: [nothing.cast("double").alias(c) for c in names]
    no_transform = nothing.cast("array<double>").alias("transform")
    heads = starts.groupBy(key).agg(F.first("transform").alias("transform")).select(key, F.lit(-1).alias("_side"), nothing.cast(row).alias("row_id"), *none(*"xyz", "nx", "ny", "nz"), "transform")
    p = source.select(key, F.lit(0).alias("_side"), "row_id", *numbers(*"xyz"), *none("nx", "ny", "nz"), no_transform)
    q = onto.select(key, F.lit(1).alias("_side"), F.col("row_id").cast(row).alias("row_id"), *numbers(*"xyz", "nx", "ny", "nz"), no_transform)

    def solve(rows, at):
        side = rows.column("_side").to_numpy()
        head = side[at[:-1]] < 0
        groups, n = np.flatnonzero(head), int(head.sum())
        start = np.asarray(rows.column("transform").take(pa.array(at[:-1][head])).combine_chunks().flatten(), float).reshape(-1, 4, 4)
        of = np.repeat(np.where(head, np.cumsum(head) - 1, -1), np.diff(at))
        xyz, normal = grouped.numbers(rows, ["x", "y", "z"]), grouped.numbers(rows, ["nx", "ny", "nz"])
        s, r = np.flatnonzero((side == 0) & (of >= 0)), np.flatnonzero((side == 1) & (of >= 0))
        t, made, converged, d = _planes_of_pairs(start, xyz[s], of[s], xyz[r], of[r], normal[r], reach, rounds, least_deg, least_m)
        on = d <= reach
        every, near = np.bincount(of[s], minlength=n), np.bincount(of[s[on]], minlength=n)
        rmse = np.where(near > 0, np.sqrt(np.bincount(of[s[on]], d[on] ** 2, n) / np.maximum(near, 1)), np.nan)
        return {"group": groups, "transform": t.reshape(n, 16).tolist(), "rounds": made, "converged": converged, "fitness": near / np.maximum(every, 1), "rmse": rmse}

    found = grouped.whole_groups(heads.unionByName(p).unionByName(q), [key], ["_side", "row_id", "x", "y", "z"], solve, "transform array<double>, rounds int, converged boolean, fitness double, rmse double")
    begun = starts.select(key, F.col("transform").alias("_start"))
    return found.join(begun, key).select(key, "transform", "rounds", "converged", "fitness", "rmse", se3.rotation_distance("transform", "_start").alias("update_deg"), se3.translation_distance("transform", "_start").alias("update_m"))


def plane_registered(source: DataFrame, target: DataFrame, starts: DataFrame, key: str, reach: float = 0.15, rounds: int = 40, least_deg: float = 1e-5, least_m: float = 1e-6, whole: int = WHOLE) -> DataFrame:
    """EXT-19, EXT-20: point-to-plane registration of ``source`` onto ``target`` (with normals) from ``starts`` (``key, transform``):
    ``key, transform, rounds, converged, fitness, rmse, update_deg, update_m`` (against the start).

    Each round matches the moved source points with their nearest target within ``reach`` and adds up the 6 x 6 normal equations
    of the distances to the target's planes. A pair stops when its update is small; under six matches, or where they leave
    a direction free, it keeps what it has and doesn't converge. Pairs of at most ``whole`` points are solved many at a time, their points shuffled
    once; larger ones use all tasks, a round a shuffle."""
    onto = durable(target.where("nx IS NOT NULL"), "planes")
    starts = durable(starts.select(key, "transform").where("transform IS NOT NULL"), "starts")
    size = source.select(key).unionAll(onto.select(key)).groupBy(key).agg(F.count("*").alias("_n"))
    large = durable(size.where(F.col("_n") > whole).select(key), "large-clouds")
    if large.isEmpty():
        return _registered_whole(source, onto, starts, key, reach, rounds, least_deg, least_m)
    # there are at most points / whole large ones
    few = [x.join(F.broadcast(large), key, "left_anti") for x in (source, onto, starts)]
    rest = [x.join(F.broadcast(large), key, "left_semi") for x in (source, onto, starts)]
    return _registered_whole(*few, key, reach, rounds, least_deg, least_m).unionByName(_registered_over_tasks(*rest, key, reach, rounds, least_deg, least_m))


def _registered_over_tasks(source: DataFrame, onto: DataFrame, starts: DataFrame, key: str, reach: float, rounds: int, least_deg: float, least_m: float) -> DataFrame:
    """:func:`plane_registered` of pairs of any size."""
    kind = f"`{key}` {dict(starts.dtypes)[key]}, transform array<double>, rounds int, converged boolean, open boolean"
    now = durable(starts.select(key, "transform", F.lit(0).alias("rounds"), F.lit(False).alias("converged"), F.lit(True).alias("open")).where("transform IS NOT NULL"), "transforms")
    begun = now.select(key, F.col("transform").alias("_start"))
    first = now
    q = onto.select(key, F.col("row_id").alias("t"), *[F.col(f"n{c}").alias(f"n{c}") for c in "xyz"])
    names = [f"t{k}" for k in range(16)] + ["deg", "m"]

    def matched(active: DataFrame) -> DataFrame:
        x = meet(source, active, key)
        moved = se3.apply("transform", F.col("x"), F.col("y"), F.col("z"))
        x = x.select(key, "row_id", "transform", *[m.alias(c) for m, c in zip(moved, "xyz")])
        pairs = near_pairs(x, onto, [key], reach)
        best = pairs.groupBy(key, "s").agg(F.min_by(F.struct("t", "dx", "dy", "dz", "d"), F.struct(F.round("d", 12), "t")).alias("b")).select(key, "s", "b.*")
        return best.join(x.select(key, F.col("row_id").alias("s"), "x", "y", "z"), [key, "s"]).join(q, [key, "t"])

    for _ in range(rounds):
        active = now.where("open").select(key, "transform")
        if active.isEmpty():
            break
        n = [F.col(f"n{c}") for c in "xyz"]
        p = [F.col(c) for c in "xyz"]
        j = [p[1] * n[2] - p[2] * n[1], p[2] * n[0] - p[0] * n[2], p[0] * n[1] - p[1] * n[0], *n]
        r = -(F.col("dx") * n[0] + F.col("dy") * n[1] + F.col("dz") * n[2])
        x = matched(active).select(key, *[c.alias(f"j{k}") for k, c in enumerate(j)], r.alias("r"))
        sums = [F.sum(F.col(f"j{a}") * F.col(f"j{b}")).alias(f"a{a}{b}") for a in range(6) for b in range(a, 6)] + [F.sum(F.col(f"j{a}") * F.col("r")).alias(f"r{a}") for a in range(6)]
        moments = x.groupBy(key).agg(F.count("*").alias("n"), *sums).join(active, key).select(key, "n", *[f"a{a}{b}" for a in range(6) for b in range(a, 6)], *[f"r{a}" for a in range(6)], *[se3.at("transform", k // 4, k % 4).alias(f"t{k}") for k in range(16)])
        solved = _solved(moments, [key], _step, " ".join(names)).where("t0 IS NOT NULL").select(key, F.array(*names[:16]).alias("_next"), "deg", "m")
        small = (F.col("deg") <= least_deg) & (F.col("m") <= least_m)
        after = now.join(solved, key, "left").select(
            key, F.when(F.col("open"), F.coalesce("_next", "transform")).otherwise(F.col("transform")).alias("transform"), (F.col("rounds") + F.col("open").cast("int")).alias("rounds"),
            (F.col("converged") | (F.col("open") & F.coalesce(small, F.lit(False)))).alias("converged"), (F.col("open") & F.col("_next").isNotNull() & ~F.coalesce(small, F.lit(False))).alias("open"),
        )
        before, now = now, durable(after, "transforms")
        if before is not first:
            drop_durable(before)
    seen = matched(now.select(key, "transform")).groupBy(key).agg(F.count("*").alias("_n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    size = source.groupBy(key).agg(F.count("*").alias("_all"))
    out = now.join(seen, key, "left").join(size, key, "left").join(begun, key)
    return out.select(
        key, "transform", "rounds", "converged", F.coalesce(F.col("_n") / F.col("_all"), F.lit(0.0)).alias("fitness"), "rmse",
        se3.rotation_distance("transform", "_start").alias("update_deg"), se3.translation_distance("transform", "_start").alias("update_m"),
    )


def feature_correspondences(clouds: DataFrame, key: str, normal_radius: float, feature_radius: float, ratio: float = 0.97, cap: int = 700) -> tuple[DataFrame, DataFrame]:
    """EXT-19, JOI-14: of two clouds a key (``key, side, row_id, x, y, z``), correspondences by mutual nearest descriptors under the ratio test,
    and the clouds with normals. Correspondences are ``key, node_pair, idx, sx..rz, score``."""
    from keelson.operators.matching import ratio_test_matches

    oriented = durable(normals(clouds, [key, "side"], normal_radius), "normals")
    features = durable(histograms(oriented, [key, "side"], feature_radius), "histograms")
    found = ratio_test_matches(features.select(F.col(key).alias("pair_id"), "side", F.col("row_id").alias("node"), "v"), ratio, cap)
    side = lambda k, name, letter: oriented.where(F.col("side") == k).select(F.col(key).alias("pair_id"), F.col("row_id").alias(name), *[F.col(c).alias(f"{letter}{c}") for c in "xyz"])
    corr = found.join(side(0, "s", "s"), ["pair_id", "s"]).join(side(1, "r", "r"), ["pair_id", "r"])
    corr = corr.select(F.col("pair_id").alias(key), F.lit(0).cast("long").alias("node_pair"), F.col("position").cast("long").alias("idx"), *[f"{s}{c}" for s in "sr" for c in "xyz"], (1 - F.col("score")).alias("score"))
    return durable(corr, "feature-correspondences"), oriented
