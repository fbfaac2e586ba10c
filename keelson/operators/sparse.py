"""Sparse helpers of the grouped numerics: symmetric block systems of graphs, and nearest points within a reach, also of many clouds."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class Elimination:
    """In which order the nodes of a graph leave, and where the blocks that this touches are kept."""

    nodes: int
    slots: int  # blocks: one a node, then one a pair of nodes that are linked, or become so
    edge_slots: np.ndarray  # of the given edges
    edge_turned: np.ndarray  # whether the block is kept with b's rows
    steps: list[tuple]  # node, later neighbours, their slots, then of their pairs: (row, column, slot)


def elimination(n: int, a: np.ndarray, b: np.ndarray) -> Elimination:
    """The order of least degree (then lowest number). A chain with few cross links stays about as sparse as it is:
    time and memory follow the links that are there or arise, not n^2. An edge from a node to itself has its own block."""
    near: list[set[int]] = [set() for _ in range(n)]
    for i, j in zip(a.tolist(), b.tolist()):
        if i != j:
            near[i].add(j)
            near[j].add(i)
    queue = [(len(x), i) for i, x in enumerate(near)]
    heapq.heapify(queue)
    rank, order, after = np.full(n, -1), [], []
    while queue:
        degree, v = heapq.heappop(queue)
        if rank[v] >= 0 or degree != len(near[v]):
            continue
        rank[v] = len(order)
        order.append(v)
        left = near[v]
        after.append(left)
        for u in left:
            near[u] |= left
            near[u] -= {u, v}
            heapq.heappush(queue, (len(near[u]), u))
    slot, steps = {}, []
    for v, left in zip(order, after):
        for u in left:
            slot[v, u] = n + len(slot)
    for v, left in zip(order, after):
        later = sorted(left, key=rank.__getitem__)
        i, j = np.triu_indices(len(later))
        pairs = [later[x] if x == y else slot[later[x], later[y]] for x, y in zip(i.tolist(), j.tolist())]
        steps.append((v, np.array(later, int), np.array([slot[v, u] for u in later], int), i, j, np.array(pairs, int)))
    ends = [(i, j) if rank[i] <= rank[j] else (j, i) for i, j in zip(a.tolist(), b.tolist())]
    kept = np.array([i if i == j else slot[i, j] for i, j in ends], int)
    return Elimination(n, n + len(slot), kept, rank[a] > rank[b] if len(a) else np.zeros(0, bool), steps)


def assembled(plan: Elimination, diagonal: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The blocks of a matrix: ``diagonal`` by node, ``cross`` by edge (a's rows, b's columns; an edge that comes twice adds up)."""
    blocks = np.zeros((plan.slots, *diagonal.shape[1:]))
    blocks[: plan.nodes] = diagonal
    np.add.at(blocks, plan.edge_slots, np.where(plan.edge_turned[:, None, None], cross.transpose(0, 2, 1), cross))
    return blocks


def solved(plan: Elimination, blocks: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of (symmetric, positive definite) A x = right by block elimination; ``blocks`` is used up."""
    right, kept = right.copy(), []
    for v, later, slots, i, j, pairs in plan.steps:
        row = blocks[slots]
        both = np.linalg.solve(blocks[v], np.concatenate([right[v][:, None], *row], axis=1))
        size = len(right[v])
        own, scaled = both[:, 0], both[:, 1:].reshape(size, len(later), size).transpose(1, 0, 2)
        if len(later):
            blocks[pairs] -= row[i].transpose(0, 2, 1) @ scaled[j]
            right[later] -= row.transpose(0, 2, 1) @ own
        kept.append((own, scaled))
    x = np.zeros_like(right)
    for (v, later, *_), (own, scaled) in zip(reversed(plan.steps), reversed(kept)):
        x[v] = own - (scaled @ x[later][:, :, None])[:, :, 0].sum(axis=0)
    return x


def solved_many(at: np.ndarray, diagonal: np.ndarray, a: np.ndarray, b: np.ndarray, cross: np.ndarray, right: np.ndarray, plans: dict[int, Elimination], dense: int = 32, most: int = 4_000_000) -> np.ndarray:
    """x of the systems of many graphs at once: graph g has the nodes ``at[g]`` to ``at[g + 1]``, ``diagonal`` and ``right`` are by node,
    ``cross`` by edge (a's rows, b's columns). Graphs of at most ``dense`` nodes are stacked, at most about ``most`` numbers at a time,
    and those of like size solved in one call; larger ones go by block elimination, each for itself, whose orders are kept in ``plans``."""
    k, x, size = right.shape[1], np.zeros_like(right), np.diff(at)
    of = np.repeat(np.arange(len(size)), size)
    order = np.argsort(of[a], kind="stable")
    a, b, cross = a[order], b[order], cross[order]
    first = np.searchsorted(of[a], np.arange(len(size) + 1))
    for g in np.flatnonzero(size > dense):
        n, e = slice(at[g], at[g + 1]), slice(first[g], first[g + 1])
        if g not in plans:
            plans[g] = elimination(int(size[g]), a[e] - at[g], b[e] - at[g])
        x[n] = solved(plans[g], assembled(plans[g], diagonal[n], cross[e]), right[n])
    kinds = np.where((size > 0) & (size <= dense), -(-size // 4) * 4, 0)
    for n in np.unique(kinds[kinds > 0]).tolist():
        every = np.flatnonzero(kinds == n)
        step = max(1, most // (n * k) ** 2)
        for low in range(0, len(every), step):
            some = every[low : low + step]
            slot = np.full(len(size), -1)
            slot[some] = np.arange(len(some))
            m = np.zeros((len(some), n, n, k, k))
            m[:, np.arange(n), np.arange(n)] = np.eye(k)
            v = np.zeros((len(some), n, k))
            node = np.flatnonzero(slot[of] >= 0)
            where, place = slot[of[node]], node - at[of[node]]
            m[where, place, place], v[where, place] = diagonal[node], right[node]
            e = np.flatnonzero(slot[of[a]] >= 0)
            where, i, j = slot[of[a[e]]], a[e] - at[of[a[e]]], b[e] - at[of[a[e]]]
            np.add.at(m, (where, i, j), cross[e])
            np.add.at(m, (where, j, i), cross[e].transpose(0, 2, 1))
            got = np.linalg.solve(m.transpose(0, 1, 3, 2, 4).reshape(len(some), n * k, n * k), v.reshape(len(some), n * k, 1)).reshape(len(some), n, k)
            x[node] = got[slot[of[node]], place]
    return x


class Grid:
    """Points sorted by cells of a reach's width, for the nearest within that reach."""

    def __init__(self, points: np.ndarray, reach: float, most: int = 2_000_000):
        self.reach, self.most = reach, most
        cells = np.floor(points / reach).astype(np.int64) if len(points) else np.zeros((0, 3), np.int64)
        self.low = cells.min(axis=0) - 1 if len(points) else np.zeros(3, np.int64)
        self.size = (cells.max(axis=0) - self.low + 2) if len(points) else np.ones(3, np.int64)
        key = self._key(cells)
        self.order = np.argsort(key, kind="stable")
        self.keys, self.points = key[self.order], points[self.order]

    def _key(self, cells: np.ndarray) -> np.ndarray:
        x = cells - self.low
        return (x[..., 0] * self.size[1] + x[..., 1]) * self.size[2] + x[..., 2]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (-1 for none) and distance (infinite) of each point's nearest within the reach, ties to the lowest index.
        At most about ``most`` pairs, or one point's, are held at once."""
        index, dist = np.full(len(points), -1), np.full(len(points), np.inf)
        if not len(points) or not len(self.points):
            return index, dist
        finite = np.isfinite(points).all(axis=1)
        cells = np.floor(np.where(finite[:, None], points, 0) / self.reach)
        inside = finite & (cells >= self.low).all(axis=1) & (cells < self.low + self.size).all(axis=1)
        at = np.flatnonzero(inside)
        cells = cells[at].astype(np.int64)
        # three neighbours along z follow one another: nine stretches a point; the rim of empty cells keeps them apart
        step = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        base = np.repeat(cells[:, None, :], 9, axis=1)
        base[:, :, :2] += step
        ok = ((base[:, :, :2] >= self.low[:2]) & (base[:, :, :2] < self.low[:2] + self.size[:2])).all(axis=2)
        first, last = base.copy(), base
        first[:, :, 2] = np.maximum(base[:, :, 2] - 1, self.low[2])
        last[:, :, 2] = np.minimum(base[:, :, 2] + 1, self.low[2] + self.size[2] - 1)
        start = np.where(ok, np.searchsorted(self.keys, self._key(first)), 0)
        count = np.where(ok, np.searchsorted(self.keys, self._key(last), "right"), 0) - start
        self._best(points, at, start, count, index, dist)
        return index, dist

    def _best(self, points: np.ndarray, at: np.ndarray, start: np.ndarray, count: np.ndarray, index: np.ndarray, dist: np.ndarray) -> None:
        """Puts into ``index`` and ``dist`` what the points ``at`` find in their stretches of sorted points (rows of ``start`` and ``count``)."""
        total = count.sum(axis=1)
        ends = np.cumsum(total)
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + self.most, "right")))
            c, s, t = count[low:high].ravel(), start[low:high].ravel(), total[low:high]
            if c.sum():
                found = np.repeat(s - np.cumsum(c) + c, c) + np.arange(c.sum())
                d = np.linalg.norm(self.points[found] - np.repeat(points[at[low:high]], t, axis=0), axis=1)
                some = t > 0
                cuts = (np.cumsum(t) - t)[some]
                best = np.minimum.reduceat(d, cuts)
                place = np.minimum.reduceat(np.where(d == np.repeat(best, t[some]), self.order[found], len(self.order)), cuts)
                near = best <= self.reach
                who = at[low:high][some][near]
                index[who], dist[who] = place[near], best[near]
            low = high

    def pairs(self, points: np.ndarray):
        """``(i, j)`` of points and grid points within the reach of each other, for stretches of points: ``most`` candidates or
        one point's are held at once. ``points`` lie in the grid's cells."""
        cells = np.floor(points / self.reach).astype(np.int64)
        step = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        base = np.repeat(cells[:, None, :], 9, axis=1)
        base[:, :, :2] += step
        first, last = base.copy(), base
        first[:, :, 2] -= 1
        last[:, :, 2] += 1
        start = np.searchsorted(self.keys, self._key(first))
        count = np.searchsorted(self.keys, self._key(last), "right") - start
        ends, low = np.cumsum(count.sum(axis=1)), 0
        while low < len(points):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + self.most, "right")))
            c, s = count[low:high].ravel(), start[low:high].ravel()
            found = np.repeat(s - np.cumsum(c) + c, c) + np.arange(c.sum())
            i = np.repeat(np.arange(low, high), count[low:high].sum(axis=1))
            d = self.points[found] - points[i]
            near = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) <= self.reach
            yield i[near], self.order[found[near]]
            low = high


class Grids(Grid):
    """The same for many clouds at once: ``of`` is each point's cloud, of ``clouds``. Cells count from a cloud's own corner and are wider than
    the reach in a cloud of over 2^14 of them a side, so keys stay short wherever a cloud lies. Points that aren't finite are near none."""

    def __init__(self, points: np.ndarray, of: np.ndarray, clouds: int, reach: float, most: int = 2_000_000):
        self.reach, self.most = reach, most
        kept = np.flatnonzero(np.isfinite(points).all(axis=1))
        p, of = points[kept], of[kept]
        low, high = np.full((clouds, 3), np.inf), np.full((clouds, 3), -np.inf)
        np.minimum.at(low, of, p)
        np.maximum.at(high, of, p)
        self.corner, extent = np.where(low <= high, low, 0.0), np.where(low <= high, high - low, -1.0)
        self.width = np.maximum(reach * (1 + 1e-9), extent.max(axis=1) / 2**14)[:, None]  # wider by a hair: rounding parts no pair at the reach
        self.size = np.where(low <= high, np.floor(extent / self.width).astype(np.int64) + 3, 0)  # with a rim of empty cells
        self.base = np.r_[0, np.cumsum(self.size.prod(axis=1))[:-1]]
        key = self._keys(np.floor((p - self.corner[of]) / self.width[of]).astype(np.int64) + 1, of)
        order = np.argsort(key, kind="stable")
        self.order, self.keys, self.points = kept[order], key[order], p[order]

    def _keys(self, cells: np.ndarray, of: np.ndarray) -> np.ndarray:
        size = self.size[of]
        return self.base[of] + (cells[:, 0] * size[:, 1] + cells[:, 1]) * size[:, 2] + cells[:, 2]

    def nearest(self, points: np.ndarray, of: np.ndarray, block: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`Grid.nearest`, each point in its own cloud."""
        index, dist = np.full(len(points), -1), np.full(len(points), np.inf)
        for begin in range(0, len(points) if len(self.points) else 0, block):
            p, g = points[begin : begin + block], of[begin : begin + block]
            finite = np.isfinite(p).all(axis=1)
            cells = np.floor((np.where(finite[:, None], p, 0) - self.corner[g]) / self.width[g]) + 1
            at = np.flatnonzero(finite & (cells >= 0).all(axis=1) & (cells < self.size[g]).all(axis=1))
            cells, g = cells[at].astype(np.int64), g[at]
            size, start, count = self.size[g], np.zeros((len(at), 9), np.int64), np.zeros((len(at), 9), np.int64)
            for k, (i, j) in enumerate((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                c = cells + (i, j, 0)
                ok = np.flatnonzero(((c[:, :2] >= 1) & (c[:, :2] < size[:, :2] - 1)).all(axis=1))
                middle, z = self._keys(c[ok], g[ok]), cells[ok, 2]
                start[ok, k] = np.searchsorted(self.keys, middle - (z > 0))
                count[ok, k] = np.searchsorted(self.keys, middle + (z < size[ok, 2] - 1), "right") - start[ok, k]
            self._best(points, at + begin, start, count, index, dist)
        return index, dist
