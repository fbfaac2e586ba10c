"""Many whole groups at a time: a key's rows are dealt and sorted by Spark, and a task works on Arrow batches of many keys'
rows, so that a small group costs no frame and no call of its own. A task holds one batch and one group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Groups dealt out over all shuffle partitions: their rows are few bytes, which adaptive execution would put into one
    task, and much work. The keys are made anew, as a repartition by keys that the rows are grouped by already is left out."""
    fresh = df.withColumns({k: F.when(F.col(k).isNotNull(), F.col(k)) for k in keys})
    return fresh.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for k in keys for f in [df.schema[k]])


def starts(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of rows sorted by ``keys`` begin."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(0, batch.num_rows - 1), c.slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= other.to_numpy(zero_copy_only=False) if isinstance(other, pa.Array) else other.to_numpy()
    return np.flatnonzero(new)


def numbers(batch: pa.Table, columns: list[str]) -> np.ndarray:
    """(rows, columns) doubles; null is NaN."""
    return np.column_stack([batch.column(c).cast(pa.float64()).to_numpy() for c in columns]) if columns else np.zeros((batch.num_rows, 0))


def whole_groups(df: DataFrame, keys: list[str], order: list, solve: Callable[[pa.Table, np.ndarray], Iterator[dict]], schema: str, descend: tuple[str, ...] = ()) -> DataFrame:
    """``solve`` of tables of whole groups in order of ``order`` (those of ``descend`` from the top): it gets the table and where each group begins (and
    the end), and returns columns behind the keys, with ``group`` the number of each row's group. ``schema``: of these columns."""
    by = [F.col(c).desc() if c in descend else F.col(c) for c in order]
    rows = dealt(df, *keys).sortWithinPartitions(*keys, *by)
    out_schema = f"{kinds(df, keys)}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(out_schema))

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        at = starts(table, keys)
        found = solve(table, np.r_[at, table.num_rows])
        group = np.asarray(found.pop("group"))
        if len(group):
            heads = [table.column(k).take(pa.array(at[group])).combine_chunks() for k in keys]
            columns = [*heads, *found.values()]
            yield from pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, target.field(i).type, from_pandas=True) for i, c in enumerate(columns)], schema=target).to_batches()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            seam = len(held) > 0 and len(starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)) > 1
            last = int(starts(batch, keys)[-1])
            if seam and not last:
                yield from emit(held)
                held = []
            elif last:
                yield from emit([*held, batch.slice(0, last)])
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held:
            yield from emit(held)

    return rows.mapInArrow(of, out_schema)


def arrays(rows: list[np.ndarray | None]) -> list:
    """Rows of numbers for an array column, with none for None."""
    return [None if r is None else r.tolist() for r in rows]


# --- rigid fits of many sets at once


def products(s: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Of each correspondence what a fit adds up: one, both points and the products of their coordinates (n x 16)."""
    return np.concatenate([np.ones((len(s), 1)), s, r, (s[:, :, None] * r[:, None, :]).reshape(len(s), 9)], axis=1)


def fits(sums: np.ndarray, relative: float = 1e-8, absolute: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The rigid transforms (n x 4 x 4) of the least squared error from sums of :func:`products`, and which are not degenerate (EXT-01)."""
    n = np.maximum(sums[:, :1], 1.0)
    a, b = sums[:, 1:4] / n, sums[:, 4:7] / n
    cov = (sums[:, 7:] / n).reshape(-1, 3, 3) - a[:, :, None] * b[:, None, :]
    cov *= n[:, :, None]
    u, d, vt = np.linalg.svd(cov)
    v, ut = vt.transpose(0, 2, 1).copy(), u.transpose(0, 2, 1)
    v[:, :, 2] *= np.sign(np.linalg.det(v @ ut))[:, None]
    t = np.zeros((len(sums), 4, 4))
    t[:, :3, :3] = v @ ut
    t[:, :3, 3] = b - np.einsum("nij,nj->ni", t[:, :3, :3], a)
    t[:, 3, 3] = 1
    return t, (sums[:, 0] >= 3) & (d[:, 1] > np.maximum(absolute, relative * d[:, 0]))


def fits_of(s: np.ndarray, r: np.ndarray, of: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fits` of the correspondences of many sets (``of``: each one's), about their means, so that sets far from the origin lose no digits."""
    total = lambda columns: np.column_stack([np.bincount(of, c, sets) for c in columns])
    n = np.bincount(of, minlength=sets)[:, None]
    a, b = total(s.T) / np.maximum(n, 1), total(r.T) / np.maximum(n, 1)
    u, v = s - a[of], r - b[of]
    t, ok = fits(np.concatenate([n, np.zeros((sets, 6)), total(u[:, i] * v[:, j] for i in range(3) for j in range(3))], axis=1))
    t[:, :3, 3] = b - np.einsum("nij,nj->ni", t[:, :3, :3], a)
    return t, ok


def misses(t: np.ndarray, s: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How far each transform (n x 4 x 4) misses each correspondence (n x m)."""
    d = s @ t[:, :3, :3].transpose(0, 2, 1)
    d += t[:, None, :3, 3]
    d -= r
    return np.sqrt(np.einsum("nmi,nmi->nm", d, d))


def distinct(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of row of a matrix of bits, and which kind each row is."""
    code = np.packbits(masks, axis=1)
    _, first, kind = np.unique(code.view(np.dtype((np.void, code.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, kind.ravel()


def drawn_triples(rng: np.random.Generator, n: int, trials: int) -> np.ndarray:
    """What ``trials`` calls of ``rng.choice(n, 3, replace=False)`` give, in one call: Floyd's selection and the shuffle after it take
    five bounded numbers a call from the same stream."""
    if n > 10_000 or n < 4:
        return np.array([rng.choice(n, 3, replace=False) for _ in range(trials)], np.int64)
    x = rng.integers(0, np.tile(np.array([n - 3, n - 2, n - 1, 2, 1], np.int64), (trials, 1)), endpoint=True)
    got = x[:, :3].copy()
    got[got[:, 1] == got[:, 0], 1] = n - 2
    got[(got[:, 2] == got[:, 0]) | (got[:, 2] == got[:, 1]), 2] = n - 1
    at = np.arange(trials)
    for i, k in ((2, 3), (1, 4)):
        j = x[:, k]
        got[at, i], got[at, j] = got[at, j].copy(), got[at, i].copy()
    return got
