"""Corpus lexicons: every distinct word once, with its count and what was worked out for it.

A lexicon is joined back to the words of documents in two parts. The *head*, its most frequent
entries up to a fixed number of entries and bytes, is broadcast and looked up while a task reads its
documents. The *tail* - everything else, so by definition no hot keys but for oversized words - goes
through a shuffle join on the word. Both parts together cover every word; the bound moves work
between them and never changes a result.
"""

from __future__ import annotations

import ctypes
import gc
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The head's bounds: entries, and UTF-8 bytes of one word.
HEAD_WORDS = 200_000
HEAD_WORD_BYTES = 64
#: Distinct words that one task counts before it hands them on.
FLUSH = 200_000
#: Rows that a task has as Python objects at a time.
SLICE = 1000
#: Bytes of text that a task works on at a time (a longer text is worked on alone).
SLICE_BYTES = 8 << 20


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def slices(it: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python objects at once."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(it: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` bytes of the string ``column``, or of one row; empty batches go."""
    for batch in it:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def released(f):
    """A function over batches that gives the memory it used back when it has ended: Python workers live on, and what one
    task has used would stay with its worker while other tasks run."""

    def of(it):
        yield from f(it)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return of


def count_words(texts: DataFrame, tools: Callable[[], tuple[Callable[[str], Iterable[str]], Callable[[str], Iterable[str]]]]) -> DataFrame:
    """``(word, n)`` over all rows of the one-column frame ``texts``.

    ``tools`` gives, in the task, two functions: from a text to its units, and from a unit to its words. Units are
    counted in the task and split once for each time that they are handed on, so a frequent word is one row a task.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def partial(it):
        units, words = tools()

        def handed_on(seen: Counter) -> Iterator[pa.RecordBatch]:
            out: Counter = Counter()
            for unit, n in seen.items():
                for word in words(unit):
                    out[word] += n
            yield from batches(out.items(), schema)

        seen: Counter = Counter()
        for batch in slices(it, SLICE // 4):
            for x in batch.column(0).to_pylist():
                seen.update(units(x or ""))
            if len(seen) > FLUSH:
                yield from handed_on(seen)
                seen = Counter()
        yield from handed_on(seen)

    return texts.mapInArrow(released(partial), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split_head(lexicon: DataFrame, most: int = HEAD_WORDS) -> tuple[pa.Table, DataFrame]:
    """The head as an Arrow table of at most ``most`` rows, and the tail as a frame.

    The cut is a count: all words at least that frequent fit into the bound. It is found from the
    histogram of counts, so nothing is sorted.
    """
    small = F.octet_length("word") <= HEAD_WORD_BYTES
    # about 60 counts to a factor of two: exact up to 64, then steps of about 1 %
    step = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.log2(F.col("n")) * 64).cast("long"))
    shape = sorted(((r["at"], r["words"], r["least"]) for r in lexicon.where(small).groupBy(step.alias("at")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()), reverse=True)
    total, cut = 0, None
    for _, words, least in shape:
        if total + words > most:
            break
        total, cut = total + words, least
    if cut is None:
        return lexicon.limit(0).toArrow(), lexicon
    head = small & (F.col("n") >= cut)
    return lexicon.where(head).toArrow(), lexicon.where(~head)


def row_ids() -> Iterator[int]:
    """Numbers for the rows of this task's partition: the same ones when the task is run again."""
    at = TaskContext.get().partitionId() << 36
    while True:
        yield at
        at += 1


def key_of(word: str, row: str) -> F.Column:
    """The join key of tail rows; rows without a word get keys of their own, which match nothing and spread."""
    return F.coalesce(F.col(word), F.concat(F.lit("\u0000row "), F.col(row).cast("string")))
