"""Harmonic packing of token sequences.

A length falls into a reciprocal-capacity class: class ``k`` has the lengths above ``capacity / (k + 1)`` up to
``capacity / k``, and each of its bins takes exactly ``k`` documents, whole. What then is left of a bin's capacity - on
average a few hundred tokens for the low classes - is filled from a document that is being cut: longer documents, which
have to be cut anyway, give whole sequences and then their rest for it; without such a rest, the next document does. So
most documents that fit stay whole, and sequences are full but for gaps of under ``LEAST`` tokens.

Every worker fills bins of its own from the rows of its partition and passes nothing on; nothing depends on how documents
meet across partitions. At the end of a partition its unfilled bins - fewer than ``k`` documents a class, which the capacity
bounds - are packed together, so only a partition's last sequence may be short. Sequences are numbered by partition and
number in it: no counting over all partitions is needed, and there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import words_text
from keelson.llm.lexicon import batches, released, slices
from keelson.llm.tokens import text_ids

CAPACITY = 1024
END_ID = 0
#: No cut leaves a piece of fewer tokens than this (or a thirty-second of a smaller capacity).
LEAST = 32
#: A sequence's number is its partition's times this and its number there.
PER_PART = 1 << 36


class Bins:
    """The open bins of one worker. Pieces are lists ``[doc, start, length]``; full sequences leave as lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, least: int = LEAST):
        self.capacity, self.least = capacity, max(1, min(least, capacity // 32))
        self.open: dict[int, list] = {}  # by class
        self.cut_from: list | None = None  # the piece that gaps are filled from
        self.short: tuple[int, list] | None = None  # a bin that waits for such a piece

    def _room(self, rest: int, room: int) -> int:
        """How much of a piece of ``rest`` tokens to put into ``room``: all, or so much that no crumb comes about."""
        if rest <= room:
            return rest
        take = min(room, rest - self.least)
        return take if take >= self.least else 0

    def _fill(self, k: int, pieces: list) -> Iterator[tuple[int, list]]:
        gap = self.capacity - sum(p[2] for p in pieces)
        if gap >= self.least:
            if self.cut_from is None:
                self.short = (k, pieces)
                return
            doc, start, rest = self.cut_from
            take = self._room(rest, gap)
            if take:
                pieces.append([doc, start, take])
                self.cut_from = [doc, start + take, rest - take] if take < rest else None
                if gap - take >= self.least and self.cut_from is None:
                    self.short = (k, pieces)
                    return
        yield k, pieces

    def add(self, doc, total: int) -> Iterator[tuple[int, list]]:
        """Take a document of ``total`` tokens; gives (class, pieces) for every sequence that is done."""
        start = 0
        while total - start > self.capacity:
            take = self._room(total - start, self.capacity)
            yield 1, [[doc, start, take]]
            start += take
        rest = [doc, start, total - start]
        if self.cut_from is None and (start or self.short):
            self.cut_from = rest
            if self.short:
                waiting, self.short = self.short, None
                yield from self._fill(*waiting)
            return
        k = self.capacity // rest[2]
        mine = self.open.setdefault(k, [])
        mine.append(rest)
        if len(mine) == k:
            yield from self._fill(k, self.open.pop(k))

    def close(self) -> Iterator[tuple[int, list]]:
        """The sequences of what is left, class 0: longest first, cut where a sequence is full."""
        left = [p for pieces in self.open.values() for p in pieces] + [p for p in [self.cut_from] if p]
        now = self.short[1] if self.short else []
        room = self.capacity - sum(p[2] for p in now)
        for doc, start, rest in sorted(left, key=lambda p: -p[2]):
            while rest:
                take = self._room(rest, room)
                if take:
                    now.append([doc, start, take])
                    start, rest, room = start + take, rest - take, room - take
                if rest or not room:
                    yield 0, now
                    now, room = [], self.capacity
        if now:
            yield 0, now
        self.open, self.cut_from, self.short = {}, None, None


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pack whole documents: one row a piece with ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, class_k``, and its ids as little-endian 32-bit bytes unless ``keep_ids`` is off.

    ``tokenizer`` is a tokenizer file; ``ranks`` may name the rank file of the same vocabulary, which is faster. Null
    and empty texts are the end id alone. A null ``doc_id`` stays null; rows with the same
    ``doc_id`` are packed as documents of their own. Other columns are left out. Every id of every row
    lies in exactly one piece. ``class_k`` is the class of the sequence (1 also for whole sequences of longer documents, 0
    for those that a partition's last bins were packed into). An empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("class_k", pa.int32())])

    def pack(it):
        ids, end, bins = text_ids(tokenizer, ranks), np.array([end_id], "<u4").tobytes(), Bins(capacity)
        sequence = TaskContext.get().partitionId() * PER_PART

        def rows(done: Iterator[tuple[int, list]]):
            nonlocal sequence
            for k, pieces in done:
                offset = 0
                for (doc, raw), start, length in pieces:
                    yield doc, start, length, raw[4 * start : 4 * (start + length)], len(raw) // 4, sequence, offset, k
                    offset += length
                sequence += 1

        def all_rows():
            for batch in slices(it):
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = ids(body or "") + end
                    yield from rows(bins.add((doc, raw), len(raw) // 4))
            yield from rows(bins.close())

        yield from batches(all_rows(), schema, 1024)

    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_text(text).alias("text")).mapInArrow(released(pack), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, class_k int")
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), *["ids"] * keep_ids, "doc_tokens", "sequence_id", "offset", "class_k")
