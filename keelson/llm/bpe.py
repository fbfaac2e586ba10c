"""BPE encoding and decoding over a table of distinct words.

Words (the tokenizer's pre-tokens) are split off in the tasks that read the documents; each distinct
word of the corpus is encoded once; ids go back to their documents by position. Frequent words (a head of
bounded size) are numbered by frequency: a document then is a row of those numbers, one to three bytes
each, with gaps. The other words' ids, found by a shuffle join, meet it by row and position and fill the
gaps. Decoding looks every id up in the id-to-piece table, which the vocabulary file bounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import durable, words_text
from keelson.llm.lexicon import HEAD_WORDS, batches, count_words, released, slices, split_head
from keelson.llm.tokens import Cached, all_units, contract_words, load, piece_ids, segments, spans, specials, word_pre_tokens

#: Rows that are decoded at a time.
DECODED = 250


def distinct_words(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``(word, n)``: the distinct words of the corpus and how often they occur."""
    return count_words(docs.select(words_text(text)), lambda: (all_units(tokenizer, contract_words), word_pre_tokens(tokenizer)))


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``ids`` (little-endian 32-bit bytes) to ``(word, n)``."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])

    def of(it):
        cut = piece_ids(tokenizer)
        for batch in it:
            ids = [np.array(cut(w), "<u4").tobytes() for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], schema=schema)

    return words.mapInArrow(of, "word string, n long, ids binary")


def piece_table(tokenizer: str) -> list[str]:
    """Pieces by id: as many as the vocabulary file has."""
    vocab = load(tokenizer).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


def number_bytes(n: int) -> bytes:
    """A number in seven-bit groups, the lowest first; all but the last have their high bit set."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def numbers(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that :func:`number_bytes` wrote one after another, each under 2**21, and the places of their last bytes."""
    b = np.frombuffer(body, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    out = b[starts] & 127
    for more in (1, 2):
        long = np.flatnonzero(ends - starts >= more)
        out[long] |= (b[starts[long] + more] & 127) << 7 * more
    return out, ends


def _filled(rows: Iterable[pa.RecordBatch], flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[list, np.ndarray, list[int]]]:
    """(doc_ids, their ids one after another, where each document's begin and end) of some documents, from rows ``row,
    doc_id, at, data`` in order: a document's body (``at`` -1), then what fills its gaps.

    Number ``n`` of a body stands for the ids ``flat[first[n] : first[n] + size[n]]``, 0 for a gap."""

    def done():
        n, ends = numbers(b"".join(bodies))
        sizes, gaps = size[n], np.flatnonzero(n == 0)
        bounds = np.concatenate([[0], np.searchsorted(ends, np.cumsum([len(x) for x in bodies]))])
        if np.diff(np.searchsorted(gaps, bounds)).tolist() != fills:
            raise ValueError("other ids came back than words had gone")
        sizes[gaps] = [len(x) // 4 for x in fill]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat.take(spans(first[n], sizes), mode="clip")
        if fill:
            ids[spans(begins[gaps], sizes[gaps])] = np.frombuffer(b"".join(fill), "<u4")
        return docs, ids, begins[bounds].tolist()

    docs, bodies, fills, fill = [], [], [], []
    for batch in slices(rows):
        for d, at, data in zip(*(c.to_pylist() for c in batch.columns[1:])):
            if at < 0:
                if len(docs) == DECODED:
                    yield done()
                    docs, bodies, fills, fill = [], [], [], []
                docs.append(d)
                bodies.append(data)
                fills.append(0)
            else:
                fills[-1] += 1
                fill.append(data)
    if docs:
        yield done()


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def _parts(docs: DataFrame, tokenizer: str, text: str, doc_id: str, head_words: int):
    """Rows ``row, doc_id, at, data`` dealt out and sorted by document, and a function that makes ``(doc_id, ids)`` of them
    in a task."""
    lexicon = durable(encode_words(distinct_words(docs, tokenizer, text), tokenizer), "words")
    head, tail = split_head(lexicon, head_words)
    head = head.sort_by([("n", "descending"), ("word", "ascending")])
    words = head.column("word").to_pylist()
    # 0 is the gap, then the head's words, then the added tokens
    added = specials(tokenizer)
    ids = [b"", *head.column("ids").to_pylist(), *[np.array([i], "<u4").tobytes() for i in added.values()]]
    size = np.array([len(x) // 4 for x in ids], np.int64)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(words)
    table = spark.sparkContext.broadcast((np.frombuffer(b"".join(ids) or bytes(4), "<u4"), np.cumsum(size) - size, size))
    # the same numbers in both readings, as they go by the partition that a file's rows are in
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), words_text(text).alias("text"))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("data", pa.binary())])

    def bodies(it):
        number = {w: number_bytes(i) for i, w in enumerate(known.value, 1)}
        special = {s: number_bytes(i) for i, s in enumerate(added, 1 + len(number))}
        cut = word_pre_tokens(tokenizer)
        unit = Cached(lambda u: b"".join([number.get(w, b"\0") for w in cut(u)]))

        def body(x: str) -> bytes:
            if not any(s in x for s in special):
                return b"".join(map(unit.__getitem__, contract_words(x)))
            return b"".join([special[part] if is_special else b"".join(map(unit.__getitem__, contract_words(part))) for part, is_special in segments(tokenizer, x)])

        for batch in slices(it):
            data = [body(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-1] * len(data), pa.int32()), pa.array(data, pa.binary())], schema=schema)

    missing = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("word", pa.string())])

    def rare(it):
        common, cut, units = set(known.value), word_pre_tokens(tokenizer), all_units(tokenizer, contract_words)
        lacking = Cached(lambda u: tuple([w for w in cut(u) if w not in common]))

        def found():
            for batch in slices(it):
                for row, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    yield from zip(repeat(row), count(), chain.from_iterable(map(lacking.__getitem__, units(x))))

        yield from batches(found(), missing, 16384)

    fills = source.mapInArrow(released(rare), "row long, at int, word string").join(tail.select("word", "ids"), "word").select("row", F.lit(None).cast("long").alias("doc_id"), "at", F.col("ids").alias("data"))
    parts = source.mapInArrow(released(bodies), "row long, doc_id long, at int, data binary").union(fills)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "row").sortWithinPartitions("row", "at"), lambda it: _filled(it, *table.value)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", head_words: int = HEAD_WORDS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, ids`` (little-endian 32-bit bytes).

    A null or empty text has no ids. Added tokens' strings become their ids, as in the library's
    default. Rows with the same ``doc_id`` stay rows of their own. Other columns are left out.
    """
    parts, filled = _parts(docs, tokenizer, text, doc_id, head_words)

    def of(it):
        for doc_ids, ids, bounds in filled(it):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], schema=_ENCODED)

    return parts.mapInArrow(released(of), "doc_id long, ids binary")


def pieces_of(tokenizer: str):
    """A function from ids to their pieces. An id that the table of pieces lacks is an error."""
    piece = piece_table(tokenizer).__getitem__
    return lambda ids: list(map(piece, ids.tolist()))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", between: str = " ") -> DataFrame:
    """Adds ``decoded``: every id's piece, special ones included, joined as a tokenizer without a decoder joins them.

    The table of pieces has one row an id of the vocabulary file and goes to every task. Null ids
    decode to null, no ids to an empty text.
    """
    rest = [c for c in encoded.columns if c != ids]
    schema = ", ".join([f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest] + [f"`{ids}` binary", "decoded string"])

    def of(it):
        pieces = pieces_of(tokenizer)
        for batch in slices(it, DECODED):
            texts = [None if b is None else between.join(pieces(np.frombuffer(b, "<u4"))) for b in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*rest, ids, "decoded"])

    return encoded.select(*rest, ids).mapInArrow(of, schema)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", head_words: int = HEAD_WORDS, between: str = " ") -> DataFrame:
    """:func:`encode`, then :func:`decode` of its ids in the same tasks: ``doc_id, ids, decoded``."""
    parts, filled = _parts(docs, tokenizer, text, doc_id, head_words)
    schema = pa.schema([*_ENCODED, ("decoded", pa.string())])

    def of(it):
        pieces = pieces_of(tokenizer)
        for doc_ids, ids, bounds in filled(it):
            all_pieces, at = pieces(ids), list(zip(bounds, bounds[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([ids[a:b].tobytes() for a, b in at], pa.binary()), pa.array([between.join(all_pieces[a:b]) for a, b in at], pa.string())], schema=schema)

    return parts.mapInArrow(released(of), "doc_id long, ids binary, decoded string")
