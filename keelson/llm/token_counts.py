"""Token counts from distinct pre-tokens.

The corpus's distinct pre-tokens are tokenized once each, for their number of pieces. A document is a
bag of pre-tokens; its count is the sum of frequency times pieces over a join with that table, and no
ids are ever made. Frequent pre-tokens are looked up in the task (a head of bounded size), the others
by a shuffle join; see :mod:`keelson.llm.lexicon`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import durable, words_text
from keelson.llm.lexicon import HEAD_WORDS, count_words, key_of, row_ids, slices, split_head
from keelson.llm.tokens import Cached, all_units, byte_pre_tokens, byte_units, piece_ids, segments, specials


def pre_tokens(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``(word, n)``: the corpus's distinct pre-tokens with their frequencies."""
    return count_words(docs.select(words_text(text)), lambda: (all_units(tokenizer, byte_units), byte_pre_tokens(tokenizer)))


def bag(path: str, pieces: dict[str, int]) -> Callable[[str], tuple[int, dict[str, int]]]:
    """A function from a text to (its pieces as far as ``pieces`` has its pre-tokens, the frequencies of the others)."""
    cut, units, added = byte_pre_tokens(path), all_units(path, byte_units), specials(path)

    def known(unit: str) -> tuple[int, tuple[str, ...]]:
        words = cut(unit)
        return sum(pieces.get(w, 0) for w in words), tuple([w for w in words if w not in pieces])

    split = Cached(known)

    def of(text: str) -> tuple[int, dict[str, int]]:
        total, rare = 0, {}
        for unit, n in Counter(units(text)).items():
            k, words = split[unit]
            total += k * n
            for w in words:
                rare[w] = rare.get(w, 0) + n
        if any(s in text for s in added):
            total += sum(is_special for _, is_special in segments(path, text))
        return total, rare

    return of


def count_pieces(words: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``pieces`` to ``(word, n)``: how many ids the pre-token has."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("pieces", pa.int64())])

    def of(it):
        cut = piece_ids(tokenizer)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(cut(w)) for w in batch.column(0).to_pylist()], pa.int64())], schema=schema)

    return words.mapInArrow(of, "word string, n long, pieces long")


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), head_words: int = HEAD_WORDS) -> DataFrame:
    """One row for each row of ``docs``: the columns ``keep``, ``n_bytes`` (UTF-8) and ``n_tokens``.

    A null or empty text has 0 tokens. Added tokens' strings count as one token each, as in the
    library's default. Rows with the same key stay rows of their own. Other columns are left out;
    ``keep`` columns may have any names but ``n_bytes`` and ``n_tokens``.
    """
    lexicon = durable(count_pieces(pre_tokens(docs, tokenizer, text), tokenizer), "pre-tokens")
    head, tail = split_head(lexicon.select("word", "n", "pieces"), head_words)
    known = docs.sparkSession.sparkContext.broadcast((head.column("word").to_pylist(), head.column("pieces").to_pylist()))
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], words_text(text).alias("text"))
    kept = [f for f in source.schema.fields if f.name != "text"]
    schema = "row long, word string, freq long, n_bytes long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def split(it):
        of, ids = bag(tokenizer, dict(zip(*known.value))), row_ids()
        for batch in slices(it):
            rows, words, freqs, sizes, at = [], [], [], [], []
            for i, x in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                (total, rare), row = of(x), next(ids)
                rows += [row] * (1 + len(rare))
                words += [None, *rare]
                freqs += [total, *rare.values()]
                sizes += [len(x.encode())] + [None] * len(rare)
                at += [i] + [None] * len(rare)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(words, pa.string()), pa.array(freqs, pa.int64()), pa.array(sizes, pa.int64())] + [batch.column(j).take(pa.array(at, pa.int32())) for j in range(batch.num_columns - 1)],
                names=["row", "word", "freq", "n_bytes", *[f.name for f in kept]],
            )

    found = source.mapInArrow(split, schema).withColumn("key", key_of("word", "row"))
    joined = found.join(tail.select(F.col("word").alias("key"), "pieces"), "key", "left")
    one = [F.max(F.when(F.col("word").isNull(), F.col(f.name))).alias(c) if f.dataType.simpleString() != "boolean" else F.bool_or(F.when(F.col("word").isNull(), F.col(f.name))).alias(c) for f, c in zip(kept, keep)]
    total = F.sum(F.when(F.col("word").isNull(), F.col("freq")).otherwise(F.col("freq") * F.col("pieces")))
    return joined.groupBy("row").agg(*one, F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens")).drop("row")
