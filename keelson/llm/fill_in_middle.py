"""Fill-in-middle transformation, as one pyarrow.compute pipeline over record batches.

A batch's texts become a list array of units (lines with their newline). The lists are flattened with the index of the text
each unit comes from; ordinals within a text follow from the lists' offsets. A unit's role - prefix, middle, suffix - is a
comparison of its ordinal with the text's two cuts; for each role the units are filtered, put back into lists and joined to one
piece a text, and the pieces are joined with the sentinels in the order that the form asks. No text is a Python object.

The cuts and the form come from a hash of the id, worked out by Spark beside the text, so a row's result depends on
that row alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import words_text
from keelson.llm.lexicon import by_bytes, released

#: Sentinels before the prefix, the suffix and the middle. A text that has one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
SEED = 7
#: Per cent of the texts that are transformed, and of those that take the order suffix, prefix, middle.
FIM_PERCENT, SPM_PERCENT = 100, 50

_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_BACK = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _units(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Units of all texts in order, the text that each comes from, its ordinal there, and the number of units a text."""
    lines = pc.split_pattern(text, "\n")  # a text of k newlines has k + 1 parts
    parts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(parts) - parts
    parent = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lines)
    ordinal = np.arange(len(parent)) - first[parent]
    last = ordinal == parts[parent] - 1
    flat = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), pa.scalar("", flat.type), pa.scalar("\n", flat.type)), pa.scalar("", flat.type))
    there = ~(last & (pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0))  # nothing behind the last newline
    return flat.filter(pa.array(there)), parent[there], ordinal[there], np.bincount(parent[there], minlength=len(text))


def _rebuilt(flat: pa.Array, parent: np.ndarray, chosen: np.ndarray, texts: int) -> pa.Array:
    """The chosen units of each text as one string."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parent[chosen], minlength=texts))])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), flat.filter(pa.array(chosen))), pa.scalar("", flat.type))


def transformed(batch: pa.RecordBatch, spm_percent: int, fim_percent: int) -> pa.RecordBatch:
    """``doc_id, text, h1..h4`` as ``doc_id, n, form, prefix_chars, middle_chars, output``."""
    text = pc.fill_null(batch.column(1), "").cast(pa.large_string())
    h1, h2, h3, h4 = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2, 6))
    flat, parent, ordinal, n = _units(text)
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    before, behind = ordinal < low[parent], ordinal >= high[parent]
    prefix, middle, suffix = (_rebuilt(flat, parent, role, len(text)) for role in (before, ~before & ~behind, behind))
    plain = pc.or_(pc.match_substring_regex(text, SENTINEL), pa.array((n == 0) | (h3 % 100 >= fim_percent)))
    p, s, m, none = (pa.scalar(x, text.type) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    first_s = pa.array(h4 % 100 < spm_percent)
    form = pc.if_else(plain, "plain", pc.if_else(first_s, "spm", "psm"))
    output = pc.if_else(plain, text, pc.if_else(first_s, spm, psm))
    length = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), form, *length, output.cast(pa.string())], schema=_OUT)


def restored(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``doc_id, form, output`` as ``doc_id, text``: the output cut at the sentinels, its pieces in the text's order."""
    output, form = batch.column(2).cast(pa.large_string()), batch.column(1)
    plain = pc.equal(form, "plain")
    none = pa.scalar("", output.type)
    # plain outputs may have sentinels of their own: they aren't cut
    pieces = pc.split_pattern_regex(pc.if_else(plain, PREFIX + SUFFIX + MIDDLE, output), SENTINEL)
    one, two, middle = (pc.list_element(pieces, k) for k in (1, 2, 3))
    spm = pc.equal(form, "spm")
    text = pc.binary_join_element_wise(pc.if_else(spm, two, one), middle, pc.if_else(spm, one, two), none)
    return pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(plain, output, text).cast(pa.string())], schema=_BACK)


def _hashes(doc_id: str, seed: int) -> list[Column]:
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, spm_percent: int = SPM_PERCENT, fim_percent: int = FIM_PERCENT) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` units (lines with their newline) are cut at two ordinals that a hash of ``seed`` and the id gives; ``form`` is psm
    (prefix, suffix, middle), spm (suffix, prefix, middle) or plain, for which ``output`` is the text and the lengths are null.
    A null text counts as empty and is plain; a text with a sentinel in it is plain. A null id hashes as an empty one.
    Repeated rows and rows with the same id and number of units are cut alike. Other columns are left out.
    """

    def of(it):
        for batch in by_bytes(it, 1):
            yield transformed(batch, spm_percent, fim_percent)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_text(text).alias("text"), *_hashes(doc_id, seed))
    return rows.mapInArrow(released(of), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_texts(transformed_docs: DataFrame, output: str = "output", form: str = "form", doc_id: str = "doc_id") -> DataFrame:
    """The texts that :func:`fill_in_middle` was given, ``doc_id, text``, from outputs and forms alone."""

    def of(it):
        for batch in by_bytes(it, 2):
            yield restored(batch)

    rows = transformed_docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(form), F.col(output))
    return rows.mapInArrow(released(of), "doc_id long, text string")


def digested(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """:func:`fill_in_middle` with SHA-256 digests of the output and of the text rebuilt from it in place of the texts."""
    seed = how.pop("seed", SEED)
    spm_percent, fim_percent = how.pop("spm_percent", SPM_PERCENT), how.pop("fim_percent", FIM_PERCENT)
    if how:
        raise TypeError(f"unknown: {sorted(how)}")

    def of(it):
        for batch in by_bytes(it, 1):
            out = transformed(batch, spm_percent, fim_percent)
            back = restored(out.select(["doc_id", "form", "output"]))
            yield pa.RecordBatch.from_arrays([*out.columns, back.column(1)], schema=_OUT.append(pa.field("restored", pa.string())))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_text(text).alias("text"), *_hashes(doc_id, seed))
    both = rows.mapInArrow(released(of), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256")
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
