"""Packing, token counts and the BPE round trip against the tokenizers library itself."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keelson.llm import bpe, packing, token_counts

BYTE, RANKS, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_ids(corpus):
    tok = Tokenizer.from_file(BYTE)
    return [(d, tok.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in corpus]


def test_every_id_lies_in_one_piece(docs, byte_ids):
    rows = packing.pack_documents(docs, BYTE, RANKS).collect()
    assert {r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in rows} == {True}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for doc in {d for d, _ in byte_ids}:
        wanted = [ids + [0] for d, ids in byte_ids if d == doc]
        got = by_doc[doc]
        assert sum(r["length"] for r in got) == sum(map(len, wanted))
        for r in got:
            ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
            assert len(ids) == r["length"]
            assert any(r["doc_tokens"] == len(w) and ids == w[r["start"] : r["start"] + r["length"]] for w in wanted)
        if len(wanted) == 1:
            at = 0
            for r in sorted(got, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]


def test_sequences_are_full_and_gapless(docs):
    rows = packing.pack_documents(docs, BYTE, keep_ids=False).collect()
    sequences, parts = defaultdict(list), {r["sequence_id"] // packing.PER_PART for r in rows}
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    used = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        used += at
    assert used + packing.LEAST * len(sequences) + 1024 * len(parts) >= 1024 * len(sequences)


@pytest.mark.parametrize("capacity, most", [(1024, 3000), (1024, 40), (1024, 1024), (16, 100)])
def test_bins_hold_their_class(capacity, most):
    """Classes' bins have their number of whole documents, most documents that fit stay whole, and no cut makes crumbs."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, most, 5000).tolist()
    bins = packing.Bins(capacity)
    done = [x for i, n in enumerate(lengths) for x in bins.add(i, n)]
    last = list(bins.close())
    for k, pieces in done:
        whole = [p for p in pieces if p[1] + p[2] == lengths[p[0]] and capacity // p[2] == k]
        assert k == 1 and lengths[pieces[0][0]] > capacity or len(whole) >= k
        assert capacity - sum(p[2] for p in pieces) < 2 * bins.least
    assert all(0 < sum(p[2] for p in pieces) <= capacity for _, pieces in last)
    by_doc = defaultdict(list)
    for _, pieces in done + last:
        for d, start, n in pieces:
            by_doc[d].append((start, n))
            assert n >= min(bins.least, lengths[d])
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted(by_doc[d]):
            assert start == at
            at += size
        assert at == n
    fit = [d for d, n in enumerate(lengths) if n <= capacity]
    assert sum(len(by_doc[d]) > 1 for d in fit) <= 0.5 * len(fit)


def test_packing_nothing(empty):
    assert packing.pack_documents(empty, BYTE).count() == 0


@pytest.mark.parametrize("head", [1, 50, 400_000])
def test_token_counts(docs, byte_ids, corpus, head):
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, BYTE, head_words=head).collect())
    assert got == Counter((d, len((t or "").encode()), len(ids)) for (d, t, *_), (_, ids) in zip(corpus, byte_ids))


def test_count_nothing(empty):
    assert token_counts.count_tokens(empty, BYTE).count() == 0


@pytest.mark.parametrize("head", [1, 200, 400_000])
def test_round_trip(docs, corpus, head):
    tok = Tokenizer.from_file(WORD)
    two_steps = [tuple(r) for r in bpe.decode(bpe.encode(docs, WORD, head_words=head), WORD).collect()]
    assert Counter(two_steps) == Counter(tuple(r) for r in bpe.round_trip(docs, WORD, head_words=head).collect())
    got = Counter((d, hashlib.sha256(bytes(ids)).hexdigest(), text) for d, ids, text in two_steps)
    wanted = Counter()
    for d, t, *_ in corpus:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        wanted[d, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), tok.decode(ids, skip_special_tokens=False)] += 1
    assert got == wanted


def test_encode_nothing(empty):
    assert bpe.decode(bpe.encode(empty, WORD), WORD).count() == 0


def test_plain_pre_tokens_are_the_library_s(corpus):
    """The regular expressions and ranks against the library, for every plain character next to others and at random."""
    from keelson.llm import tokens

    byte, word = tokens.load(BYTE), tokens.load(WORD)
    chars = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    rng = np.random.default_rng(0)
    samples = ["".join(x) for c in chars for x in (c, c + c, "a" + c + "b", " " + c, c + " ", "1" + c + "2", "'" + c)]
    samples += ["".join(rng.choice(chars, rng.integers(1, 12))) for _ in range(20_000)] + [t for _, t, *_ in corpus if t and tokens.is_plain(t)]
    cut_byte, cut_word, ids = tokens.byte_pre_tokens(BYTE), tokens.word_pre_tokens(WORD), tokens.text_ids(BYTE, RANKS)
    for s in samples:
        assert tokens.is_plain(s)
        assert cut_byte(s) == [s[a:b] for _, (a, b) in byte.pre_tokenizer.pre_tokenize_str(s)], repr(s)
        n = word.normalizer.normalize_str(s)
        assert cut_word(s) == [n[a:b] for _, (a, b) in word.pre_tokenizer.pre_tokenize_str(n)], repr(s)
        assert ids(s) == np.array(byte.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), repr(s)


def test_library_finds_no_plain_text_in_others():
    from keelson.llm import tokens

    for c in "×÷ªº²¼½µ\x1c\x85\u0301İſŉ":
        assert not tokens.is_plain(c)


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "\n" * 1_500_000, "x" * 1_000_000, "a b " * 300_000, "\u00a0" * 100_000], ids=["spaces", "newlines", "letter", "words", "other-spaces"])
def test_very_long_texts(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    n = len(ids_of(BYTE, text))
    assert {r["doc_id"]: r["n"] for r in packing.pack_documents(docs, BYTE, RANKS, keep_ids=False).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}[1] == n + 1
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, BYTE).collect()}[1] == n
    ids = ids_of(WORD, text)
    got = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode(docs, WORD).collect()}[1]
    assert got == np.array(ids, "<u4").tobytes()
