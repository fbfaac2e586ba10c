"""Texts as pre-tokens and ids, as the tokenizer files define them.

Asking the tokenizers library for every pre-token of every text costs many times what a regular expression does. For
texts of printable ASCII, white space and the letters of Latin-1 - where Python's ``\\w``, ``\\d`` and ``\\s`` mean what
the files' ``\\p{L}``, ``\\p{N}`` and ``\\s`` mean, lower case is letter by letter and no two characters combine - the
split is one expression over the text, and the byte-level vocabulary's ids come from its rank file; tests compare both
with the library. Every other text goes to the library as a whole.

No pre-token of either file begins in a word and goes on behind white space. So a text falls into *units* - words with the
white space before them - that can be split one by one, and a unit that was met before needn't be split again.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Entries in each of a cache's two generations.
CACHE = 120_000

#: The pre-tokenization patterns of the two files, the second pair for plain texts in Python's terms.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN_BYTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: Plain, and without the long runs of white space on which the rank file's matcher recurses too deeply.
_TAME = re.compile("(?:[\t\n\r ]{0,256}+[\x21-\x7eÀ-ÖØ-öø-ÿ]++)*+[\t\n\r ]{0,256}+")


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def specials(path: str) -> dict[str, int]:
    """Added tokens, which the library finds in a text before anything else."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@lru_cache(maxsize=4)
def _special_split(path: str):
    names = sorted(specials(path), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def segments(path: str, text: str) -> list[tuple[str, bool]]:
    """The text cut at added tokens: (part, is an added token)."""
    cut = _special_split(path)
    if cut is None or not any(s in text for s in specials(path)):
        return [(text, False)] if text else []
    return [(part, i % 2 == 1) for i, part in enumerate(cut.split(text)) if part]


def is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None


def byte_pre_tokens(path: str) -> Callable[[str], list[str]]:
    """A function from a part of a text to its pre-tokens under the byte-level file."""
    ask = load(path).pre_tokenizer.pre_tokenize_str
    return lambda text: _PLAIN_BYTE.findall(text) if is_plain(text) else [text[a:b] for _, (a, b) in ask(text)]


def word_pre_tokens(path: str) -> Callable[[str], list[str]]:
    """A function from a part of a text to its normalised pre-tokens under the word file."""
    tok = load(path)
    normal, ask = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str

    def cut(text: str) -> list[str]:
        word = text.rstrip(".,;:!?")
        if word.isalpha() and (word.isascii() or is_plain(word)):  # most units: a word and the marks behind it
            return [word.lower(), text[len(word) :]] if len(word) < len(text) else [word.lower()]
        if is_plain(text):
            return _PLAIN_WORD.findall(text.lower())
        text = normal(text)
        return [text[a:b] for _, (a, b) in ask(text)]

    return cut


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The letters of byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257..., in
    order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def piece_ids(path: str) -> Callable[[str], list[int]]:
    """A function from a pre-token to its ids."""
    tokenize, letters = load(path).model.tokenize, byte_alphabet()
    return lambda word: [t.id for t in tokenize(word.encode().decode("latin-1").translate(letters))]


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """The byte-level vocabulary from its rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_ids(path: str, ranks: str | None = None) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit bytes. ``ranks``: the rank file of the same
    byte-level vocabulary, for plain texts without long runs of white space; the library encodes all others."""
    added = tuple(specials(path))
    fast = rank_encoding(ranks).encode_ordinary if ranks else None

    def ids(text: str) -> bytes:
        if fast and _TAME.fullmatch(text) and not any(s in text for s in added):
            return np.array(fast(text), "<u4").tobytes()
        return np.array(load(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return ids


#: What ``str.split`` takes for white space and the contracts don't.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACES = re.compile("[\x20\x09-\x0d]+")


def contract_words(text: str) -> list[str]:
    """Words between white space in the contracts' sense: space and 09 to 0D."""
    if _OTHER_SPACE.search(text) is None:
        return text.split()
    return [w for w in _SPACES.split(text) if w]


#: A unit: white space and what follows it.
_UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def byte_units(text: str) -> list[str]:
    """The units of a text under the byte-level file; a text with other white space is one unit."""
    return _UNIT.findall(text) if _OTHER_SPACE.search(text) is None else [text]


def all_units(path: str, cut: Callable[[str], list[str]]) -> Callable[[str], list[str]]:
    """A function from a text to its units without the added tokens: ``cut`` splits what lies between those."""
    added = tuple(specials(path))

    def units(text: str) -> list[str]:
        if not any(s in text for s in added):
            return cut(text)
        return [u for part, is_special in segments(path, text) if not is_special for u in cut(part)]

    return units


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first[i], first[i] + 1, ...``, ``size[i]`` of them, for all i one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Cached(dict):
    """A dict that works out what is missing, of bounded size: when it is full it becomes the old
    generation, and what is used again comes back from there. So frequent keys stay."""

    def __init__(self, make, most: int = CACHE):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
