"""Personal data, also in disguise: offset-preserving deobfuscation.

Plain identifiers are found in the text as it is. Then a text goes through a cascade of transducers, each of which rewrites
pieces and keeps where they came from: homoglyphs (letters and digits of other scripts that look alike, compatibility forms,
invisible characters), at/dot disguises, spelled digits, and letters that stand for digits. The same detectors run over the
normalised text, and what they find is mapped back, transducer by transducer, to the characters of the source. Spans that a
plain one contains already are left out; plain spans always stay.

All expressions are linear in the text: runs are entered at their start only, and white space in a disguise has a bound.
Spark deals the texts out; a text's result depends on that text alone, and a text without a sign of a disguise skips the
transducers.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import words_text
from keelson.llm.lexicon import by_bytes, released

KINDS = ("email", "ip", "card", "phone")

# -- plain identifiers -------------------------------------------------------------------------

_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL_HERE = re.compile(rf"{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_EMAIL_NEXT = re.compile(rf"(?<!{_LOCAL}){_EMAIL_HERE.pattern}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches. A match begins where a run of local characters does, or where the last match ended."""
    end = 0
    if "@" not in text:
        return
    while m := (end and _EMAIL_HERE.match(text, end)) or _EMAIL_NEXT.search(text, end):
        end = m.end()
        yield m.span()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (emails, ips, cards, phones)))

# -- transducers -------------------------------------------------------------------------------

#: Letters of other scripts that look like the Latin ones under them.
LOOKALIKE = (
    "а е о р с у х і ј ѕ ԁ ԛ ԝ һ ӏ к м т в н г п А В Е З К М Н О Р С Т У Х І Ј Ѕ Ү "
    "α ο ν ρ τ υ ι κ χ ε Α Β Ε Ζ Η Ι Κ Μ Ν Ο Ρ Τ Υ Χ ı ɑ ɡ ⅼ ꓲ ‐ ‑ ‒ – − ․ 。 ﹒ ＿",
    "a e o p c y x i j s d q w h l k m t b h r n A B E 3 K M H O P C T Y X I J S Y "
    "a o v p t u i k x e A B E Z H I K M N O P T Y X i a g l I - - - - - . . . _",
)
#: Blocks whose compatibility forms and digits are taken from the Unicode tables.
_BLOCKS = ((0xA0, 0x3400), (0xA4D0, 0xAC00), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F200), (0x1FBF0, 0x1FBFA))
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")

#: Texts of these characters have nothing to rewrite.
_LATIN = re.compile("[\x00-\x7f\u00c0-\u0130\u0132-\u017e]*")

Edits = list[tuple[int, int, int, int]]  # piece in the output (start, end), piece in the input (start, end)


def rewritten(text: str, pieces: list[tuple[int, int, str]]) -> tuple[str, Edits]:
    """``text`` with pieces (start, end, replacement) replaced, which are in order and don't overlap; and the edits."""
    out, edits, at, size = [], [], 0, 0
    for start, end, new in pieces:
        out += (text[at:start], new)
        size += start - at
        edits.append((size, size + len(new), start, end))
        size += len(new)
        at = end
    out.append(text[at:])
    return "".join(out), edits


def to_source(edits: Edits, start: int, end: int) -> tuple[int, int]:
    """A span of a transducer's output as the span of its input that it came from."""
    if not edits:
        return start, end

    def of(p: int) -> tuple[int, int]:  # of the character at p
        k = bisect_right(edits, p, key=lambda e: e[0]) - 1
        while k >= 0 and edits[k][0] == edits[k][1] and edits[k][0] > p:
            k -= 1
        if k < 0:
            return p, p + 1
        low, high, a, b = edits[k]
        return (a, b) if p < high else (b + p - high, b + p - high + 1)

    return of(start)[0], of(end - 1)[1]


@lru_cache(maxsize=1)
def _homoglyphs() -> tuple[dict[int, str], frozenset[str]]:
    table = dict(zip(map(ord, LOOKALIKE[0].split()), LOOKALIKE[1].split()))
    for low, high in _BLOCKS:
        for c in map(chr, range(low, high)):
            plain = unicodedata.normalize("NFKC", c)
            digit = unicodedata.decimal(c, None)
            if digit is not None:
                table[ord(c)] = str(digit)
            elif len(plain) == 1 and 32 <= ord(plain) < 127:
                table.setdefault(ord(c), plain)
    return table, frozenset(map(chr, table))


def unlike(text: str) -> tuple[str, Edits]:
    """Homoglyphs, letter for letter, and invisible characters, which go."""
    if text.isascii():
        return text, []
    if _LATIN.fullmatch(text):
        return text, []
    table, letters = _homoglyphs()
    if not letters.isdisjoint(text):
        text = text.translate(table)
    return rewritten(text, [(*m.span(), "") for m in _INVISIBLE.finditer(text)])


_GAP = r"[\x20\t]"
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_LABEL = "[A-Za-z0-9-]{1,63}"
_DOT_WORD = "(?:dot|punkt|punto|DOT|Dot|PUNKT|Punkt|PUNTO|Punto)"
#: A dot in disguise: in brackets, a word between spaces, between hyphens or low lines, an entity, or between spaces.
_DOT = (
    rf"(?:{_GAP}{{0,3}}{_OPEN}{_GAP}{{0,2}}(?:{_DOT_WORD}|point|\.){_GAP}{{0,2}}{_SHUT}{_GAP}{{0,3}}|{_GAP}{{1,3}}{_DOT_WORD}{_GAP}{{1,3}}"
    rf"|[-_]{_DOT_WORD}[-_]|&#46;|&#x2[eE];|&period;|%2[eE]|{_GAP}{{1,2}}\.{_GAP}{{1,2}})"
)
_DOTS = re.compile(rf"(?<=[A-Za-z0-9_]){_DOT}(?=[A-Za-z0-9])")
_AT_WORD = "(?:at|AT|At|aT|chez|bei|arroba)"
_AT_CLEAR = re.compile(rf"(?<=[A-Za-z0-9_])(?:{_GAP}{{0,3}}{_OPEN}{_GAP}{{0,2}}(?:{_AT_WORD}|@){_GAP}{{0,2}}{_SHUT}{_GAP}{{0,3}}|&#64;|&#x40;|&commat;|%40|{_GAP}{{1,3}}@{_GAP}{{0,3}}|@{_GAP}{{1,3}})(?={_LABEL}(?:{_DOT}|\.){_LABEL})")
#: ``at`` as a word is one if a domain follows that is itself disguised, or if what stands before it isn't a plain word.
_AT_BARE = re.compile(rf"(?<=[A-Za-z0-9_])(?:{_GAP}{{1,3}}{_AT_WORD}{_GAP}{{1,3}}|[_-]{_AT_WORD}[_-])(?=({_LABEL}(?:(?:{_DOT}|\.){_LABEL})+))")
_HAS_DOT = re.compile(_DOT)
_TAIL = re.compile(rf"{_LOCAL}{{1,64}}$")
_SIGNS = ("[at", "[ at", "(at", "( at", "{at", "{ at", "<at", "< at", "[@", "[ @", "(@", "( @", "{@", "<@", "&#64;", "&#x40;", "&commat;", "%40", " @", "@ ", "@\t", "\t@", " at ", "_at_", "-at-", "arroba", " bei ", " chez ", "\tat", "at\t")
_DOT_SIGNS = ("dot", "punkt", "punto", "[.", "[ .", "(.", "( .", "{.", "<.", "[point", "(point", "&#46;", "&#x2e;", "&period;", "%2e", " . ")


def at_and_dot(text: str) -> tuple[str, Edits]:
    """Disguised at signs and dots, where an identifier may be."""
    low = text.lower()
    dots = any(s in low for s in _DOT_SIGNS)
    pieces = []
    if any(s in low for s in _SIGNS):
        pieces += [(*m.span(), "@") for m in _AT_CLEAR.finditer(text)]
        for m in _AT_BARE.finditer(text):
            before = _TAIL.search(text[max(0, m.start() - 64) : m.start()])
            if _HAS_DOT.search(m[1]) or (before and re.search("[0-9._]", before[0])):
                pieces.append((*m.span(), "@"))
    if dots:
        pieces += [(*m.span(), ".") for m in _DOTS.finditer(text)]
    kept, end = [], 0
    for p in sorted(pieces):
        if p[0] >= end:
            kept.append(p)
            end = p[1]
    return rewritten(text, kept)


#: Digits as words, zero to nine, in the corpus' languages.
DIGIT_WORDS = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
_DIGIT = {w: str(k) for words in DIGIT_WORDS for k, w in enumerate(words)} | {"oh": "0", "fuenf": "5", "zwo": "2"}
_TIMES = {"double": 2, "triple": 3}
_SPELLED = "(?:" + "|".join(sorted({*_DIGIT, *_TIMES}, key=lambda w: (-len(w), w))) + ")(?![^\\W_])"
_ITEM = rf"(?:{_SPELLED}|[0-9]+)"
_SEP = r"[\x20\t,./()-]{1,3}"
_RUN = re.compile(rf"(?<![^\W_])(?:(?:plus[\x20\t]{{1,3}}|\+[\x20\t]{{0,2}}){_ITEM}|{_SPELLED}|[0-9]+(?={_SEP}{_SPELLED}))(?:{_SEP}{_ITEM})*", re.IGNORECASE)
_WORDS = frozenset({*_DIGIT, *_TIMES})


_ITEMS = re.compile(rf"(?P<plus>plus|\+)|(?P<word>{_SPELLED})|(?P<digits>[0-9]+)|(?P<gap>[^0-9A-Za-z+]+)", re.IGNORECASE)


def _as_digits(run: str) -> list[tuple[int, int, str]]:
    """Pieces (start, end, digits) of a run; a digit word with no other beside it stays, as it may well be an article."""
    tokens = [(m.lastgroup, m.start(), m.end(), m.group().lower()) for m in _ITEMS.finditer(run)]
    items = [t for t in tokens if t[0] != "gap"]
    lone = {t[1] for k, t in enumerate(items) if t[0] == "word" and not any(0 <= j < len(items) and items[j][0] == "word" for j in (k - 1, k + 1))}
    pieces, now = [], []
    for t in tokens + [("end", 0, 0, "")]:
        if t[0] == "end" or t[1] in lone:
            while now and now[-1][0] == "gap":
                now.pop()
            while now and now[0][0] == "gap":
                now.pop(0)
            if any(x[0] == "word" for x in now):
                pieces.append((now[0][1], now[-1][2], _written(now)))
            now = []
        else:
            now.append(t)
    return pieces


def _written(tokens: list[tuple[str, int, int, str]]) -> str:
    out, times, spelled, gap = [], 1, False, ""
    for kind, _, _, low in tokens:
        if kind == "plus":
            out.append("+")
        elif kind == "gap":
            gap = low
            continue
        elif low in _TIMES:
            times = _TIMES[low]
            continue
        else:
            if gap and out and out[-1] != "+":  # digits that are both spelled are one number, unless a dot parts them
                out.append("." if "." in gap else "" if spelled and kind == "word" else "-" if "-" in gap else " ")
            out.append(_DIGIT.get(low, low) * times)
            spelled, times = kind == "word", 1
        gap = ""
    return "".join(out)


def spelled_digits(text: str) -> tuple[str, Edits]:
    """Runs of digits of which two or more neighbours are words, as digits; ``plus`` before them as its sign."""
    low = text.lower()
    for mark in ",./()-+":
        low = low.replace(mark, " ")
    known = list(map(_WORDS.__contains__, low.split()))
    if not any(map(and_, known, known[1:])):
        return text, []
    return rewritten(text, [(m.start() + a, m.start() + b, new) for m in _RUN.finditer(text) for a, b, new in _as_digits(m.group())])


_MIXED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OolI](?:[\x20.()-]{0,2}[0-9OolI])++(?![A-Za-z0-9])")
_MIXED_SIGN = re.compile("[0-9][OolI]|[OolI][0-9]")
_AS_DIGITS = str.maketrans("OolI", "0011")


def letter_digits(text: str) -> tuple[str, Edits]:
    """O, o, l and I for 0 and 1 inside numbers that are mostly digits; lengths stay."""
    if not _MIXED_SIGN.search(text):
        return text, []
    pieces = []
    for m in _MIXED.finditer(text):
        run = m.group()
        letters = sum(map(run.count, "OolI"))
        if letters and 2 * letters <= sum(map(str.isdigit, run)):
            pieces.append((m.start(), m.end(), run.translate(_AS_DIGITS)))
    if not pieces:
        return text, []
    return rewritten(text, [p for start, _, new in pieces for p in ((start + k, start + k + 1, c) for k, c in enumerate(new) if text[start + k] != c)])


TRANSDUCERS = (unlike, at_and_dot, spelled_digits, letter_digits)


def normalised(text: str) -> tuple[str, list[Edits]]:
    """The text behind the cascade, and each transducer's edits."""
    trail = []
    for step in TRANSDUCERS:
        text, edits = step(text)
        trail.append(edits)
    return text, trail


def find(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, plain, value) in code points, by kind and place; ``value`` is the identifier as it was read."""
    normal, trail = normalised(text)
    out = []
    for kind, detect in DETECTORS.items():
        base = list(detect(text))
        spans = [(a, b, True, text[a:b]) for a, b in base]
        if normal != text:
            starts = [a for a, _ in base]
            for a, b in detect(normal):
                value = normal[a:b]
                for edits in reversed(trail):
                    a, b = to_source(edits, a, b)
                k = bisect_right(starts, a) - 1
                if not (k >= 0 and b <= base[k][1]):
                    spans.append((a, b, False, value))
        out += [(kind, *s) for s in sorted(spans)]
    return out


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("value", pa.string())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("found", _FOUND)])


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, found``, an array of ``kind, start, end, plain, value``.

    Spans are code points of the source text, end exclusive, by kind (email, ip, card, phone) and start. ``plain`` ones are
    matches of the text as it is and don't overlap within a kind; the others come from the normalised text and none lies
    within a plain one of its kind, though it may contain some. A null text counts as empty and has none. Repeated rows are
    searched alike; other columns are left out.
    """

    def of(it):
        for batch in by_bytes(it, 1):
            found = [[dict(zip(("kind", "start", "end", "plain", "value"), x)) for x in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND)], schema=_OUT)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_text(text).alias("text"))
    return rows.mapInArrow(released(of), "doc_id long, found array<struct<kind:string,start:long,end:long,plain:boolean,value:string>>")


def masked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in angle brackets; of overlapping spans, the union."""

    def of(it):
        for batch in by_bytes(it, 1):
            out = []
            for t in batch.column(1).to_pylist():
                pieces: list[tuple[int, int, str]] = []
                for kind, a, b, *_ in sorted(find(t), key=lambda x: (x[1], -x[2])):
                    if pieces and a < pieces[-1][1]:
                        pieces[-1] = (pieces[-1][0], max(b, pieces[-1][1]), pieces[-1][2])
                    else:
                        pieces.append((a, b, f"<{kind}>"))
                out.append(rewritten(t, pieces)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_text(text).alias("text"))
    return rows.mapInArrow(released(of), "doc_id long, text string")


def digested(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, plain spans counted by kind, their digest, all spans as a string, and how many were in disguise."""
    found = find_personal_data(docs, text, doc_id)
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    plain = F.filter("found", lambda x: x["plain"])

    def counted(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["plain"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(counted, KINDS), F.sha2(F.encode(written(plain), "UTF-8"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: ~x["plain"])).cast("long").alias("n_disguised"))
