"""Personal data: plain spans against the contract's expressions, disguised ones against what they were made from."""

import hashlib
import random
import re

import pytest

from keelson.llm import pii


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    """The contract read literally."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


ODD = ["a@b.c_d@e.f", "a@b.c.@d.e", "@a.b", "x@y", "x@y.", "..@..", "a.@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111 1111 1111", "+1 (017) 555-7713", "+1", "+1+12345678", "+1 2", "+12345678)", "é@b.c", "aé@b.cé.d", "ü +49 170 1234567 😀 x@y.zz", "0" * 16, "٠١٢@x.y"]


def test_plain_spans():
    rng = random.Random(3)
    letters = "ab1.@-+ 0456()_é\n٣"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(20_000)]
    for t in texts:
        assert [x[:3] for x in pii.find(t) if x[3]] == base(t), t


#: Disguises of an identifier, and what it is.
DISGUISED = [
    ("email", "und.34 at mail7 dot example dot com", "und.34@mail7.example.com"),
    ("email", "und.34[at]mail7[dot]example.com", "und.34@mail7.example.com"),
    ("email", "und.34 (AT) mail7 (DOT) example (DOT) com", "und.34@mail7.example.com"),
    ("email", "und.34 { at } mail7.example.com", "und.34@mail7.example.com"),
    ("email", "und.34 <at> mail7 [.] example [.] com", "und.34@mail7.example.com"),
    ("email", "und.34&#64;mail7&#46;example.com", "und.34@mail7.example.com"),
    ("email", "und.34_at_mail7_dot_example.com", "und.34@mail7.example.com"),
    ("email", "und.34 @ mail7 . example . com", "und.34@mail7.example.com"),
    ("email", "und.34 at mail7.example.com", "und.34@mail7.example.com"),
    ("email", "j​ohn@ex­ample.com", "john@example.com"),
    ("email", "јоhn@еxаmрlе.cоm", "john@example.com"),
    ("email", "john＠example．com", "john@example.com"),
    ("email", "\U0001d423\U0001d428\U0001d421\U0001d427@example.com", "john@example.com"),
    ("email", "john punkt smith bei mail7 punkt example", "john.smith@mail7.example"),
    ("ip", "192 dot 168 dot 10 dot 1", "192.168.10.1"),
    ("ip", "192[.]168[.]10[.]1", "192.168.10.1"),
    ("ip", "one nine two dot one six eight dot one zero dot one one", "192.168.10.11"),
    ("ip", "１９２.168.10.1", "192.168.10.1"),
    ("ip", "١٩٢.١٦٨.1.1", "192.168.1.1"),
    ("card", "4l11 1111 1111 I111", "4111 1111 1111 1111"),
    ("card", "four one one one one one one one one one one one one one one one", "4111111111111111"),
    ("card", "four triple one, double one double one, one one one one, one one one one", "4111111111111111"),
    ("card", "4111‑1111‑1111‑1111", "4111-1111-1111-1111"),
    ("card", "4111 1111 1111 1111", "4111 1111 1111 1111"),
    ("phone", "plus one (zero one seven) five five five-seven seven one three", "+1 017 555 7713"),
    ("phone", "＋1 (017) 555-7713", "+1 (017) 555-7713"),
    ("phone", "+1 (O17) 555-77l3", "+1 (017) 555-7713"),
    ("phone", "plus vier neun eins sieben null eins zwei drei vier", "+491701234"),
]


@pytest.mark.parametrize("kind, hidden, plain", DISGUISED)
def test_disguises_are_found_and_mapped_back(kind, hidden, plain):
    for before, behind in (("", ""), ("Schön, bitte ", " und mehr"), ("é​ 😀 write to ", ", thanks"), ("fullwidth Ａ ", " а")):
        found = pii.find(before + hidden + behind)
        assert [(k, a, b, p) for k, a, b, p, _ in found] == [(kind, len(before), len(before) + len(hidden), False)], found
        only = lambda x: re.sub("[^0-9+]", "", x) if kind in ("card", "phone") else x
        assert only(found[0][4]) == only(plain)


CLEAN = ["look at example.com for more", "we met at one dot", "One of two. Three at four", "a dot matrix at the shop . Next", "call +1 one", "plus un ami", "1 O l I", "version 1.2.3 at 4", "x (at) y", "me at home. com", "Il a 12 ans", "+1 (848) 555-1373 Un an"]


def test_clean_texts_stay_clean():
    for t in CLEAN:
        assert [x for x in pii.find(t) if not x[3]] == [], t


def test_spans_and_digests(spark, docs, corpus):
    rows = corpus + [(7000 + i, t, None, None, None, "x") for i, t in enumerate(ODD + CLEAN + [h for _, h, _ in DISGUISED])]
    rows += [(7500, "user@mail7.example [dot] com", None, None, None, "")] * 2
    got = pii.digested(spark.createDataFrame(rows, docs.schema).repartition(3)).collect()
    want = []
    for r in rows:
        b, every = base(r[1] or ""), pii.find(r[1] or "")
        count = [sum(x[0] == k for x in b) for k in pii.KINDS]
        want.append((r[0], *count, hashlib.sha256(written(b).encode()).hexdigest(), written(x[:3] for x in every), len(every) - len(b)))
        assert [x[:3] for x in every] == sorted((x[:3] for x in every), key=lambda x: (pii.KINDS.index(x[0]), x[1:]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    both = [r["spans"] for r in got if r["doc_id"] == 7500]
    assert both == ["email:0:18,email:0:28"] * 2


def test_masked_and_empty(spark, docs, empty):
    df = spark.createDataFrame([(1, "a@b.c and user@mail7.example [dot] com, 1.2.3.4", None, None, None, None), (2, None, None, None, None, None)], docs.schema)
    assert {r["doc_id"]: r["text"] for r in pii.masked(df).collect()} == {1: "<email> and <email>, <ip>", 2: ""}
    assert pii.digested(empty).count() == pii.masked(empty).count() == 0


@pytest.mark.parametrize("text", [x * 1_000_000 for x in ("a", "1", " ", "1.", "a@", "+1", "1 ", "@", " at ", "(at) ", "one ", "а", "​", "dot ", "l1", ".a", "plus ", "[ ")], ids=lambda t: repr(t[:6]))
def test_very_long_texts_take_linear_time(text):
    import time

    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 60
