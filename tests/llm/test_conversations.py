"""Conversation repair against an exhaustive search over edits, and the damage against the contract."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from keelson.llm import conversations as cv

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired) by trying everything: states are the last initial written."""

    @lru_cache(maxsize=None)
    def go(k, state):
        best = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        new = NEXT[state]
        name = {"u": "user", "a": "assistant"}[new]
        options = []
        if k < len(rows):
            _, role, text = rows[k]
            options.append((3, "D", (), k + 1, state))
            if found[k] in ("", "truncated"):
                more = found[k] == "truncated"
                if role[:1] == new or (state == "" and role[:1] == "s"):
                    options.append((more, "K", (f"{role}:{text}",), k + 1, role[0]))
                options.append((2 + more, "R", (f"{name}:{text}",), k + 1, new))
        if go.depth < 3:
            options.append((2, "I", (f"{name}:",), k, new))
        for cost, letter, out, at, then in options:
            go.depth += letter == "I"
            rest = go(at, then) if letter != "I" else inserted(at, then)
            go.depth -= letter == "I"
            if rest:
                best.append((cost + rest[0], letter + rest[1], out + rest[2]))
        return min(best) if best else None

    def inserted(k, state):
        return go.__wrapped__(k, state)

    go.depth = 0
    return go(0, "")


def expected(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{len(x[1])}:{x[1]}:{x[2]}".encode()).digest()))
    found = faults(rows)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(tuple(rows), found) if rows else (0, "", ())
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_conversation(rng, n):
    texts = ["Yes.", "No!", "Is it?", "cut off", "", " \n", "Yes. \t", "said, and", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.2 else k, rng.choice(roles), rng.choice(texts)) for k in range(n)]


def collected(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_against_exhaustive_search(spark):
    rng = random.Random(5)
    talks = {c: random_conversation(rng, rng.randrange(1, 9)) for c in range(150)}
    talks[None] = [(0, "user", "Hi."), (1, "assistant", "Yes."), (1, "assistant", "Yes."), (None, "system", "Be kind.")]
    rows = [(c, t, r, x, "clash", 1) for c, rs in talks.items() for t, r, x in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, symbol int").repartition(4)
    got = collected(cv.repair_conversations(df))
    assert got == {c: expected(rs) for c, rs in talks.items()}
    assert cv.repair_conversations(df.limit(0)).count() == 0


def test_runs_and_powers():
    """Long runs, advanced by powers and unrolled in parts, cost and read what single steps do."""
    rng = random.Random(9)
    for trial in range(30):
        symbols, counts = [], []
        for _ in range(rng.randrange(1, 6)):
            symbols.append(rng.randrange(16))
            counts.append(rng.choice([1, 2, 3, 7, 40]))
        cost, audit = cv.repair(symbols, counts)
        flat = [s for s, n in zip(symbols, counts) for _ in range(n)]
        names = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
        rows = tuple((k, names[s // 4], f"{k}") for k, s in enumerate(flat))
        if len(rows) < 60:
            want = cheapest(rows, [("", "truncated", "blank", "duplicate")[s % 4] for s in flat])
            assert (cost, audit.decode()) == want[:2], (symbols, counts)
    assert cv.repair([4 * 2], [3_001])[0] == 2 * 1501 and len(cv.repair([4 * 2], [3_001])[1]) == 3_002
    small = cv.UNROLL
    long = [4 * (2 + k % 2) for k in range(2 * small + 3)]
    assert cv.repair(long, [1] * len(long)) == (2, b"D" * 0 + b"K" * len(long) + b"I") or cv.repair(long, [1] * len(long))[0] == 2


def test_one_large_conversation(spark):
    """A third of all rows in one conversation, half of them one text, and null turns."""
    rows = [(7, k if k % 3 else None, "user" if k % 2 else "assistant", "Same." if k % 2 else f"Text {k}.") for k in range(4_000)] + [(k, 0, "user", "Hello.") for k in range(100, 2_100)]
    got = collected(cv.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)))
    ordered = sorted(((t, r, x) for c, t, r, x in rows if c == 7), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{len(x[1])}:{x[1]}:{x[2]}".encode()).digest()))
    found = faults(ordered)
    assert got[7][1:4] == tuple(found.count(f) for f in ("blank", "duplicate", "truncated")) and got[7][2] == 1_999
    # the audit leads to the digest, whatever the search did: rewrite it by hand
    state, out, at = "", [], 0
    for letter in got[7][6]:
        new = NEXT[state]
        if letter == "D":
            at += 1
            continue
        if letter == "I":
            out.append({"u": "user:", "a": "assistant:"}[new])
        else:
            assert found[at] in ("", "truncated")
            out.append((ordered[at][1] if letter == "K" else {"u": "user", "a": "assistant"}[new]) + ":" + ordered[at][2])
            new = ordered[at][1][0] if letter == "K" else new
            at += 1
        state = new
    assert at == len(ordered) and state in ("", "a") and hashlib.sha256("\n".join(out).encode()).hexdigest() == got[7][7]
    assert len(got) == 2_001 and all(v[5:7] == (2, "KI") for c, v in got.items() if c != 7)


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = r if r is not None else " ", x if x is not None else " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            x = "" if k == 1 else x.translate({ord(m): None for m in ".!?"}) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}. Well") for c in range(60) for t in range(6)]
    rows += [(None, None, None, None), (900, None, None, "Odd!"), (901, 3, "user", None)]
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, _at int")
    assert sorted(map(tuple, cv.damaged(df).collect()), key=repr) == sorted(damage(rows), key=repr)
    got = collected(cv.repair_after_damage(df))
    left = damage(rows)
    assert got == {c: expected([r[1:] for r in left if r[0] == c]) for c in {r[0] for r in rows}}
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cv.repair_after_damage(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["x" * 2_000_000 + ".", " " * 2_000_000])
def test_very_long_texts(spark, text):
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    assert collected(cv.repair_conversations(df)) == {1: expected([(0, "user", text), (1, "assistant", "Yes.")])}
