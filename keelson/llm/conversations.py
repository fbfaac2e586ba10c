"""Repair of conversations' structure by a dynamic programme over run lengths.

A row is a symbol of its role's initial and its fault. Equal consecutive symbols are one run. The cheapest repair is a shortest
path through four states (nothing yet; behind a system, a user, an assistant row), and a symbol's effect on the vector of
costs-to-go is one min-plus matrix, so a run of any length is a product of that matrix's cached powers of two. The
vectors are worked out from the last run to the first; then choices are unrolled from the first row on, always the
smallest letter among the cheapest.

In Spark: rows that are equal in all they have are counted before anything is sorted; a text that a conversation has at
several turns is found by aggregation, with frequent ones broadcast. One shuffle by conversation then brings, for each, first
its narrow rows (turn, symbol, count) and behind them its texts, in the same order. So a task decides on the symbols, a byte an
edit, and then digests texts as they stream by: neither texts nor rows of a conversation are ever held. One conversation ends in
one task because its result is one row with one digest over its texts in order.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import durable, fresh, join_hot
from keelson.llm.lexicon import by_bytes, released

RELABEL, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: States; rows of the repaired conversation must lead from the first one to one of ``DONE``.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
DONE = (NOTHING, ASSISTANT)
#: The state behind a row of a user or assistant that is put there, by the state before it.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
#: Faults, and a symbol: 4 * (1 + index of the initial, or 0) + fault.
WELL, TRUNCATED, BLANK, DUPLICATE = range(4)
LEGAL = {"su", "ua", "au"}
INF = 1 << 40
#: Rows of a run that are unrolled at a time.
UNROLL = 1024
_TRIM = " \t\n\u000b\f\r"


@lru_cache(maxsize=None)
def _steps(symbol: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """What can be done to a row, by the letter: for each state (cost, state behind it)."""
    role, fault = divmod(symbol, 4)
    out = [("D", [(DELETE, s) for s in range(4)])]
    if fault in (WELL, TRUNCATED):
        more = CUT_OFF if fault == TRUNCATED else 0
        kept = {SYSTEM: {NOTHING: SYSTEM}, USER: {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, ASSISTANT: {USER: ASSISTANT}}.get(role, {})
        out.append(("K", [(more, kept[s]) if s in kept else (INF, s) for s in range(4)]))
        out.append(("R", [(RELABEL + more, NEXT[s]) for s in range(4)]))
    return out


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple[tuple[int, ...], ...]:
    """The min-plus matrix of ``2 ** k`` rows of a symbol, with what is inserted before each."""
    if k:
        half = power(symbol, k - 1)
        return tuple(tuple(min(half[a][m] + half[m][b] for m in range(4)) for b in range(4)) for a in range(4))
    row = [[INF] * 4 for _ in range(4)]
    for _, to in _steps(symbol):
        for s, (cost, t) in enumerate(to):
            row[s][t] = min(row[s][t], cost)
    for _ in range(3):
        row = [[min(row[s][t], INSERT + row[NEXT[s]][t]) for t in range(4)] for s in range(4)]
    return tuple(map(tuple, row))


def _before(symbol: int, count: int, costs: tuple) -> tuple:
    """Costs-to-go before ``count`` rows of a symbol, from those behind them."""
    k = 0
    while count:
        if count & 1:
            m = power(symbol, k)
            costs = tuple(min(m[s][t] + costs[t] for t in range(4)) for s in range(4))
        count >>= 1
        k += 1
    return costs


#: Costs-to-go behind the last row: what is missing is inserted.
_END = tuple(0 if s in DONE else INSERT if NEXT[s] in DONE else 2 * INSERT for s in range(4))


def repair(symbols: Sequence[int], counts: Sequence[int]) -> tuple[int, bytes]:
    """The least cost and the letters of its edits (D, I, K, R), the ASCII-least of equally cheap ones, for runs of ``counts``
    rows of ``symbols``. Of the vectors at the runs' ends every ``UNROLL``-th is held; the others are worked out again."""
    held, costs = [], _END
    for k in range(len(symbols) - 1, -1, -1):
        if (k + 1) % UNROLL == 0 or k == len(symbols) - 1:
            held.append(costs)
        costs = _before(symbols[k], counts[k], costs)
    total, state, audit = costs[NOTHING], NOTHING, bytearray()
    for first in range(0, len(symbols), UNROLL):
        last = min(first + UNROLL, len(symbols))
        behind = [held.pop()]  # of the runs from first to last, the last one's first
        for k in range(last - 1, first, -1):
            behind.append(_before(symbols[k], counts[k], behind[-1]))
        for k in range(first, last):
            state = _unroll(symbols[k], counts[k], behind.pop(), state, audit)
    while state not in DONE:
        audit += b"I"
        state = NEXT[state]
    return total, bytes(audit)


def _unroll(symbol: int, count: int, behind: tuple, state: int, audit: bytearray) -> int:
    """Adds the letters of a run's edits to ``audit``; the state behind it. ``behind``: the costs-to-go there."""
    steps = _steps(symbol)
    for at in range(0, count, UNROLL):
        here = min(UNROLL, count - at)
        inside = [_before(symbol, count - at - here, behind)]
        for _ in range(here):
            inside.append(_before(symbol, 1, inside[-1]))
        for j in range(here, 0, -1):
            left, then = inside[j], inside[j - 1]
            while True:
                options = [(letter, to[state][1]) for letter, to in steps if to[state][0] + then[to[state][1]] == left[state]]
                inserted = INSERT + left[NEXT[state]] == left[state]
                if inserted and not (options and options[0][0] < "I"):
                    audit += b"I"
                    state = NEXT[state]
                    continue
                audit += options[0][0].encode()
                state = options[0][1]
                break
    return state


#: Most conversations are one of few sequences of symbols; those of up to so many runs are looked up.
SHORT = 64
_cached = lru_cache(maxsize=20_000)(repair)

OUT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Conversation:
    """What is held of a conversation while its rows stream by: runs, counters, then letters and a digest."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.counts = conv_id, array("B"), array("q")
        self.faults, self.illegal, self.before = [0] * 4, 0, None
        self.least = self.most = None
        self.turns = 0
        self.audit, self.sha = None, hashlib.sha256()

    def add(self, turn, symbol: int, count: int) -> None:
        role, fault = divmod(symbol, 4)
        name = INITIALS[role - 1] if role else "?"
        if self.before is not None and self.before + name not in LEGAL:
            self.illegal += 1
        self.before = name
        self.illegal += count - 1  # equal initials never follow one another
        self.faults[fault] += 1
        again = fault if fault == BLANK else DUPLICATE
        self.faults[again] += count - 1
        for s, n in ((symbol, 1), (4 * role + again, count - 1)):
            if n and self.symbols and self.symbols[-1] == s:
                self.counts[-1] += n
            elif n:
                self.symbols.append(s)
                self.counts.append(n)
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn

    def decide(self) -> None:
        self.cost, self.audit = _cached(tuple(self.symbols), tuple(self.counts)) if len(self.symbols) <= SHORT else repair(self.symbols, self.counts)
        self.symbols = self.counts = None
        self.at, self.state, self.any = 0, NOTHING, False

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == 73:  # I
            self.state = NEXT[self.state]
            self._put(NAMES[self.state], "")
            self.at += 1

    def read(self, role: str, text: str) -> None:
        self._inserts()
        edit = chr(self.audit[self.at])
        self.at += 1
        if edit == "K":
            self.state = 1 + INITIALS.index(role[0])
            self._put(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._put(NAMES[self.state], text)

    def row(self) -> tuple:
        if self.audit is None:
            self.decide()
        self._inserts()
        if self.at != len(self.audit):
            raise ValueError("texts and rows of a conversation don't match in number")
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


def _repaired(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``conv, kind, turn, symbol, count, role, text``, sorted by conversation and kind, as result rows."""
    now, held = None, []
    for batch in by_bytes(it, 6):
        conv, kind, turn, symbol, count, role, text = (c.to_pylist() for c in batch.columns)
        for k in range(batch.num_rows):
            if now is None or conv[k] != now.conv_id:
                if now is not None:
                    held.append(now.row())
                now = _Conversation(conv[k])
            if kind[k] == 0:
                now.add(turn[k], symbol[k], count[k])
            else:
                if now.audit is None:
                    now.decide()
                now.read(role[k], text[k])
        if len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), OUT.types)], schema=OUT)
            held = []
    if now is not None:
        held.append(now.row())
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), OUT.types)], schema=OUT)


def _symbol(role: Column, text: Column) -> Column:
    """The symbol of a row as far as it is known from the row alone."""
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    trimmed = F.rtrim(text, F.lit(_TRIM))
    fault = F.when(trimmed == "", BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(WELL)
    return (place * 4 + fault).cast("int")


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation of ``rows``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by ``turn``, null turns first; rows of one turn in the order of a hash of role and text, equal rows side by
    side. Null roles and texts are one space; a null ``conv_id`` is a conversation of its own. ``gaps`` are missing turns;
    the counts are of rows by their first fault; ``illegal`` of neighbours whose initials aren't su, ua or au. The repair
    leaves nothing, or an optional system row and then users and assistants in turn. Texts are the same if they have one MD5
    with their role. Other columns are left out; an empty table gives an empty one.
    """
    filled = rows.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    keyed = filled.withColumn("key", F.unhex(F.md5(F.encode(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text")), "UTF-8"))))
    narrow = keyed.select("conv", "turn", "key", _symbol(F.col("role"), F.col("text")).alias("symbol")).groupBy("conv", "turn", "key", "symbol").agg(F.count("*").alias("count"))
    narrow = durable(narrow, "turns")
    # null conversations and turns take part in joins as values of their own
    mine = [F.coalesce(F.col("conv"), F.lit(0)).alias("c"), F.col("conv").isNull().alias("no_c"), "key"]
    often = narrow.select(*mine, "turn").groupBy("c", "no_c", "key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first")).where("n > 1")
    often = durable(often, "repeated")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a text of one turn only isn't in ``often``: its rows are cold, and none of them is hot in number
    told = join_hot(narrow.select("*", *mine[:2]), often, ["c", "no_c", "key"], "n", max(total, 1), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    symbol = F.when(later & (F.col("symbol") % 4 != BLANK), F.floor(F.col("symbol") / 4) * 4 + DUPLICATE).otherwise(F.col("symbol")).cast("int")
    none = F.lit(None).cast("string")
    facts = told.select("conv", F.lit(0).alias("kind"), "turn", "key", symbol.alias("symbol"), "count", none.alias("role"), none.alias("text"))
    texts = keyed.select("conv", F.lit(1).alias("kind"), "turn", "key", F.lit(0).alias("symbol"), F.lit(1).cast("long").alias("count"), "role", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["conv", "kind", "turn", "key"]  # nulls come first
    dealt = facts.unionByName(texts).repartition(parts, "conv").sortWithinPartitions(*by).select("conv", "kind", "turn", "symbol", "count", "role", "text")
    kinds = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return dealt.mapInArrow(released(_repaired), kinds)


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", of: int = 20) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by CRC-32 of ``conv_id:turn`` modulo ``of``: 0 the row is lost, 1 its text is
    emptied, 2 its full stops, exclamation and question marks go, 3 it stands there twice, 4 its role is user. Nulls are one
    space in role, text and the hashed key."""
    at = fresh(conversations.columns, "_at")[0]
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(space(conv_id), F.lit(":"), space(turn)), "UTF-8")) % of
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), fault.alias(at)).where(F.col(at) != 0)
    changed = rows.withColumn("text", F.when(F.col(at) == 1, F.lit("")).when(F.col(at) == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    changed = changed.withColumn("role", F.when(F.col(at) == 4, F.lit("user")).otherwise(F.col("role")))
    return changed.withColumn(at, F.explode(F.when(F.col(at) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop(at)


def repair_after_damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`repair_conversations` of :func:`damaged` rows, with a row for every conversation there was: one whose rows are all
    lost has zeros, an empty audit and the digest of an empty text."""
    all_ids = conversations.select(F.col(conv_id).cast("long").alias("conv_id")).distinct()
    found = repair_conversations(damaged(conversations, conv_id, turn, role, text)).withColumnRenamed("conv_id", "_found")
    out = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left").drop("_found")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in OUT.names[1:7]], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
