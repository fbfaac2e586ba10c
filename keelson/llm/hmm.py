"""Language-model scoring with a hidden Markov model over words.

Counts: every word of the training texts, once each with its frequency (a lexicon; see
:mod:`keelson.llm.lexicon`). They give the unigram base score and the emission classes: the most
frequent words and the end mark are classes of their own, all others fall into classes by their last
letters, and a word's probability in its class comes from its count. So the latent part of the model
has a fixed size whatever the vocabulary.

Words are mapped to classes once: a text becomes a row of 16-bit class numbers, stored in the shared folder with what its
scores need besides. Every Baum-Welch step and the scoring read those rows.

States: Baum-Welch over all training texts in every step. A task runs the scaled forward-backward recursion over its
texts, many side by side, and hands on expected counts - a vector of fixed size - which are added up in two levels.

Scoring: the scaled forward recursion gives the exact likelihood of a text's class sequence; the
words' probabilities in their classes are added, those of rare words by a join.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import durable, words_text
from keelson.llm.lexicon import HEAD_WORDS, SLICE, count_words, row_ids, slices, split_head
from keelson.llm.tokens import Cached, contract_words

STATES = 8
TOP_WORDS = 2000
SUFFIX_CLASSES = 512
SUFFIX_CHARS = 3
#: Baum-Welch steps, each over all training texts.
STEPS = 3
SMOOTHING = 0.01
#: Cells (texts x positions) that one recursion holds.
CELLS = 200_000
#: Positions between two scalings of a recursion: so many factors, each of a class's probability, don't underflow.
SCALED = 8
#: The end mark's key: no word is empty.
END = ""
_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lower(word: str) -> str:
    """A-Z in lower case, nothing else."""
    return word.lower() if word.isascii() else word.translate(_LOWER)


def held_out(doc_id: str | Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; a null id isn't held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % folds == fold, F.lit(False))


def token_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` of the training texts, the end mark among them."""
    return count_words(train.select(words_text(text)), lambda: (lambda x: [*contract_words(x), END], lambda w: (lower(w),)))


@dataclass
class Classes:
    """Emission classes: 0 is the end mark, then the top words, then suffixes."""

    top: dict[str, int]
    suffixes: int
    denominators: np.ndarray  # by suffix class: words' count + distinct words + 1

    @property
    def size(self) -> int:
        return 1 + len(self.top) + self.suffixes

    def of(self, word: str) -> int:
        found = self.top.get(word)
        return found if found is not None else 1 + len(self.top) + zlib.crc32(word[-SUFFIX_CHARS:].encode("utf-8", "surrogatepass")) % self.suffixes


@dataclass
class Model:
    classes: Classes
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # K x classes


def suffix_of(word: str, suffixes: int) -> Column:
    return F.crc32(F.encode(F.substring(F.col(word), -SUFFIX_CHARS, SUFFIX_CHARS), "UTF-8")) % suffixes


def make_classes(lexicon: DataFrame, top_words: int = TOP_WORDS, suffixes: int = SUFFIX_CLASSES) -> tuple[Classes, np.ndarray]:
    """The classes and how many training tokens each has."""
    words = lexicon.where(F.col("word") != END)
    most = words.orderBy(F.col("n").desc(), "word").limit(top_words)
    top_rows = [(r["word"], r["n"]) for r in most.collect()]
    top = {w: i + 1 for i, (w, _) in enumerate(top_rows)}
    sums = words.groupBy(suffix_of("word", suffixes).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(suffixes), np.zeros(suffixes)
    for r in sums:
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    for w, k in top_rows:
        at = zlib.crc32(w[-SUFFIX_CHARS:].encode("utf-8", "surrogatepass")) % suffixes
        n[at] -= k
        v[at] -= 1
    ends = [r["n"] for r in lexicon.where(F.col("word") == END).collect()]
    return Classes(top, suffixes, n + v + 1), np.array([sum(ends), *[k for _, k in top_rows], *n])


def first_model(classes: Classes, totals: np.ndarray, states: int = STATES) -> Model:
    """Classes' frequencies, shaken by a fixed random stream so that the states can part."""
    rng = np.random.default_rng(7)
    emit = (totals + 1) * rng.uniform(0.2, 1.8, (states, classes.size))
    move = rng.uniform(0.5, 1.5, (states, states)) + 4 * np.eye(states)
    return Model(classes, np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def groups(lengths: np.ndarray, cells: int = CELLS) -> list[np.ndarray]:
    """Indices of sequences, longest first, in groups that fill at most ``cells`` (or hold one sequence)."""
    order = np.argsort(-lengths, kind="stable")
    out, at = [], 0
    while at < len(order):
        n = max(1, cells // max(1, int(lengths[order[at]])))
        out.append(order[at : at + n])
        at += n
    return out


def side_by_side(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions x sequences) symbols of a group, and how many sequences are that long, by position."""
    n = lengths[group]
    at = np.minimum(np.arange(n[0])[:, None], n[None, :] - 1) + starts[group][None, :]
    return symbols[at], np.searchsorted(-n, -np.arange(n[0]), side="left")


def _ahead(model: Model, a: np.ndarray, x: np.ndarray, active: np.ndarray, low: int, high: int, keep: np.ndarray | None, log: np.ndarray, scale: dict[int, np.ndarray]) -> np.ndarray:
    """The scaled forward recursion from position ``low`` up to ``high``: ``a`` (states x columns) is the state before it. Adds
    the logs of the scales to ``log``, keeps them in ``scale`` and the alphas in ``keep``; gives the state behind the last
    position. A column is scaled at its last position too, so that its scales multiply to its likelihood."""
    turn = np.ascontiguousarray(model.move.T)
    for t in range(low, high):
        d = active[t]
        e = active[t + 1] if t + 1 < len(x) else 0
        a = model.emit.take(x[t, :d], axis=1) * (model.start[:, None] if t == 0 else turn @ a[:, :d])
        first = 0 if t % SCALED == SCALED - 1 else e  # columns from here on are scaled
        if first < d:
            c = a[:, first:].sum(axis=0)
            a[:, first:] /= c
            log[first:d] += np.log(c)
            scale[t] = c if first == 0 else np.concatenate([np.ones(first), c])
        if keep is not None:
            keep[t - low, :, :d] = a
    return a


def forward(model: Model, x: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each column of ``x``."""
    log = np.zeros(x.shape[1])
    _ahead(model, np.empty((len(model.start), 0)), x, active, 0, len(x), None, log, {})
    return log


def expected(model: Model, x: np.ndarray, active: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, float]:
    """Baum's expected counts over the columns of ``x`` - starts, moves, emissions, one after another - and the sum of the
    columns' natural log likelihoods.

    Alphas are kept for ``cells`` cells at a time: of longer recursions only the state before each such part, from
    which the part's alphas are worked out again."""
    states, symbols = model.emit.shape
    step = max(1, cells // x.shape[1])
    lows = list(range(0, len(x), step))
    log, scale, before, a = np.zeros(x.shape[1]), {}, [], np.empty((states, 0))
    keep = np.empty((min(step, len(x)), states, x.shape[1]))
    for low in lows:
        before.append(a)
        a = _ahead(model, a, x, active, low, min(low + step, len(x)), keep if low == lows[-1] else None, log, scale)
    moves, emissions, start = np.zeros((states, states)), np.zeros((states, symbols)), np.zeros(states)
    beta = np.ones((states, x.shape[1]))
    ahead = None  # what the next position hands back
    for low in reversed(lows):
        high = min(low + step, len(x))
        if low != lows[-1]:
            _ahead(model, before[lows.index(low)], x, active, low, high, keep, np.zeros(x.shape[1]), {})
        for t in range(high - 1, low - 1, -1):
            d = active[t]
            gamma = keep[t - low, :, :d]
            if ahead is not None:
                e = ahead.shape[1]
                moves += gamma[:, :e] @ ahead.T
                beta[:, :e] = model.move @ ahead
            ahead = model.emit.take(x[t, :d], axis=1) * beta[:, :d]
            if t in scale:
                ahead /= scale[t]
            gamma *= beta[:, :d]
        if low == 0:
            start += keep[0, :, : active[0]].sum(axis=1)
        on = np.arange(x.shape[1])[None, :] < active[low:high, None]
        seen = x[low:high][on]
        for k in range(states):
            emissions[k] += np.bincount(seen, weights=keep[: high - low, k][on], minlength=symbols)
    return np.concatenate([start, (moves * model.move).ravel(), emissions.ravel()]), float(log.sum())


def _columns(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, lengths) of the rows' 16-bit symbols in column ``at``."""
    parts = [np.frombuffer(b, "<u2") for b in batch.column(at).to_pylist()]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts).astype(np.int64), np.cumsum(lengths) - lengths, lengths


def gather(train: DataFrame, model: Model) -> tuple[np.ndarray, float] | None:
    """Expected counts and log likelihood over all rows of ``train`` (``symbols``); None if there are none.

    A task adds up its own texts; the tasks' vectors are added in groups of about the square root of
    their number, so neither a task nor the driver meets more of them than that.
    """
    known = train.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def partial(it):
        model, total = known.value, None
        for batch in slices(it, 2 * SLICE):
            flat, starts, lengths = _columns(batch, 0)
            for g in groups(lengths):
                counts, log = expected(model, *side_by_side(flat, starts, lengths, g))
                found = np.concatenate([counts, [log]])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=out)

    def added(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array([0], pa.int32()), pa.array([sum(np.frombuffer(b) for b in table.column("counts").to_pylist()).tobytes()], pa.binary())], schema=out)

    parts = train.select("symbols").mapInArrow(partial, "part int, counts binary")
    some = max(1, math.isqrt(train.rdd.getNumPartitions()))
    rows = parts.groupBy((F.col("part") % some).alias("g")).applyInArrow(added, "part int, counts binary").collect()
    known.unpersist()
    if not rows:
        return None
    total = sum(np.frombuffer(r["counts"]) for r in rows)
    return total[:-1], float(total[-1])


def updated(model: Model, counts: np.ndarray, smoothing: float = SMOOTHING) -> Model:
    """The model that expected counts give."""
    k, symbols = model.emit.shape
    start, move, emit = counts[:k] + smoothing, counts[k : k + k * k].reshape(k, k) + smoothing, counts[k + k * k :].reshape(k, symbols) + smoothing
    return Model(model.classes, start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def fit(train: DataFrame, model: Model, steps: int = STEPS, smoothing: float = SMOOTHING) -> tuple[Model, list[float]]:
    """Baum-Welch: every step counts over all rows of ``train`` (``symbols``) and sets the model from its counts alone. Also
    gives the texts' log likelihood before each step. Without texts the model stays as it began."""
    logs = []
    for _ in range(steps):
        found = gather(train, model)
        if found is None:
            break
        model = updated(model, found[0], smoothing)
        logs.append(found[1])
    return model, logs


def _flat(texts: list[str], index: Cached) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, starts, lengths) of texts, the end mark (0) behind each."""
    words = [contract_words(x) for x in texts]
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.int64)
    for w, s in zip(words, starts.tolist()):
        if w:
            out[s : s + len(w)] = np.fromiter(map(index.__getitem__, w), np.int64, len(w))
    return out, starts, lengths


class Entries:
    """What a task knows of the words it has met, by number; entry 0 is the end mark. Numbers stay while a slice is worked
    on; ``tidy`` forgets all words if there are too many."""

    def __init__(self, make, end: tuple, most: int = 250_000):
        self.make, self.end, self.most = make, end, most
        self.tidy(True)

    def tidy(self, now: bool = False) -> None:
        if now or len(self.words) > self.most:
            self.words, self.new, self.columns = [END], [self.end], None
            self.index = Cached(self._add, 1 << 62)

    def _add(self, word: str) -> int:
        word = lower(word)
        self.words.append(word)
        self.new.append(self.make(word))
        return len(self.words) - 1

    def arrays(self) -> list[np.ndarray]:
        """By entry: the columns of what ``make`` gives."""
        if self.new:
            more = [np.array(c) for c in zip(*self.new)]
            self.columns = more if self.columns is None else [np.concatenate(x) for x in zip(self.columns, more)]
            self.new = []
        return self.columns


def code(docs: DataFrame, lexicon: DataFrame, classes: Classes, head_words: int = HEAD_WORDS) -> DataFrame:
    """``docs`` (``doc_id, text, train``) as class numbers: one row for each row with ``row`` (a number of its own), ``doc_id,
    train, symbols`` (16 bits each, the end mark's last), ``n_tokens``, the sums over the tokens of the head - ``n_known``, ``base``
    (base score), ``own`` (log10 probabilities in their classes) - and the other words with their frequencies and the log10 of
    their classes' denominators: ``words, times, below``."""
    n, v = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = sum(r["n"] for r in lexicon.where(F.col("word") == END).collect())
    head, _ = split_head(lexicon, head_words)
    known = docs.sparkSession.sparkContext.broadcast((classes, head.column("word").to_pylist(), head.column("n").to_pylist()))
    base_of = lambda c: math.log10((c + 1) / (n + v + 1))
    out = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("symbols", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("own", pa.float64())]
        + [("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64())), ("below", pa.list_(pa.float64()))]
    )

    def coded(it):
        classes, words, counts = known.value
        count, rows = dict(zip(words, counts)), row_ids()
        base_size = 1 + len(classes.top)

        def entry(w: str) -> tuple:
            """Symbol, known, base, own, below: nan for words of the head, infinite for classes of one word."""
            symbol, c = classes.of(w), count.get(w)
            shared = symbol >= base_size
            below = math.log10(classes.denominators[symbol - base_size]) if shared else math.inf
            return (symbol, 0, 0.0, 0.0, below) if c is None else (symbol, 1, base_of(c), math.log10(c + 1) - below if shared else 0.0, math.nan)

        entries = Entries(entry, (0, int(ends > 0), base_of(ends), 0.0, math.nan))
        for batch in slices(it):
            entries.tidy()
            flat, starts, lengths = _flat(batch.column(1).to_pylist(), entries.index)
            symbol, seen, base, own, below = entries.arrays()
            symbols, offsets = symbol[flat].astype("<u2"), np.concatenate([2 * starts, [2 * len(flat)]]).astype(np.int64)
            rare = np.flatnonzero(~np.isnan(below[flat]))
            pair, times = np.unique(np.searchsorted(starts, rare, side="right") - 1 << 32 | flat[rare], return_counts=True)
            which = pair & 0xFFFFFFFF
            cuts = pa.array(np.searchsorted(pair >> 32, np.arange(len(lengths) + 1)), pa.int32())
            rest = [pa.array([entries.words[i] for i in which.tolist()], pa.string()), pa.array(times, pa.int64()), pa.array(below[which], pa.float64())]
            bodies = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(symbols)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(rows) for _ in range(len(lengths))], pa.int64()), batch.column(0), batch.column(2), bodies, pa.array(lengths), pa.array(np.add.reduceat(seen[flat], starts), pa.int64()), pa.array(np.add.reduceat(base[flat], starts)), pa.array(np.add.reduceat(own[flat], starts))]
                + [pa.ListArray.from_arrays(cuts, x) for x in rest],
                schema=out,
            )

    return docs.select("doc_id", "text", "train").mapInArrow(coded, "row long, doc_id long, train boolean, symbols binary, n_tokens long, n_known long, base double, own double, words array<string>, times array<long>, below array<double>")


def score(coded: DataFrame, model: Model, lexicon: DataFrame) -> DataFrame:
    """One row for each row of ``coded`` (see :func:`code`): ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    Scores are log10 probabilities. A null or empty text is the end mark alone. A word that training
    hasn't seen has count 0. Repeated rows get the same scores.
    """
    n, v = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = coded.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "own"]
    out = pa.schema([(c, pa.float64() if c in ("base", "own") else pa.int64()) for c in names])

    def scored(it):
        model = known.value
        for batch in slices(it, 2 * SLICE):
            flat, starts, lengths = _columns(batch, len(names))
            total = np.zeros(len(lengths))
            for g in groups(lengths):
                total[g] = forward(model, *side_by_side(flat, starts, lengths, g))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(total / math.log(10) + batch.column(len(names) - 1).to_numpy())], schema=out)

    found = coded.select(*names, "symbols").mapInArrow(scored, "row long, doc_id long, n_tokens long, n_known long, base double, own double")
    entry = F.explode(F.arrays_zip("words", "times", "below")).alias("e")
    rare = coded.where(F.size("words") > 0).select("row", entry).select("row", F.col("e.words").alias("word"), F.col("e.times").alias("times"), F.col("e.below").alias("below"))
    log_c = F.log10(F.coalesce("n", F.lit(0)) + 1)
    sums = (
        rare.join(lexicon.where(F.col("word") != END).select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * (log_c - F.lit(math.log10(n + v + 1)))).alias("more_base"),
            F.sum(F.when(F.col("below") > 1e300, 0.0).otherwise(F.col("times") * (log_c - F.col("below")))).alias("more_own"),
        )
    )
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return found.join(sums, "row", "left").select("doc_id", "n_tokens", add("n_known", "more_known").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), add("base", "more_base").alias("base_score"), add("own", "more_own").alias("score"))


def score_corpus(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", train: Column | None = None, head_words: int = HEAD_WORDS, states: int = STATES, steps: int = STEPS, top_words: int = TOP_WORDS, suffixes: int = SUFFIX_CLASSES) -> DataFrame:
    """Learn from the rows where ``train`` holds (default: not :func:`held_out`) and score all rows, see :func:`score`.
    Other columns are left out."""
    if 1 + top_words + suffixes > 1 << 16:
        raise ValueError("more classes than 16 bits tell apart")
    mine = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_text(text).alias("text"), F.coalesce(~held_out(doc_id) if train is None else train, F.lit(False)).alias("train"))
    lexicon = durable(token_counts(mine.where("train").select("text")), "words")
    classes, totals = make_classes(lexicon, top_words, suffixes)
    coded = durable(code(mine, lexicon, classes, head_words), "coded")
    model, _ = fit(coded.where("train"), first_model(classes, totals, states), steps)
    return score(coded, model, lexicon)
