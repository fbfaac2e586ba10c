"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the character n-grams of its distinct words, each word between two marks; the
value of a feature is how often the distinct words have it. Every feature is scaled by r = log((p / |p|) /
(q / |q|)), p and q being its smoothed counts in toxic and other training texts, and Spark's logistic
regression is fitted on the scaled features. As the model is linear and the features add up over
words, a word's part of a score is a number, worked out once for each distinct word a task meets.

The model is fitted on a sample of labelled rows of bounded size (``MOST_TOXIC`` + ``MOST_OTHER``
rows, chosen by a hash of the id), and the intercept is corrected for the rates at which the two classes
were taken, so that a score doesn't depend on where the bound cuts; scoring reads every text whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keelson.llm.common import durable, words_text
from keelson.llm.lexicon import released, slices

SIZES = (2, 3, 4, 5)
BITS = 18
#: The bound of the training sample.
MOST_TOXIC, MOST_OTHER = 4000, 6000
MIN_DOCS = 3  # training texts that a feature must be in
SMOOTHING = 1.0
MIN_RATIO = 0.5  # features with a smaller |r| tell nothing and are left out
REGULARISATION = 1e-3
FOLDS = 5
#: Words whose part of a score a task keeps.
CACHED_WORDS = 150_000
#: Words whose n-grams are worked out at a time.
TOGETHER = 10_000


def held_out(doc_id: str | Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; a null id isn't held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % folds == fold, F.lit(False))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def windows(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of words, each between two marks: (features, number of the word), for all words at once."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters from here to the word's end
    features, of = [], []
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[at + i]) * _ODD
            h ^= h >> np.uint64(29)
        features.append((h * _ODD >> np.uint64(64 - bits)).astype(np.int64))
        of.append(word[at])
    return np.concatenate(features), np.concatenate(of)


def text_words(text: str) -> set[str]:
    return set(text.lower().split())


@dataclass
class Model:
    weights: np.ndarray  # by feature, the ratio already multiplied in
    intercept: float

    def scorer(self):
        """texts -> probabilities. Words' parts are worked out together, for all words that are new."""
        weights, bits, parts = self.weights, int(math.log2(len(self.weights))), {}

        def score(texts: list[str]) -> list[float]:
            bags = [text_words(x) for x in texts]
            if len(parts) > CACHED_WORDS:
                parts.clear()
            all_new = list(set().union(*bags) - parts.keys())
            for low in range(0, len(all_new), TOGETHER):
                new = all_new[low : low + TOGETHER]
                features, of = windows(new, bits)
                parts.update(zip(new, np.bincount(of, weights=weights[features], minlength=len(new)).tolist()))
            z = [self.intercept + math.fsum(map(parts.__getitem__, b)) for b in bags]
            return [1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x)) for x in z]

        return score


def _labelled(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """``(doc_id, toxic)`` of the labelled ids outside the held-out fold. Null labels and ids are left out; an id with
    several labels counts as toxic if one says so."""
    ok = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    return ok.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER) -> DataFrame:
    """``(doc_id, toxic)`` of at most ``most_toxic`` + ``most_other`` labelled ids outside the held-out fold.

    Two ordered takes, so no task gathers more than the bound.
    """
    ok = _labelled(labels, doc_id, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return ok.where("toxic = 1").orderBy(*order).limit(most_toxic).union(ok.where("toxic <> 1").orderBy(*order).limit(most_other).withColumn("toxic", F.lit(0)))


def log_rates(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER) -> float:
    """log(rate of toxic / rate of other) at which :func:`sample` takes the two classes: by so much a fit on the sample
    has its log-odds too high. 0 if it takes all, or a class is empty."""
    toxic, other = _labelled(labels, doc_id, label).agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    return math.log(min(1, most_toxic / toxic) / min(1, most_other / other)) if toxic and other else 0.0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", bits: int = BITS, most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER) -> Model:
    """Fit on the labelled sample; the intercept is set back to the classes' shares among all labelled rows. Without rows
    of both classes the model gives the share of toxic rows (one half without any)."""
    chosen, extra = sample(labels, doc_id, label, most_toxic, most_other), log_rates(labels, doc_id, label, most_toxic, most_other)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_text(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    counted = pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def features(it):
        for batch in slices(it):
            at, times = [], []
            for x in batch.column(1).to_pylist():
                words = list(text_words(x))
                a, n = np.unique(windows(words, bits)[0], return_counts=True) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
                at.append(a.astype(np.int32))
                times.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], schema=counted)

    stored = durable(rows.mapInArrow(released(features), "toxic int, at array<int>, times array<int>"), "features")
    classes = {r["toxic"]: r["n"] for r in stored.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    size, n = 1 << bits, sum(classes.values())
    if len(classes) < 2:
        share = (classes.get(1, 0) + 0.5) / (n + 1)
        return Model(np.zeros(size), math.log(share / (1 - share)))
    # by feature: as many rows as the hash space has, whatever the input
    counts = stored.select("toxic", F.explode("at").alias("at")).groupBy("at").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).where(F.col("p") + F.col("q") >= MIN_DOCS).toArrow()
    p, q = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    at = counts.column("at").to_numpy()
    p[at] += counts.column("p").to_numpy()
    q[at] += counts.column("q").to_numpy()
    ratio = np.log(p / (classes[1] + 2 * SMOOTHING)) - np.log(q / (classes[0] + 2 * SMOOTHING))
    use = np.zeros(size, bool)
    use[at] = True
    use &= np.abs(ratio) >= MIN_RATIO
    # the features in use, numbered densely, so that the optimiser's vectors are no longer than need be
    number = np.cumsum(use) - 1
    width = int(use.sum())
    if not width:
        share = classes[1] / n
        return Model(np.zeros(size), math.log(share / (1 - share)) - extra)
    spread = docs.sparkSession.sparkContext.broadcast((use, number.astype(np.int32), ratio))
    scaled = pa.schema([("label", pa.float64()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def vectors(it):
        use, number, ratio = spread.value
        for batch in slices(it):
            at, offsets = batch.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            on = use[at]
            cuts = pa.array(np.concatenate([[0], np.cumsum(on)])[offsets], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.float64()), pa.ListArray.from_arrays(cuts, pa.array(number[at[on]])), pa.ListArray.from_arrays(cuts, pa.array(batch.column(2).flatten().to_numpy()[on] * ratio[at[on]]))], schema=scaled
            )

    # a sparse vector is stored as this struct
    parts = stored.mapInArrow(released(vectors), "label double, indices array<int>, values array<double>")
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), "indices", "values").alias("features")
    training = durable(parts.select("label", vector), "vectors", StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))
    found = LogisticRegression(maxIter=60, regParam=REGULARISATION, standardization=False).fit(training)
    spread.unpersist()
    weights = np.zeros(size)
    weights[use] = found.coefficients.toArray()
    return Model(weights * ratio, float(found.intercept) - extra)


def score_texts(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, score``. Null and empty texts get the intercept's score.
    Repeated rows get the same score. Other columns are left out."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def of(it):
        score = known.value.scorer()
        for batch in slices(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()), pa.float64())], schema=out)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_text(text).alias("text")).mapInArrow(released(of), "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``most``, with all their columns: filtered while scanning, without a
    join. Null and empty texts get the intercept's score."""
    known = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, doc_id))
    at = docs.columns.index(text)

    def of(it):
        score = known.value.scorer()
        for batch in slices(it):
            yield batch.filter(pa.array([p < most for p in score([x or "" for x in batch.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(released(of), docs.schema)
