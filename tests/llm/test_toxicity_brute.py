"""The toxicity model against plain Python and Newton's method, from the raw rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from keelson.llm import toxicity as T

MASK = (1 << 64) - 1


def slot(gram: str) -> int:
    """The hash of one n-gram, with Python's integers."""
    h, odd = len(gram), 0x9E3779B97F4A7C15
    for c in gram:
        h = (h ^ ord(c)) * odd & MASK
        h ^= h >> 29
    return (h * odd & MASK) >> (64 - T.BITS)


def grams(text):
    """How often the distinct words of a text have an n-gram, words standing between two marks."""
    out = Counter()
    for w in set((text or "").lower().split()):
        w = "\x02" + w + "\x03"
        out.update(slot(w[i : i + n]) for n in (2, 3, 4, 5) for i in range(len(w) - n + 1))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    plain, bad = ["walk", "tree", "rivers", "stone", "lamp", "Garden", "über", "日本"], ["foul", "fouler", "vile", "vilest"]
    out = []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 9))]
        toxic = i % 4 == 0
        if rng.random() < (0.9 if toxic else 0.1):
            words += [rng.choice(bad), rng.choice(bad)]
        rng.shuffle(words)
        out.append((i, " ".join(words), int(toxic)))
    return out


def brute(train):
    """Ratios by slot, then the regularised logistic regression by Newton's method: part of a score by slot, intercept, ratios,
    and the loss as a function of the former two."""
    bags = [(grams(t), y) for t, y in train]
    docs = {y: Counter(g for b, z in bags if z == y for g in b) for y in (0, 1)}
    n = Counter(y for _, y in bags)
    ratio = {}
    for g in docs[0] | docs[1]:
        r = math.log((docs[1][g] + T.SMOOTHING) / (n[1] + 2 * T.SMOOTHING)) - math.log((docs[0][g] + T.SMOOTHING) / (n[0] + 2 * T.SMOOTHING))
        if docs[1][g] + docs[0][g] >= T.MIN_DOCS and abs(r) >= T.MIN_RATIO:
            ratio[g] = r
    used = sorted(ratio)
    x = np.array([[b[g] * ratio[g] for g in used] + [1.0] for b, _ in bags])
    y = np.array([z for _, z in bags], float)
    keep = np.diag([T.REGULARISATION] * len(used) + [0.0])
    w = np.zeros(len(used) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + keep + 1e-12 * np.eye(len(w)), x.T @ (p - y) / len(y) + keep @ w)
        w -= step
    assert np.abs(step).max() < 1e-9

    def loss(parts, intercept):
        v = np.array([parts[g] / ratio[g] for g in used] + [intercept])
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ v)).mean() + T.REGULARISATION / 2 * (v[:-1] ** 2).sum())

    return {g: a * ratio[g] for g, a in zip(used, w)}, w[-1], ratio, loss


def test_model_and_scores_are_the_plain_ones(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, toxic string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    train = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 != 0]
    assert 0 < len(train) < len(rows)
    parts, intercept, ratio, loss = brute(train)
    assert set(np.flatnonzero(model.weights).tolist()) == set(parts) == set(ratio)
    # Spark's optimiser stops a little before the minimum: many features always come together, and share their weight
    least, found = loss(parts, intercept), loss(model.weights, model.intercept)
    assert least <= found < least + 1e-4
    odd = [(900, None), (901, ""), (902, "VILE vile Vile vilest"), (903, "nothing of this is known 123"), (904, "foul " * 5000), (905, "x" * 50_000)]
    texts = [(i, t) for i, t, _ in rows] + odd + odd[2:3]  # a repeated row
    got = T.score_texts(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in texts)
    text = dict(texts)
    for r in got:
        z = intercept + sum(parts.get(g, 0.0) * k for g, k in grams(text[r["doc_id"]]).items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=0.01)
        exact = model.intercept + sum(float(model.weights[g]) * k for g, k in grams(text[r["doc_id"]]).items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-exact)), abs=1e-9)


def test_ties_repeats_and_several_labels(spark, rows):
    """Repeated documents train once a row, an id with several labels is toxic if one says so; ties of the sample go by id."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, t) for i, t, _ in rows[:40]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    flipped = {1}
    train = [(t, 1 if i in flipped else y) for i, t, y in rows + rows[:40] if zlib.crc32(str(i).encode()) % 5 != 0]
    parts = brute(train)[0]
    assert set(np.flatnonzero(T.fit(docs.repartition(4), labels).weights).tolist()) == set(parts)
    a, b = (sorted(map(tuple, T.sample(labels.repartition(k), most_toxic=7, most_other=11).collect())) for k in (1, 6))
    assert a == b and sum(y for _, y in a) == 7 and len(a) == 18
