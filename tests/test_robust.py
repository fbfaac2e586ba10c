"""Transforms from mostly wrong correspondences against planted ones and brute force."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import geometry as G
from keelson.operators import pose_graphs as PG
from keelson.operators import robust as R

COLUMNS = "k long, idx long, sx double, sy double, sz double, rx double, ry double, rz double"


def planted(n, outliers, seed, noise=0.005):
    rng = np.random.default_rng(seed)
    t = PG.shifted(np.eye(4)[None], np.r_[rng.normal(0, 1, 3), rng.normal(0, 2, 3)][None])[0]
    s = rng.uniform(-2, 2, (n, 3))
    r = G.moved(t, s) + rng.normal(0, noise, (n, 3))
    wrong = rng.choice(n, int(n * outliers), replace=False)
    r[wrong] = G.moved(t, rng.uniform(-2, 2, (len(wrong), 3)))
    right = np.ones(n, bool)
    right[wrong] = False
    return t, s, r, right


def rows(k, s, r):
    return [(k, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(s, r))]


def test_rotations_and_their_weights():
    rng = np.random.default_rng(1)
    want = PG.turns(rng.normal(size=(20, 3)))
    a = rng.normal(size=(20, 7, 3))
    b = np.einsum("nij,nmj->nmi", want, a)
    assert np.allclose(R.rotations(a, b), want)
    b[:, 3] += 5  # without a weight it doesn't count
    assert np.allclose(R.rotations(a, b, np.tile(np.arange(7) != 3, (20, 1)).astype(float)), want)


def test_best_trial_is_the_plain_loop():
    _, s, r, _ = planted(14, 0.4, 3)
    triples = np.array(list(combinations(range(14), 3)))
    best = None
    for place, t in enumerate(triples):
        la, lb = ([np.linalg.norm(p[t[i]] - p[t[j]]) for i, j in ((0, 1), (1, 2), (2, 0))] for p in (s, r))
        fit = G.kabsch(s[t], r[t])
        if any(min(x, y) < 0.9 * max(x, y) for x, y in zip(la, lb)) or fit is None:
            continue
        miss = np.linalg.norm(G.moved(fit, s) - r, axis=1)
        if miss[t].max() > 0.05:
            continue
        on = miss <= 0.05
        rank = (-on.sum(), round(float(np.sqrt((miss[on] ** 2).mean())), 9), place)
        best = min(best or rank, rank)
    for block in (1, 10, 10_000):
        got = R.best_trial(s, r, triples, 0.05, 0.9, block)
        assert (-got[0], got[2]) == (best[0], best[2]) and got[1] == pytest.approx(best[1], abs=2e-9)
    assert R.best_trial(s, r[::-1] * 50, triples, 0.001, 0.999) is None


def test_consensus_finds_what_is_planted_wherever_it_runs(spark):
    made = {k: planted(300, share, k) for k, share in ((1, 0.8), (2, 0.3), (3, 0.0))}
    data = [x for k, (_, s, r, _) in made.items() for x in rows(k, s, r)]
    rng = np.random.default_rng(7)
    data += rows(4, rng.uniform(0, 9, (40, 3)), rng.uniform(0, 9, (40, 3)))[:40] + rows(5, np.zeros((2, 3)), np.zeros((2, 3))) + rows(6, np.ones((9, 3)), np.ones((9, 3))) + [(7, 0, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    run = lambda parts: {r["k"]: r for r in R.sampled_consensus(spark.createDataFrame(data, COLUMNS).repartition(parts), "k", "run", 0.03, trials=4000, chunk=250, least=6).collect()}
    got = run(3)
    for k, (t, s, r, right) in made.items():
        deg, m = G.distance(np.array(got[k]["transform"]).reshape(4, 4), t)
        assert deg < 0.5 and m < 0.02 and got[k]["inliers"] >= right.sum() * 0.97
    assert [got[k]["trials"] for k in (1, 2, 3)] == [2000] * 3  # they stop when they may, after the first round
    assert all(got[k]["transform"] is None and got[k]["inliers"] == 0 for k in (5, 6)) and 7 not in got
    assert got[4]["trials"] == 4000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert run(5) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trials_needed(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (0.2,)], "s double").select(R.trials_needed(F.col("s"), 0.999)).collect()]
    assert got[:2] == [float("inf"), 1] and (1 - 0.2**3) ** got[2] == pytest.approx(0.001)


def test_voted_is_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        v = np.round(rng.normal(0, 0.3, n), 2)
        got, on = R.voted(v, 0.1)
        sets = [v[(v >= x) & (v <= x + 0.2)] for x in v]
        costs = [(round(float(((c - c.mean()) ** 2).sum() + (n - len(c)) * 0.01), 9), float(c.mean())) for c in sets]
        assert got == pytest.approx(min(costs)[1]) and v[on].mean() == pytest.approx(got)


@pytest.mark.parametrize("seed", range(6))
def test_truncated_transform_at_nine_in_ten_wrong(seed):
    t, s, r, right = planted(400, 0.9, seed)
    got, on = R.truncated_transform(s, r, 0.02)
    deg, m = G.distance(got, t)
    assert deg < 1 and m < 0.02 and (on & right).sum() >= 0.9 * right.sum()


def test_graduated_rotation_leaves_wrong_vectors_out():
    rng = np.random.default_rng(2)
    want = PG.turns(rng.normal(size=(1, 3)))[0]
    a = rng.normal(size=(200, 3))
    b = a @ want.T + rng.normal(0, 0.005, a.shape)
    b[:80] = rng.normal(size=(80, 3))
    rot, on = R.graduated_rotation(a, b, 0.05)
    assert np.degrees(np.linalg.norm(PG.vectors((rot @ want.T)[None]))) < 0.3 and on[80:].mean() > 0.98 and on[:80].mean() < 0.05
    exact, all_on = R.graduated_rotation(a, a @ want.T, 0.05)
    assert np.allclose(exact, want) and all_on.all()


def test_truncated_fit_rows(spark):
    t, s, r, right = planted(120, 0.8, 11)
    data = rows(1, s, r) + rows(2, s[:2], r[:2]) + rows(3, np.ones((9, 3)), np.ones((9, 3))) + [(1, 500, None, 0.0, 0.0, 0.0, 0.0, 0.0), (4, 0, float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = {x["k"]: x for x in R.truncated_fit(spark.createDataFrame(data, COLUMNS).repartition(4), "k", 0.02).collect()}
    deg, m = G.distance(np.array(got[1]["transform"]).reshape(4, 4), t)
    assert deg < 1 and m < 0.02 and got[1]["n"] == 120
    assert [(got[k]["n"], got[k]["inliers"], got[k]["transform"]) for k in (2, 3, 4)] == [(2, 0, None), (9, 0, None), (0, 0, None)]
    assert R.truncated_fit(spark.createDataFrame([], COLUMNS), "k").count() == 0 == R.sampled_consensus(spark.createDataFrame([], COLUMNS), "k").count()
