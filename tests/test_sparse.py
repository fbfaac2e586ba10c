"""Block systems and nearest points against dense numpy."""

import resource
import time

import numpy as np
import pytest

from keelson.operators import geometry as G
from keelson.operators import pose_graphs as PG
from keelson.operators import sparse

RNG = np.random.default_rng(17)


@pytest.mark.parametrize("n, extra", [(1, 0), (2, 0), (3, 5), (12, 0), (40, 30), (25, 300)])
def test_block_systems_are_the_dense_ones(n, extra):
    a = np.r_[np.arange(n - 1), RNG.integers(0, n, extra)]
    b = np.r_[np.arange(1, n), RNG.integers(0, n, extra)]
    a, b = a[a != b], b[a != b]
    cross = RNG.normal(size=(len(a), 6, 6))
    dense = np.zeros((6 * n, 6 * n))
    for i, j, c in zip(a, b, cross):  # edges repeat, and run both ways
        dense[6 * i : 6 * i + 6, 6 * j : 6 * j + 6] += c
        dense[6 * j : 6 * j + 6, 6 * i : 6 * i + 6] += c.T
    diagonal = np.tile(np.eye(6) * (np.abs(dense).sum(axis=1).max() + 1), (n, 1, 1))
    for i in range(n):
        dense[6 * i : 6 * i + 6, 6 * i : 6 * i + 6] += diagonal[i]
    right = RNG.normal(size=(n, 6))
    plan = sparse.elimination(n, a, b)
    got = sparse.solved(plan, sparse.assembled(plan, diagonal, cross), right)
    assert np.allclose(got.ravel(), np.linalg.solve(dense, right.ravel()), atol=1e-12)


def test_parts_without_a_link_are_solved_each_for_itself():
    plan = sparse.elimination(4, np.array([0, 2]), np.array([1, 3]))
    cross = np.array([[[1.0]], [[2.0]]])
    got = sparse.solved(plan, sparse.assembled(plan, np.full((4, 1, 1), 3.0), cross), np.array([[1.0], [2], [3], [4]]))
    want = np.linalg.solve([[3, 1, 0, 0], [1, 3, 0, 0], [0, 0, 3, 2], [0, 0, 2, 3.0]], [1, 2, 3, 4])
    assert np.allclose(got[:, 0], want)


def test_ten_thousand_anchors_fit_in_little_memory():
    n = 10_000
    t = np.tile(np.eye(4), (n, 1, 1))
    angle = np.arange(n) * 2 * np.pi / 500  # a circle, twenty times
    t[:, 0, 3], t[:, 1, 3] = 20 * np.cos(angle), 20 * np.sin(angle)
    chain = np.arange(n - 1)
    a = np.r_[chain, np.arange(0, n - 500, 25)]
    b = np.r_[chain + 1, np.arange(500, n, 25)]
    z = PG.inverses(t[b]) @ t[a]
    drift = PG.shifted(t, np.hstack([np.zeros((n, 5)), 1e-4 * np.arange(n)[:, None]]))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    got, first, last = PG.optimise(drift, a, b, z, np.ones((len(a), 6)), 100.0, 30)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB
    assert np.abs(last).max() < 1e-6 < np.abs(first).max()
    assert np.abs(got[:, :3, 3] - t[:, :3, 3] - (drift[0, :3, 3] - t[0, :3, 3])).max() < 1e-3
    assert time.time() - began < 120


@pytest.mark.parametrize("n, m, spread", [(0, 5, 1), (5, 0, 1), (1, 1, 1), (400, 300, 2), (300, 400, 0.3), (200, 200, 40)])
def test_nearest_within_is_brute_force(n, m, spread):
    points, target = RNG.normal(0, spread, (n, 3)), RNG.normal(0, spread, (m, 3))
    if n and m:
        points[-1] = target[0]
    if m > 3:
        target[1:3] = target[0]  # ties go to the lowest index
    for reach in (0.2, 1.0):
        for most in (1, 50, 10**6):
            index, d = sparse.Grid(target, reach, most).nearest(points)
            for p, i, x in zip(points, index, d):
                all_d = np.linalg.norm(target - p, axis=1) if m else np.array([np.inf])
                assert (i, x) == ((all_d.argmin(), all_d.min()) if all_d.min() <= reach else (-1, np.inf))


def test_nearest_takes_points_far_away_and_not_finite():
    index, d = sparse.Grid(np.zeros((1, 3)), 0.5).nearest(np.array([[1e300, 0, 0], [np.nan, 0, 0], [-1e18, 5, 5], [0.5, 0, 0]]))
    assert index.tolist() == [-1, -1, -1, 0] and d[3] == 0.5


def test_large_clouds_register_without_all_pairs(spark):
    b = RNG.uniform(0, 30, (60_000, 3))
    shift = np.array([0.05, -0.04, 0.03])
    rows = [(1, i, 0, *map(float, p - shift)) for i, p in enumerate(b)] + [(1, len(b) + i, 1, *map(float, p)) for i, p in enumerate(b)]
    began = time.time()
    out = G.registered(spark.createDataFrame(rows, "k long, row_id long, side int, x double, y double, z double"), "k", 0.2, 6).first()
    assert np.allclose(np.array(out["transform"]).reshape(4, 4)[:3, 3], shift, atol=1e-3)
    assert time.time() - began < 120
