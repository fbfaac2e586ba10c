"""Normals, histograms and plane registration against numpy from the raw points."""

import numpy as np

from keelson.operators import hypotheses as H
from keelson.operators import points as P
from keelson.operators import surfaces as S

RNG = np.random.default_rng(8)


def corner(n, noise=0.0):
    """Points on three faces of a box with a bump, in 2 m."""
    p = RNG.uniform(0, 2, (n, 3))
    p[np.arange(n), RNG.integers(0, 3, n)] = 0
    p[:, 2] += 0.3 * np.exp(-(((p[:, :2] - [0.7, 1.2]) ** 2).sum(axis=1)) / 0.1)
    return p + RNG.normal(0, noise, p.shape)


def frame(spark, clouds):
    rows = [(k, i, *map(float, x)) for k, p in clouds.items() for i, x in enumerate(p)]
    return spark.createDataFrame(rows, "scan_id long, row_id long, x double, y double, z double").repartition(5)


def brute_neighbours(p, radius, most):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(p)):
        order = sorted(np.flatnonzero(d[i] <= radius), key=lambda j: (round(d[i, j], 9), j))[:most]
        out.append((np.array(order), d[i, order]))
    return out


def brute_normals(p, radius, most):
    out = np.full((len(p), 3), np.nan)
    for i, (near, _) in enumerate(brute_neighbours(p, radius, most)):
        if len(near) >= 3:
            axis = np.linalg.eigh(np.cov((p[near] - p[i]).T, bias=True))[1][:, 0]
            side = axis @ (p[i] - p.mean(axis=0))
            out[i] = axis * (np.sign(side) if abs(side) > 1e-9 else np.sign(axis[np.abs(axis).argmax()]))
    return out


def brute_histograms(p, n, radius, most):
    own = np.full((len(p), 33), np.nan)
    near = brute_neighbours(p, radius, 10**6)
    there = ~np.isnan(n[:, 0])
    kept = []
    for i in range(len(p)):
        pairs = [(j, d) for j, d in zip(*near[i]) if j != i and there[j]][: most - 1]
        kept.append([(j, d) for j, d in pairs if d > 0] if there[i] else [])
        bins = np.zeros(33)
        for j, d in kept[i]:
            line = (p[j] - p[i]) / d
            a1, a2 = n[i] @ line, n[j] @ line
            u, w, line, f3 = (n[j], n[i], -line, -a2) if round(abs(a1), 12) < round(abs(a2), 12) else (n[i], n[j], line, a1)
            v = np.cross(line, u)
            v = v / np.linalg.norm(v) if np.linalg.norm(v) else v * 0
            f1, f2 = np.arctan2(np.cross(u, v) @ w, u @ w), v @ w
            for g, (f, low, width) in enumerate(((f1, -np.pi, 2 * np.pi), (f2, -1, 2), (f3, -1, 2))):
                bins[11 * g + int(np.clip(np.floor((round(f, 9) - low) / width * 11), 0, 10))] += 100 / len(kept[i])
        if kept[i]:
            own[i] = bins
    out = own.copy()
    for i in range(len(p)):
        if kept[i]:
            g = sum((own[j] / d**2 for j, d in kept[i] if not np.isnan(own[j, 0])), np.zeros(33))
            out[i] += np.concatenate([x / x.sum() * 100 if x.sum() > 0 else x * 0 for x in np.split(g, 3)])
    return out


def test_nearest_within_is_exact(spark):
    a, b = corner(600, 0.02), corner(500, 0.02)
    got = {(r["scan_id"], r["s"]): r["d"] for r in P.nearest_within(frame(spark, {1: a, 2: b - 3}), frame(spark, {1: b, 2: a - 3}), 0.11).collect()}
    for k, s, t in ((1, a, b), (2, b - 3, a - 3)):
        d = np.sqrt(((s[:, None] - t[None]) ** 2).sum(axis=2)).min(axis=1)
        for i, x in enumerate(d):
            assert (got[k, i] is None) == (x > 0.11) and (x > 0.11 or abs(got[k, i] - x) < 1e-12)


def test_nearest_within_on_cell_edges(spark):
    """Coordinates at multiples of the radius: all distances of exactly one radius are found."""
    p = np.array([[x, y, 0.0] for x in range(9) for y in range(9)]) * 0.1
    a, b = frame(spark, {1: p}), frame(spark, {1: p + [0.1, 0, 0]})
    got = {r["s"]: r["d"] for r in P.nearest_within(a, b, 0.1).collect()}
    d = np.sqrt(((p[:, None] - (p + [0.1, 0, 0])[None]) ** 2).sum(axis=2))
    assert all((got[i] is not None) == bool((d[i] <= 0.1).any()) for i in range(len(p)))
    pairs = S.near_pairs(a, b, ["scan_id"], 0.1).count()
    assert pairs == int((d <= 0.1).sum()) > 200


def test_normals_and_histograms_against_brute_force(spark):
    clouds = {1: corner(1_500, 0.005), 2: corner(500, 0.005) * [1, 1, 0.5] - 5, 3: np.array([[0, 0, 0], [0.01, 0, 0], [9, 9, 9]])}
    oriented = S.normals(frame(spark, clouds), ["scan_id"], 0.16, 40)
    rows = {(r["scan_id"], r["row_id"]): (r["nx"], r["ny"], r["nz"]) for r in oriented.collect()}
    want = {k: brute_normals(p, 0.16, 40) for k, p in clouds.items()}
    for (k, i), n in rows.items():
        assert (n[0] is None) == bool(np.isnan(want[k][i, 0])) and (n[0] is None or np.allclose(n, want[k][i], atol=1e-7)), (k, i)
    assert len(rows) == 2_003
    exact = spark.createDataFrame([(k, i, *map(float, p), *(None if np.isnan(x) else float(x) for x in want[k][i])) for k in (1, 2, 3) for i, p in enumerate(clouds[k])], "scan_id long, row_id long, x double, y double, z double, nx double, ny double, nz double")
    got = {(r["scan_id"], r["row_id"]): r["v"] for r in S.histograms(exact, ["scan_id"], 0.25, 60).collect()}
    for k, p in clouds.items():
        h = brute_histograms(p, want[k], 0.25, 60)
        for i in range(len(p)):
            assert ((k, i) in got) == (not np.isnan(h[i, 0])), (k, i)
            assert (k, i) not in got or np.allclose(got[k, i], h[i], atol=1e-6), (k, i)


def turn(deg, axis, shift):
    a = np.radians(deg)
    x = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -x[2], x[1]], [x[2], 0, -x[0]], [-x[1], x[0], 0]])
    t = np.eye(4)
    t[:3, :3] += np.sin(a) * k + (1 - np.cos(a)) * k @ k
    t[:3, 3] = shift
    return t


def dense_round(t, p, q, n, reach):
    """One point-to-plane round from the raw arrays, onto the points that have a normal."""
    q, n = q[~np.isnan(n[:, 0])], n[~np.isnan(n[:, 0])]
    m = p @ t[:3, :3].T + t[:3, 3]
    d = np.sqrt(((m[:, None] - q[None]) ** 2).sum(axis=2))
    j = d.argmin(axis=1)
    ok = d[np.arange(len(m)), j] <= reach
    m, j = m[ok], j[ok]
    a = np.column_stack([np.cross(m, n[j]), n[j]])
    x = np.linalg.lstsq(a, -((m - q[j]) * n[j]).sum(axis=1), rcond=None)[0]
    angle = np.linalg.norm(x[:3])
    return turn(np.degrees(angle), x[:3] if angle else [1, 0, 0], x[3:]) @ t


def test_plane_registration_is_the_dense_one(spark):
    q = corner(1_200)
    truth = turn(4, [1, 2, 3], [0.05, -0.04, 0.03])
    p = (corner(900) - truth[:3, 3]) @ truth[:3, :3]
    src = frame(spark, {1: p, 2: p[:4], 3: p[:0]}).withColumnRenamed("scan_id", "pair")
    onto = S.normals(frame(spark, {1: q, 2: q}), ["scan_id"], 0.2).withColumnRenamed("scan_id", "pair")
    starts = spark.createDataFrame([(k, np.eye(4).ravel().tolist()) for k in (1, 2)] + [(4, None)], "pair long, transform array<double>")
    got = {r["pair"]: r for r in S.plane_registered(src, onto, starts, "pair", 0.25, 3).collect()}
    t, n = np.eye(4), brute_normals(q, 0.2, 40)
    for _ in range(3):
        t = dense_round(t, p, q, n, 0.25)
    assert np.abs(np.reshape(got[1]["transform"], (4, 4)) - t).max() < 1e-6 and got[1]["rounds"] == 3
    assert got[2]["transform"] == np.eye(4).ravel().tolist() and not got[2]["converged"] and set(got) == {1, 2}
    best = {r["pair"]: r for r in S.plane_registered(src, onto, starts, "pair", 0.25, 25).collect()}[1]
    error = np.reshape(best["transform"], (4, 4)) @ np.linalg.inv(truth)
    assert best["converged"] and np.degrees(np.arccos(np.clip((np.trace(error[:3, :3]) - 1) / 2, -1, 1))) < 0.5 and np.linalg.norm(error[:3, 3]) < 0.02
    assert best["fitness"] > 0.99 and best["rmse"] < 0.1


def test_raw_clouds_are_registered_both_ways(spark):
    """The same surface seen twice, far apart: features find the transform, planes refine it."""
    q = np.unique(np.round(corner(1_400) / 0.08).astype(int), axis=0) * 0.08 + RNG.normal(0, 0.004, (1, 3))
    truth = turn(75, [0.3, 0.2, 1], [3.0, -1.0, 0.5])
    p = (q + RNG.normal(0, 0.003, q.shape) - truth[:3, 3]) @ truth[:3, :3]
    rows = [(1, side, i, *map(float, x)) for side, c in ((0, p), (1, q)) for i, x in enumerate(c)]
    df = spark.createDataFrame(rows, "pair long, side int, row_id long, x double, y double, z double").repartition(4)
    r = H.registered_clouds(df, "pair", 0.2, 0.5).first()
    assert r["accepted"], r
    error = np.reshape(r["transform"], (4, 4)) @ np.linalg.inv(truth)
    assert np.degrees(np.arccos(np.clip((np.trace(error[:3, :3]) - 1) / 2, -1, 1))) < 0.5 and np.linalg.norm(error[:3, 3]) < 0.02
