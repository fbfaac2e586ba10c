"""Fused surfaces against known shapes and a voxel loop."""

import math
from collections import defaultdict
from itertools import product

import numpy as np

from keelson.operators import fusion as U

RAYS = "scan_id long, ox double, oy double, oz double, x double, y double, z double"


def sphere_rays(n=6000):
    """A unit sphere from the six sides and eight corners of a cube; grazing rays (over 56 degrees) are left out."""
    rng, out = np.random.default_rng(4), []
    for o in product((-1, 0, 1), repeat=3):
        if sum(map(abs, o)) in (1, 3):
            o = 3 * np.array(o) / np.linalg.norm(o)
            p = rng.normal(size=(n, 3))
            p /= np.linalg.norm(p, axis=1)[:, None]
            out += [(1, *map(float, o), *map(float, q)) for q in p[p @ o > 3 * 0.766]]
    return out


def test_a_sphere_comes_back(spark):
    rays = spark.createDataFrame(sphere_rays(), RAYS).repartition(7)
    got = U.surface_points(U.fused_voxels(rays, ["scan_id"], 0.1, 0.3), ["scan_id"], 0.1, 4).toPandas()
    p = got[["x", "y", "z"]].to_numpy()
    assert len(p) > 500
    assert np.abs(np.linalg.norm(p, axis=1) - 1).max() < 0.05  # half a voxel
    # all of what was seen, from every side
    seen = np.array(sphere_rays())[::50, 4:]
    assert np.linalg.norm(seen[:, None] - p[None], axis=2).min(axis=1).max() < 0.15


def brute(rays, voxel, cut):
    seen = defaultdict(list)
    for k, *v in rays:
        o, p = np.array(v[:3]), np.array(v[3:])
        far = np.linalg.norm(p - o)
        d = (p - o) / far
        cells = {tuple(int(math.floor(c)) for c in (o + (far + i * voxel / 2) * d) / voxel) for i in range(-math.ceil(2 * cut / voxel), math.ceil(2 * cut / voxel) + 1)}
        for c in cells:
            s = (far - (((np.array(c) + 0.5) * voxel - o) @ d)) / cut
            if s >= -1:
                seen[k, *c].append(min(s, 1.0))
    return {c: (sum(x) / len(x), len(x)) for c, x in seen.items()}


def test_voxels_are_the_loops_and_odd_rays_give_nothing(spark):
    rng = np.random.default_rng(9)
    rays = [(int(k), *map(float, rng.uniform(-1, 1, 6))) for k in rng.integers(0, 3, 60)]
    rays += rays[:2]  # repeated rays count again
    odd = [(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 0.0, 0.0, 0.0, float("nan"), 1.0, 1.0), (1, 0.0, 0.0, 0.0, float("inf"), 1.0, 1.0)]
    got = U.fused_voxels(spark.createDataFrame(rays + odd, RAYS), ["scan_id"], 0.13, 0.3).collect()
    want = brute(rays, 0.13, 0.3)
    assert {(r["scan_id"], r["ix"], r["iy"], r["iz"]): r["weight"] for r in got} == {c: n for c, (_, n) in want.items()}
    assert all(abs(r["tsdf"] - want[r["scan_id"], r["ix"], r["iy"], r["iz"]][0]) < 1e-7 for r in got)
    assert U.surface_points(U.fused_voxels(spark.createDataFrame([], RAYS), ["scan_id"], 0.1, 0.3), ["scan_id"], 0.1).count() == 0


def test_neighbours_of_few_rays_make_no_surface(spark):
    v = spark.createDataFrame([(1, 0, 0, 0, 0.5, 3), (1, 1, 0, 0, -0.25, 3), (1, 2, 0, 0, 0.25, 1), (1, 0, 5, 0, 0.5, 3), (1, 0, 6, 0, 0.0, 3), (2, 0, 0, 1, -1.0, 9)], "scan_id long, ix long, iy long, iz long, tsdf double, weight long")
    got = {(r["axis"], r["ix"], r["iy"], r["iz"]): (r["x"], r["y"], r["z"]) for r in U.surface_points(v, ["scan_id"], 1.0, 2).collect()}
    assert set(got) == {(0, 0, 0, 0), (1, 0, 5, 0)}
    assert got[0, 0, 0, 0] == (0.5 + 0.5 / 0.75, 0.5, 0.5) and got[1, 0, 5, 0] == (0.5, 6.5, 0.5)


def test_voxels_and_surface_need_one_shuffle_of_rays(spark):
    """A voxel never crosses the network: blocks of rays do, with a rim for the surface."""
    rng = np.random.default_rng(5)
    rows = [(k % 2, 0.0, 0.0, 3.0, float(x), float(y), 0.1 * float(np.sin(3 * x))) for k, (x, y) in enumerate(rng.uniform(-1.5, 1.5, (1500, 2)))]
    rays = spark.createDataFrame(rows, "k long, ox double, oy double, oz double, x double, y double, z double")
    voxels, surface = U.fused_voxels(rays, ["k"], 0.05, 0.15), U.fused_surface(rays, ["k"], 0.05, 0.15)
    for df in (voxels, surface):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    key = lambda r: (r.k, r.axis, r.ix, r.iy, r.iz)
    apart = U.surface_points(voxels, ["k"], 0.05).collect()
    assert sorted(map(tuple, surface.collect())) == sorted(map(tuple, apart)) and len({key(r) for r in apart}) == len(apart) > 500
    assert len({tuple(r)[:4] for r in voxels.collect()}) == voxels.count()
