"""Many groups a batch: seams between batches, the stream of triples, and results against one group at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keelson.operators import geometry as G
from keelson.operators import grouped


@pytest.mark.parametrize("n", [3, 4, 5, 24, 120, 1000])
def test_drawn_triples_are_those_of_single_calls(n):
    a, b = np.random.default_rng(n), np.random.default_rng(n)
    assert (grouped.drawn_triples(a, n, 64) == [b.choice(n, 3, replace=False) for _ in range(64)]).all()
    assert a.random() == b.random()


def test_groups_stay_whole_over_batches(spark):
    rows = spark.createDataFrame(pd.DataFrame({"k": np.repeat(np.arange(40), np.arange(40) % 9 + 1)}).assign(v=lambda x: range(len(x))))

    def solve(table, at):
        v = table.column("v").to_numpy()
        return {"group": range(len(at) - 1), "n": np.diff(at), "first": v[at[:-1]], "together": [len(at) - 1] * (len(at) - 1)}

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            got = grouped.whole_groups(rows, ["k"], ["v"], solve, "n long, first long, together long").toPandas().sort_values("k")
            assert (got["n"] == np.arange(40) % 9 + 1).all() and len(got) == 40
            assert (got["first"].to_numpy() == np.r_[0, np.cumsum(got["n"])[:-1]]).all()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert (1 / got["together"]).sum() <= 8.001  # two calls a task: what is whole, and the last group


def test_modes_of_groups_of_several_sizes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        for i in range(k % 6 + 1):
            yaw, t = np.radians(rng.integers(0, 3) * 3.0), np.eye(4)
            t[:2, :2] = [[np.cos(yaw), -np.sin(yaw)], [np.sin(yaw), np.cos(yaw)]]
            t[:2, 3] = rng.integers(0, 3, 2) * 0.06
            rows.append((k, i * 2, t.ravel().tolist()))
    got = G.modes(spark.createDataFrame(rows, "k long, replicate int, transform array<double>"), ["k"]).collect()
    for k in range(60):
        ts = {i: np.array(t).reshape(4, 4) for g, i, t in rows if g == k}
        cost = lambda i, j: G.distance(ts[i], ts[j])[0] / 5.0 + G.distance(ts[i], ts[j])[1] / 0.10  # noqa: E731, B023
        close = lambda i, j: all(x <= y for x, y in zip(G.distance(ts[i], ts[j]), (5.0, 0.10)))  # noqa: E731, B023
        left, want = sorted(ts), []
        while left:
            growths = []
            for seed in left:
                got_ = [seed]
                for j in sorted(left, key=lambda j: (cost(j, seed), j)):  # noqa: B023
                    if j != seed and all(close(j, g) for g in got_):
                        got_.append(j)
                growths.append(sorted(got_))
            best = min(growths, key=lambda x: (-len(x), x))
            want.append((best, min(best, key=lambda i: (round(sum(cost(i, j) for j in best), 12), i))))  # noqa: B023
            left = [i for i in left if i not in best]
        assert [(r.members, r.medoid) for r in sorted((r for r in got if r.k == k), key=lambda r: r["mode"])] == want


def _correspondences(spark, pairs=6, n=60):
    rng = np.random.default_rng(11)
    s = rng.integers(0, 5, (pairs, n, 3)) * 0.4
    r = s + 0.3 + rng.integers(0, 3, (pairs, n, 3)) * 0.012
    rows = [(p, int(i - i % 20 // 19), *s[p, i].tolist(), *r[p, i].tolist(), float(i % 7) / 7) for p in range(pairs) for i in range(n)]  # some ids come twice
    return spark.createDataFrame(rows, "pair_id long, idx long, sx double, sy double, sz double, rx double, ry double, rz double, score double")


def test_cliques_and_beams_need_no_row_an_edge(spark):
    """The graph is made where a pair's rows are: the same sets as from its edges, and only the correspondences are shuffled."""
    from keelson.operators import correspondences as C

    corr = _correspondences(spark)
    rank = corr.withColumn("rank", F.col("idx") + 1)
    edges = C.compatible_pairs(corr, 0.0203, 0.5)
    cliques, beams = G.compatible_cliques(corr, "pair_id", 0.0203, 0.5), G.compatible_beams(rank, "pair_id", 0.0203, 0.5)
    want = G.greedy_cliques(edges, "pair_id")
    fresh = rank.select(*[F.col(c).alias(c) for c in rank.columns])
    wanted = G.beam_hypotheses(fresh.select("pair_id", F.col("idx").alias("id"), "rank").distinct(), edges, "pair_id")
    assert sorted(map(tuple, cliques.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, beams.collect())) == sorted(map(tuple, wanted.collect()))
    for df in (cliques, beams):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_growths_together_are_growths_alone():
    rng = np.random.default_rng(2)
    for n, share in ((1, 0.5), (12, 0.5), (50, 0.3), (90, 0.8)):
        near = np.triu(rng.random((n, n)) < share, 1)
        near |= near.T
        degree, best = near.sum(axis=1), []
        for seed in sorted(range(n), key=lambda i: (-degree[i], i))[:64]:
            got, free = [seed], near[seed].copy()
            while free.any():
                add = min(np.flatnonzero(free), key=lambda i: (-(near[i] & free).sum(), -degree[i], i))
                got.append(int(add))
                free &= near[add]
            best = min([best, sorted(got)] if best else [sorted(got)], key=lambda g: (-len(g), g))
        assert G.greedy_clique(near) == best


def test_a_ratio_at_its_bound_does_not_hang_on_the_order_of_a_sum(spark):
    from keelson.operators import labels as L

    below = float(np.nextafter(0.85, 0))
    rows = spark.createDataFrame([(1, 1.0, below, 1.0, 0.8, 1.0, float(np.nextafter(1.05, 2)))], "pair_id long, base_points double, cand_points double, base_extent double, cand_extent double, base_conflict double, cand_conflict double")
    got = L.geometry_gate(rows).first()
    assert got.safe and not got.improved


def test_hulls_look_at_new_facets_only():
    """Points on a lattice have hulls of many facets: each step costs its new facets, not all of them."""
    import time

    from keelson.operators.decisions import hull_vertices

    rng, begun = np.random.default_rng(4), time.process_time()
    for _ in range(20):
        p = np.unique(rng.normal(size=(160, 3)) / 1.07, axis=0)
        p /= np.linalg.norm(p, axis=1)[:, None]
        assert len(hull_vertices(p)) == len(p)  # all lie on a sphere
    assert time.process_time() - begun < 10


def test_normals_make_pairs_in_blocks(spark):
    """One row a point also where ids repeat, over edges of blocks, with null coordinates; pairs are rows of no join."""
    from keelson.operators import surfaces as S

    rng = np.random.default_rng(6)
    p = rng.uniform(-1.5, 1.5, (400, 3)) * [1, 1, 0.02]
    rows = [(1, i if i else 1, *map(float, x)) for i, x in enumerate(p)] + [(1, 999, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "scan_id long, row_id long, x double, y double, z double")
    got = S.normals(df, ["scan_id"], 0.3, 40).collect()
    assert len(got) == 401 and [r.nx for r in got if r.x is None] == [None]
    by = {(r.x, r.y): r for r in got}
    for x in p[2:]:
        d = np.linalg.norm(p - x, axis=1)
        near = np.flatnonzero(d <= 0.3)
        near = near[np.argsort(d[near], kind="stable")][:40]
        r = by[float(x[0]), float(x[1])]
        if len(near) < 3:
            assert r.nx is None
        else:
            axis = np.linalg.eigh(np.cov((p[near] - x).T, bias=True))[1][:, 0]
            assert abs(abs(axis @ [r.nx, r.ny, r.nz]) - 1) < 1e-6
