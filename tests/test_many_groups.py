"""Steps that work on many groups at once against the same step on one group, and without a frame a group."""

from itertools import combinations

import numpy as np
import pytest

from keelson.operators import consensus as C
from keelson.operators import geometry as G
from keelson.operators import graphs as S
from keelson.operators import labels as L
from keelson.operators import points as P
from keelson.operators import pose_graphs as PG
from keelson.operators import robust as R
from keelson.operators import sparse
from keelson.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_systems_of_many_graphs():
    rng, k = np.random.default_rng(3), 3
    sizes = [1, 0, 5, 40, 4, 33, 32]
    at = np.r_[0, np.cumsum(sizes)]
    a = np.concatenate([np.r_[np.arange(n - 1), 0] + at[g] for g, n in enumerate(sizes) if n > 2])
    b = np.concatenate([np.r_[np.arange(1, n), n - 1] + at[g] for g, n in enumerate(sizes) if n > 2])
    mix = rng.permutation(len(a))
    a, b = a[mix], b[mix]
    cross, diagonal, right = rng.normal(size=(len(a), k, k)), rng.normal(size=(at[-1], k, k)), rng.normal(size=(at[-1], k))
    diagonal = diagonal + diagonal.transpose(0, 2, 1) + 30 * np.eye(k)
    dense = np.zeros((at[-1], k, at[-1], k))
    for i, d in enumerate(diagonal):
        dense[i, :, i] = d
    for i, j, c in zip(a, b, cross):
        dense[i, :, j] += c
        dense[j, :, i] += c.T
    want = np.linalg.solve(dense.reshape(at[-1] * k, -1), right.ravel()).reshape(-1, k)
    for most in (1, 4_000_000):
        assert np.allclose(sparse.solved_many(at, diagonal, a, b, cross, right, {}, most=most), want, atol=1e-12)


def test_many_pose_graphs_are_each_one():
    rng = np.random.default_rng(5)
    sizes, graphs = [1, 4, 40, 9], []
    for n in sizes:
        t = PG.shifted(np.tile(np.eye(4), (n, 1, 1)), rng.normal(0, 0.3, (n, 6)))
        chain = np.arange(n - 1)
        a, b = (np.r_[chain, 0], np.r_[chain + 1, n - 1]) if n > 2 else (chain, chain + 1)
        z = PG.shifted(PG.inverses(t[b]) @ t[a], rng.normal(0, 0.05, (len(a), 6)))
        graphs.append((t, a, b, z, np.full((len(a), 6), 5.0)))
    at = np.r_[0, np.cumsum(sizes)]
    t, a, b, z, scale = (np.concatenate([g[k] + (at[i] if k in (1, 2) else 0) for i, g in enumerate(graphs)]) for k in range(5))
    got, before, after = PG.optimise_many(t, at, a, b, z, scale, 0.5, 60)
    one = [PG.optimise(*g, 0.5, 60) for g in graphs if len(g[1])]
    assert np.allclose(got[1:], np.concatenate([o[0] for o in one]), atol=1e-7) and (got[0] == t[0]).all()
    assert np.allclose(before, np.concatenate([o[1] for o in one])) and np.allclose(after, np.concatenate([o[2] for o in one]), atol=1e-6)
    assert (after**2).sum() < (before**2).sum()


@pytest.mark.parametrize("name", ["udf_pose_graph", "udf_pose_graph_se3", "udf_sampled_consensus", "udf_direction_agreement"])
def test_no_frame_a_group(spark, name):
    assert "GroupsInPandas" not in plan_of(registry.QUERIES[name](spark, SF))


def test_triangles_turn_as_the_general_fit_does():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(500, 3, 3)), rng.normal(size=(500, 3, 3))
    b[:250] = a[:250] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + rng.normal(0, 0.02, (250, 3, 3))
    a[:5, 2], b[:5, 2] = 2 * a[:5, 1] - a[:5, 0], 2 * b[:5, 1] - b[:5, 0]  # on a line
    a, b = a - a.mean(axis=1)[:, None], b - b.mean(axis=1)[:, None]
    got, want = R.triangle_rotations(a, b), R.rotations(a, b)
    loss = lambda t: ((a @ t.transpose(0, 2, 1) - b) ** 2).sum(axis=(1, 2))
    assert np.allclose(loss(got), loss(want), atol=1e-9) and np.allclose(np.linalg.det(got), 1)
    assert np.allclose(got[5:], want[5:], atol=1e-6)


@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
def test_best_trial_counts_every_triple_that_may_win(share):
    rng, n = np.random.default_rng(11), 90
    s = rng.uniform(0, 3, (n, 3))
    r = s @ R.rotations(rng.normal(size=(1, 3, 3)), rng.normal(size=(1, 3, 3)))[0].T + rng.normal(0, 0.02, (n, 3))
    wrong = rng.random(n) > share
    r[wrong] = rng.uniform(0, 3, (wrong.sum(), 3))
    triples = np.array([rng.choice(n, 3, replace=False) for _ in range(2500)])
    want = None
    for place, t in enumerate(triples):
        la, lb = (np.array([np.linalg.norm(p[i] - p[j]) for i, j in ((0, 1), (1, 2), (2, 0))]) for p in (s[t], r[t]))
        if (np.minimum(la, lb) < 0.9 * np.maximum(la, lb)).any():
            continue
        ca, cb = s[t].mean(axis=0), r[t].mean(axis=0)
        rot = R.rotations((s[t] - ca)[None], (r[t] - cb)[None])[0]
        miss = np.linalg.norm((s - ca) @ rot.T + cb - r, axis=1)
        if miss[t].max() <= 0.05:
            row = (-int((miss <= 0.05).sum()), round(float(np.sqrt((miss[miss <= 0.05] ** 2).mean())), 9), place)
            want = row if want is None or row < want else want
    got = R.best_trial(s, r, triples, 0.05, 0.9)
    assert want == (None if got is None else (-got[0], got[1], got[2]))
    assert share < 0.5 or got[0] > 3


def test_subsets_are_those_of_plain_enumeration():
    rng = np.random.default_rng(13)
    for n in (1, 2, 5, 7):
        dr, dt = (x + x.transpose(0, 2, 1) for x in rng.uniform(0, 1, (2, 40, n, n)))
        got = C.clique_table(dr, dt, 1.4, 1.4)
        top = C.maximal_table(got)
        for g in range(40):
            fits = lambda m: m > 0 and all(dr[g, i, j] <= 1.4 and dt[g, i, j] <= 1.4 for i, j in combinations([i for i in range(n) if m >> i & 1], 2))  # noqa: B023, E731
            want = {m for m in range(2**n) if fits(m)}
            assert set(np.flatnonzero(got[g]).tolist()) == want
            assert set(np.flatnonzero(top[g]).tolist()) == {m for m in want if not any(o != m and o & m == m for o in want)}


SHUFFLED_ONCE = ["decide_jackknife_stability", "decide_policy_comparison", "decide_stage_order", "cluster_accepted_consensus", "cluster_direction_medoid", "cluster_maximal_cliques"]


@pytest.mark.parametrize("name", SHUFFLED_ONCE)
def test_records_meet_in_one_group_without_joins(spark, name):
    """No record is joined with others of its group, and no group is copied for each record left out."""
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "Join" not in plan and "Generate" not in plan


def test_null_numbers_are_not_beyond_a_bound(spark):
    """As in SQL: a null distance excludes nothing; an unknown share costs nothing."""
    one = [float(i % 5 == 0) for i in range(16)]
    far, null = one[:3] + [9.0] + one[4:], one[:3] + [None] + one[4:]
    df = spark.createDataFrame([(1, i, 10 - i, t) for i, t in enumerate([one, null, far, None])], "grp int, replicate int, signature long, transform array<double>")
    assert {(r["mask"], r["size"]) for r in C.maximal_cliques(df, ["grp"], 5.0, 0.1).collect()} == {(0b1011, 3), (0b1110, 3)}
    r = C.direction_cluster(df, ["grp"], 5.0, 0.1, 2).first()
    assert (r["size"], r["usable"], r["reasons"], r["medoid"]) == (3, False, ["largest_not_unique"], None)


@pytest.mark.parametrize("name", ["join_object_pair_statistics", "agg_label_audit", "window_node_pair_cap"])
def test_pairs_of_objects_are_no_rows_of_a_shuffle(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "Join" not in plan and "Window" not in plan


def test_cells_in_stretches_and_audits(spark):
    rng = np.random.default_rng(17)
    rows = [(int(s), int(k), *map(float, p)) for s, k, p in zip(rng.choice([1, 2, 3, 7], 900), rng.integers(0, 6, 900), rng.uniform(-1, 1, (900, 3)))]
    df = spark.createDataFrame(rows, "scan_id long, label long, x double, y double, z double")
    cells = {}
    for s, k, *p in rows:
        cells.setdefault((s, k), set()).add(tuple(np.floor(np.array(p) / 0.4).astype(int)))
    want = {(s, a, b): len(x & y) for (s, a), x in cells.items() for (u, b), y in cells.items() if u == s + 1 and x & y}
    for block in (1, 60, 4_000_000):
        got = L._shared_cells(df, 0.4, lambda c, n: {k: c[k] for k in ("group", "a", "b", "common", "na", "nb")}, "a long, b long, common long, na long, nb long", block).collect()
        assert {(r.pair_id, r.a, r.b): r.common for r in got} == want and len(got) == len(want)
        assert all((r.na, r.nb) == (len(cells[r.pair_id, r.a]), len(cells[r.pair_id + 1, r.b])) for r in got)
    bounds = (0.2, 0.15, 0.7)
    audit = lambda x: {r["pair_id"]: r.asDict() for r in x.collect()}
    found = audit(L.pair_audit(df, 0.4, *bounds))
    assert found == audit(L.label_audit(L.classified(L.pair_statistics(df, 0.4), *bounds))) and any(r["positive"] for r in found.values())


def test_nearest_points_over_the_rims_of_blocks(spark):
    """A source is in one block, whatever is near it beyond the rim is seen; a row number that comes twice, nulls and no number."""
    rng = np.random.default_rng(19)
    a, b = rng.uniform(-1.7, 1.7, (400, 3)), rng.uniform(-1.7, 1.7, (400, 3))
    b[:100] = a[:100] + rng.normal(0, 0.05, (100, 3))
    b[7] = float("nan")
    rows = lambda p: [(1, i, *map(float, x)) for i, x in enumerate(p)]
    frame = lambda p: spark.createDataFrame(p, "scan_id long, row_id long, x double, y double, z double")
    found = P.nearest_within(frame([*rows(a), (1, 0, 9.0, 9.0, 9.0), (1, 900, None, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0)]), frame(rows(b)), 0.2, block=2)
    assert "Join" not in plan_of(found)
    got = found.collect()
    d = np.sqrt(((a[:, None] - np.delete(b, 7, axis=0)[None]) ** 2).sum(axis=2)).min(axis=1)
    assert len(got) == 403 and [r.d for r in got if r.scan_id == 2 or r.s == 900] == [None, None]
    for r in got:
        if r.scan_id == 1 and r.s < 400:
            assert (r.d is None) == bool(d[r.s] > 0.2) and (r.d is None or abs(r.d - d[r.s]) < 1e-12)


def one_registration(a, b, reach, iterations, least):
    """A pair's rounds, one after the other, against all points."""
    t, trace = np.eye(4), []
    for _ in range(iterations if len(a) and len(b) else 0):
        now = G.moved(t, a)
        d = np.linalg.norm(now[:, None] - b[None], axis=2)
        index, near = d.argmin(axis=1), d.min(axis=1)
        on = near <= reach
        step = G.kabsch(now[on], b[index[on]]) if on.sum() >= least else None
        if step is None:
            break
        after = np.linalg.norm(G.moved(step, now[on]) - b[index[on]], axis=1)
        trace.append((np.sqrt((near[on] ** 2).mean()), np.sqrt((after**2).mean()), *G.distance(step, np.eye(4))))
        t = step @ t
    return t, np.array(trace).reshape(-1, 4)


def test_many_registrations_are_each_one(spark):
    rng, pairs = np.random.default_rng(11), {}
    for k, n in enumerate((300, 40, 9, 0, 12, 80)):
        b = rng.uniform(0, 2, (n, 3)) + (0 if k < 5 else 1e6)
        pairs[k] = (b + rng.normal(0, 0.03, b.shape) - [0.05, -0.04, 0.03], b)
    pairs[6] = (pairs[1][0], np.zeros((0, 3)))
    pairs[7] = (rng.uniform(0, 1, (30, 1)) * [1.0, 2.0, 3.0], np.linspace(0, 1, 30)[:, None] * [1.0, 2.0, 3.0])  # on a line
    far = np.array([[1e15, 0, 0], [-1e15, 3, 1e15]])
    pairs[8] = (np.concatenate([far + 5, pairs[0][0]]), np.concatenate([pairs[0][1], far]))
    rows = [(k, 1000 * side + i, side, *map(float, p)) for k, ab in pairs.items() for side in (0, 1) for i, p in enumerate(ab[side])]
    rows += [(1, 5000, 1, None, 1.0, 1.0), (1, 5001, 0, 1.0, None, 1.0), (1, 5002, None, 1.0, 1.0, 1.0)]  # of no use to the pair
    got = {r["k"]: r for r in G.registered(spark.createDataFrame(rows, "k long, row_id long, side int, x double, y double, z double"), "k").collect()}
    assert set(got) == {k for k, ab in pairs.items() if len(ab[0]) + len(ab[1])}
    for k, r in got.items():
        t, trace = one_registration(*pairs[k], 0.2, 30, 10)
        scale = 1 + np.abs(t).max()
        assert np.allclose(np.array(r["transform"]).reshape(4, 4), t, atol=1e-9 * scale)
        assert np.allclose(np.array([tuple(s) for s in r["trace"]]).reshape(-1, 4), trace, atol=1e-5 * scale)
    assert len(got[0]["trace"]) == len(got[5]["trace"]) == 30 and got[2]["trace"] == got[7]["trace"] == []


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_nearest_in_many_clouds_is_brute_force(most):
    rng = np.random.default_rng(12)
    sizes = [(0, 3), (5, 0), (1, 1), (200, 150), (90, 200)]
    of, at = (np.repeat(np.arange(5), [s[i] for s in sizes]) for i in (0, 1))
    p, q = rng.normal(0, 0.5, (len(of), 3)), rng.normal(0, 0.5, (len(at), 3))
    q[at == 4] *= 1e5
    p[of == 4] = q[at == 4][:90] + 0.1
    p[-1], q[0], q[6:8] = np.nan, np.nan, q[5]
    mix = rng.permutation(len(p))
    index, d = sparse.Grids(q, at, 5, 0.2, most).nearest(p[mix], of[mix], 64)
    for x, g, i, near in zip(p[mix], of[mix], index, d):
        every = np.where(at == g, np.linalg.norm(q - x, axis=1), np.nan)
        best = np.nanmin(np.r_[every, np.inf])
        assert (i, near) == ((np.flatnonzero(every == best)[0], best) if best <= 0.2 else (-1, np.inf))
    assert (index >= 0).sum() > 150


def test_registration_makes_no_frame_a_pair(spark):
    assert "GroupsInPandas" not in plan_of(registry.QUERIES["udf_registration"](spark, SF))


def test_roots_read_relations_twice_over_many_tasks(spark):
    plan = plan_of(registry.QUERIES["agg_root_object"](spark, SF))
    assert plan.count("l_orderkey#") and plan.count("Relation [l_orderkey") <= 2
    parts = [int(line.rsplit(", ", 1)[1]) for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(parts) == 4 and min(parts) >= 8 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_roots_are_brute_force(spark):
    rng = np.random.default_rng(13)
    edges = [(int(s), *(None if x == 5 else int(x) for x in rng.integers(0, 6, 2))) for s in np.sort(rng.integers(0, 40, 150))]
    edges += [(None, 1, 1), (50, 1, 1)]  # no scan; a scan without objects
    objects = [(int(s), None if x == 5 else int(x)) for s, x in zip(rng.integers(0, 44, 120), rng.integers(0, 6, 120))] + [(60, None), (None, 3), (None, 1)]
    want = {}
    for s in {s for s, _ in objects}:
        own = {o for t, o in objects if t == s and o is not None}
        n = {}
        for t, *ends in edges:
            for e in ends if t == s and s is not None else []:
                n[e] = n.get(e, 0) + 1
        top = min(n, key=lambda e: (-n[e], e is not None, e or 0)) if n else None
        want[s] = top if top in own else min(own, default=None)
    got = S.roots(spark.createDataFrame(edges, "scan_id long, sub long, obj long"), spark.createDataFrame(objects, "scan_id long, object_id long")).collect()
    assert len(got) == len(want) and {r["scan_id"]: r["root"] for r in got} == want
