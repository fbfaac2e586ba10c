"""Embedding losses and the epoch loop, against dense numpy over whole pairs and finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import fusion_training as FT

WIDTHS = [3, 2, 4]
NODES, ANCHORS = "pair_id LONG, side INT, node LONG, v ARRAY<DOUBLE>, src STRING", "pair_id LONG, s LONG, r LONG, u STRING"


def world(seed, pairs=6):
    """Pairs of graphs whose second module says nothing; one node lacks its first module."""
    rng = np.random.default_rng(seed)
    nodes, anchors = [], []
    for p in range(pairs):
        n, extra = int(rng.integers(2, 9)), int(rng.integers(1, 5))
        base = rng.normal(size=(n, 9))
        for i in range(n):
            for side in (0, 1):
                v = base[i] + 0.3 * rng.normal(size=9)
                v[3:5] = rng.normal(size=2)
                if i == 0:
                    v[:3] = 0
                nodes.append((p, side, 2 * i + side, v.tolist(), "x"))
            anchors.append((p, 2 * i, 2 * i + 1, "y"))
        nodes += [(p, int(j % 2), 100 + j, rng.normal(size=9).tolist(), "x") for j in range(extra)]
    return nodes, anchors


def dense(nodes, anchors, theta, align, contrast, zoom=0.1):
    """Mean over pairs of the whole loss, from concatenated embeddings and full matrices."""
    cuts = [slice(0, 3), slice(3, 5), slice(5, 9)]
    w = np.exp(theta) / np.exp(theta).sum()
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def probability(a, b, c, d, t):
        e = np.exp(a @ b.T / t)
        x, y = e / (np.exp(a @ c.T / t).sum() + 1e-9), e / (np.exp(a @ d.T / t).sum() + 1e-9)
        return 1 / (1 + 1 / (x + 1e-9) + 1 / (y + 1e-9) + 1e-9)

    totals = []
    for p in sorted({x[0] for x in anchors}):
        of = {(side, k): np.array(v) for q, side, k, v, _ in nodes if q == p}
        pairs = [(s, r) for q, s, r, _ in anchors if q == p]
        used = {(0, s) for s, _ in pairs} | {(1, r) for _, r in pairs}
        roles = [[of[0, s] for s, _ in pairs], [of[1, r] for _, r in pairs], [v for k, v in of.items() if k[0] == 0 and k not in used], [v for k, v in of.items() if k[0] == 1 and k not in used]]
        raw = [np.array(x).reshape(-1, 9) for x in roles]
        single = [[unit(x[:, c]) for x in raw] for c in cuts]
        joint = [unit(np.concatenate([w[m] * single[m][i] for m in range(3)], axis=1)) for i in range(4)]

        def contrastive(e):
            return -np.log((probability(*e, 0.1) + probability(e[1], e[0], e[3], e[2], 0.1)) / 2).mean()

        def alignment(e):
            out = 0
            for order in ((0, 1, 2, 3), (1, 0, 3, 2)):
                qo, qm = probability(*[e[i] for i in order], 1.0), probability(*[joint[i] for i in order], 1.0)
                out += (np.exp(qo) * (qo - np.log(qm))).sum() / 2
            return 0.1 * out

        loss = zoom * sum(np.exp(-align[m]) * alignment(single[m]) + align[m] for m in range(3))
        loss += sum(np.exp(-contrast[m]) * contrastive(single[m]) + contrast[m] for m in range(3)) + contrastive(joint)
        totals.append(loss)
    return np.mean(totals)


def batches(spark, nodes, anchors, size=256, every=0):
    valid = F.col("pair_id") % every == 0 if every else F.lit(False)
    return FT.Batches(spark.createDataFrame(nodes, NODES), spark.createDataFrame(anchors, ANCHORS), WIDTHS, valid, size)


@pytest.mark.parametrize("size", [2, 256])
def test_loss_and_gradient(spark, size):
    nodes, anchors = world(3)
    p = np.array([0.4, -0.3, 0.1, 0.2, 0.0, -0.1, 0.3, 0.1, 0.0])
    b = batches(spark, nodes + nodes[:5], anchors + anchors[:2], size)
    mean = np.mean([r.losses for r in FT.pair_losses(b, p[:3].tolist()).collect()], axis=0)
    loss, grad = FT.combined(mean, p[:3], p[3:6], p[6:])
    whole = lambda q: dense(nodes, anchors, q[:3], q[3:6], q[6:])
    assert loss == pytest.approx(whole(p), rel=1e-9)
    steps = np.eye(9) * 1e-5
    want = [(whole(p + h) - whole(p - h)) / 2e-5 for h in steps]
    assert np.allclose(grad, want, rtol=1e-5, atol=1e-7)


def test_killed_run_resumes(spark, tmp_path):
    nodes, anchors = world(4, 8)
    b = batches(spark, nodes, anchors, every=4)
    whole = FT.train_fusion(b, str(tmp_path / "whole"), 5).orderBy("epoch").collect()
    FT.train_fusion(b, str(tmp_path / "killed"), 2)
    (tmp_path / "killed" / "epoch=2" / "_temporary").mkdir(parents=True)  # a write that never committed
    parts = FT.train_fusion(b, str(tmp_path / "killed"), 5).orderBy("epoch").collect()
    assert [r.epoch for r in parts] == list(range(5)) and [r.best for r in parts] == [r.best for r in whole]
    for x, y in zip(whole, parts):
        assert np.allclose(x.theta + x.align + x.moment, y.theta + y.align + y.moment, rtol=1e-9) and x.valid_loss == pytest.approx(y.valid_loss)
    assert whole[-1].train_loss < whole[0].train_loss and (whole[0].train_pairs, whole[0].valid_pairs) == (6, 2)
    assert [r.epoch for r in whole if r.best] == [min(whole, key=lambda r: (r.valid_loss, r.epoch)).epoch]
    again = FT.train_fusion(b, str(tmp_path / "whole"), 3)
    assert again.count() == 5


def test_uninformative_module_loses_weight(spark, tmp_path):
    nodes, anchors = world(5, 10)
    last = FT.train_fusion(batches(spark, nodes, anchors), str(tmp_path / "run"), 5, rate=0.2).orderBy(F.desc("epoch")).first()
    assert last.theta[1] == min(last.theta) and last.valid_loss is None and not last.best


def test_odd_rows(spark, tmp_path):
    nodes, anchors = world(6, 2)
    odd = [(None, 0, 1, [1.0] * 9, None), (0, None, 1, [1.0] * 9, None), (0, 0, None, [1.0] * 9, None), (0, 0, 77, None, None), (0, 1, 78, [1.0], None), (9, 0, 1, [1.0] * 9, None)]
    one = {r.pair_id: r.losses for r in FT.pair_losses(batches(spark, nodes, anchors), [0.0] * 3).collect()}
    got = {r.pair_id: r.losses for r in FT.pair_losses(batches(spark, nodes + odd, anchors + [(0, 500, 501, None), (None, 1, 2, None), (9, 1, 1, None)]), [0.0] * 3).collect()}
    assert set(got) == {0, 1} and all(np.allclose(got[k], one[k]) for k in got)
    alone = [x for x in nodes if x[2] < 100]
    assert np.isfinite([r.losses for r in FT.pair_losses(batches(spark, alone, anchors), [0.0] * 3).collect()]).all()
    rest = FT.train_fusion(batches(spark, [], []), str(tmp_path / "none"), 2).orderBy("epoch").collect()
    assert [(r.train_pairs, r.train_loss, r.theta, r.best) for r in rest] == [(0, None, [0.0] * 3, False)] * 2


def test_neighbourhood_losses(spark):
    nodes, anchors = world(7, 3)
    got = {(r.pair_id, r.module): r.loss for r in FT.neighbourhood_losses(spark.createDataFrame(nodes, NODES), spark.createDataFrame(anchors, ANCHORS), WIDTHS).collect()}
    for p in range(3):
        of = {(side, k): np.array(v) for q, side, k, v, _ in nodes if q == p}
        a, b = (np.array([of[side, x[1 + side]] for x in anchors if x[0] == p]) for side in (0, 1))
        for m, c in enumerate([slice(0, 3), slice(3, 5), slice(5, 9), slice(0, 9)]):
            u = [x[:, c] / np.maximum(np.linalg.norm(x[:, c], axis=1, keepdims=True), 1e-12) for x in (a, b)]
            s = u[0] @ u[1].T
            e = np.exp(s) - np.diag(np.exp(np.diag(s)))
            want = np.log(1 + e.sum(0)).mean() + np.log(1 + e.sum(1)).mean() - np.log(1 + np.maximum(np.diag(s), 0)).mean()
            assert got[p, m] == pytest.approx(want, abs=1e-7)
    assert len(got) == 12
