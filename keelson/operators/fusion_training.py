"""Losses of a multimodal node embedding and the epoch loop that trains its fusion.

Every node has one vector of several modules side by side (``widths``). A joint embedding is the modules'
unit vectors times the softmax of one logit a module, so the joint similarity of two nodes is a weighted
mean of the modules' similarities and its gradient needs those alone. Nodes are stored in blocks; a row of
work is two blocks of a pair of graphs, so one large pair is dealt over many tasks, no similarity is ever
a row of a table, and an epoch sends one vector of sums a pair through a shuffle and one row to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions.vectors import unit
from keelson.operators.matching import similarities
from keelson.sources.durable import durable

EPS = 1e-9
CONTRAST, ALIGN = 0.1, 1.0  # temperatures
MIX, ZOOM = 0.5, 0.1  # share of the forward direction; scale of each alignment loss

SNAPSHOT = "epoch INT, theta ARRAY<DOUBLE>, align ARRAY<DOUBLE>, contrast ARRAY<DOUBLE>, moment ARRAY<DOUBLE>, spread ARRAY<DOUBLE>, train_pairs BIGINT, train_loss DOUBLE, valid_pairs BIGINT, valid_loss DOUBLE"


def _slices(widths):
    ends = np.cumsum(widths)
    return [slice(e - w, e) for e, w in zip(ends, widths)]


def modules(v, widths: list[int]):
    """A vector column as its modules' unit vectors side by side; one that is all zeros stays so."""
    starts = np.cumsum([1, *widths[:-1]])
    return F.concat(*[unit(F.slice(v, int(s), w)) for s, w in zip(starts, widths)])


class Batches:
    """Blocks of anchored nodes (both ends in one row) and of nodes without a counterpart, by pair."""

    def __init__(self, nodes: DataFrame, anchors: DataFrame, widths: list[int], valid, size: int = 256):
        """``nodes``: ``pair_id, side, node, v``; ``anchors``: ``pair_id, s, r``, one to one; ``valid``: a
        condition on ``pair_id`` for pairs that are validated on and not trained on. Anchors whose nodes are
        missing, null keys, and vectors that are null or of another length don't take part; repeated
        rows of a node or an anchor count once."""
        self.widths, width = widths, sum(widths)
        n = nodes.where(F.col("v").isNotNull() & (F.size("v") == width) & F.col("pair_id").isNotNull() & F.col("node").isNotNull() & F.col("side").isin(0, 1))
        n = n.groupBy("pair_id", "side", "node").agg(F.min("v").alias("v")).select("pair_id", "side", "node", modules(F.col("v"), widths).alias("u"))
        a = anchors.select("pair_id", "s", "r").distinct()
        ends = a.join(n.where("side = 0").select("pair_id", F.col("node").alias("s"), F.col("u").alias("src")), ["pair_id", "s"]).join(
            n.where("side = 1").select("pair_id", F.col("node").alias("r"), F.col("u").alias("ref")), ["pair_id", "r"])
        used = ends.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("node")), F.struct(F.lit(1).alias("side"), F.col("r").alias("node")))).alias("x")).select("pair_id", "x.*")
        rest = n.join(used, ["pair_id", "side", "node"], "left_anti")

        def blocks(df, keys, id_, *cols):
            counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
            b = df.join(counts, keys).withColumn("block", F.pmod(F.xxhash64(id_), F.ceil(F.col("n") / size)))
            rows = F.sort_array(F.collect_list(F.struct(id_, *cols)))
            return b.groupBy(*keys, "block", "n").agg(rows.alias("rows")).select(*keys, "block", "n", *[F.flatten(F.col(f"rows.{c}")).alias(c) for c in cols])

        self.anchored = durable(blocks(ends, ["pair_id"], "s", "src", "ref").withColumn("held", valid), "anchored")
        self.rest = durable(blocks(rest, ["pair_id", "side"], "node", "u"), "unanchored")


def _rows(flat, widths) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, sum(widths))


def _similar(a, b, v, widths):
    """Similarities by module, joint ones, and these' derivatives by ``v``, the squared weights."""
    cuts = _slices(widths)
    s = np.stack([a[:, c] @ b[:, c].T for c in cuts])
    has = [np.stack([(x[:, c] != 0).any(axis=1) for c in cuts]).astype(float) for x in (a, b)]
    inv = [np.divide(1.0, q, out=np.zeros_like(q), where=q > 0) for q in (v @ has[0], v @ has[1])]
    scale = np.sqrt(np.outer(*inv))
    joint = np.tensordot(v, s, 1) * scale
    grad = s * scale - joint / 2 * ((has[0] * inv[0])[:, :, None] + (has[1] * inv[1])[:, None, :])
    return s, joint, grad


def _sums(anchored, rest, v, widths) -> list[float]:
    """Of two blocks, for both ends and temperatures: sums of exp(similarity / temperature), joint, its
    derivatives, by module."""
    out = []
    for end in anchored:
        s, joint, grad = _similar(end, rest, v, widths)
        for t in (CONTRAST, ALIGN):
            e = np.exp(joint / t)
            out += [e.sum(), *(grad / t * e).sum(axis=(1, 2)), *np.exp(s / t).sum(axis=(1, 2))]
    return [float(x) for x in out]


def _share(e, de, first, d_first, second, d_second):
    """The pair probability of exponentials against two sums of negatives, and its derivative."""
    f, g = first + EPS, second + EPS
    a, b = e / f, e / g
    inv = 1 + 1 / (a + EPS) + 1 / (b + EPS)
    q = 1 / (inv + EPS)
    if de is None:
        return q, None
    da = de / f - e * (d_first / f**2)[:, None, None]
    db = de / g - e * (d_second / g**2)[:, None, None]
    return q, (da / (a + EPS) ** 2 + db / (b + EPS) ** 2) * q**2


def _losses(left, right, sums, n, v, widths) -> list[float]:
    """Of two anchored blocks: contrastive loss of the joint embedding (its share of the mean), derivatives,
    alignment losses by module, derivatives, contrastive losses by module."""
    k = len(widths)
    # sums[side of the rest][end][temperature]: joint, derivatives, modules
    s = np.asarray(sums, dtype=float).reshape(2, 2, 2, 1 + 2 * k)
    sides = [(_similar(left[0], right[1], v, widths), s[0, 0], s[1, 0]), (_similar(left[1], right[0], v, widths), s[1, 1], s[0, 1])]

    def joint(i, t):
        (_, j, g), f, h = sides[i]
        e = np.exp(j / (CONTRAST, ALIGN)[t])
        return _share(e, e * g / (CONTRAST, ALIGN)[t], f[t, 0], f[t, 1 : 1 + k], h[t, 0], h[t, 1 : 1 + k])

    def single(i, t, m):
        (x, _, _), f, h = sides[i]
        return _share(np.exp(x[m] / (CONTRAST, ALIGN)[t]), None, f[t, 1 + k + m], None, h[t, 1 + k + m], None)[0]

    (qa, da), (qb, db) = joint(0, 0), joint(1, 0)
    q = MIX * qa + (1 - MIX) * qb
    out = [-np.log(q).sum() / n**2, *(-(MIX * da + (1 - MIX) * db) / q).sum(axis=(1, 2)) / n**2]
    (qa, da), (qb, db) = joint(0, 1), joint(1, 1)
    value, grad, own = [], [], []
    for m in range(k):
        pa, pb = single(0, 1, m), single(1, 1, m)
        ea, eb = np.exp(pa), np.exp(pb)
        value.append(ZOOM * (MIX * (ea * (pa - np.log(qa))).sum() + (1 - MIX) * (eb * (pb - np.log(qb))).sum()))
        grad += [*(-ZOOM * (MIX * (ea / qa * da).sum(axis=(1, 2)) + (1 - MIX) * (eb / qb * db).sum(axis=(1, 2))))]
        own.append(-np.log(MIX * single(0, 0, m) + (1 - MIX) * single(1, 0, m)).sum() / n**2)
    return [float(x) for x in (*out, *value, *grad, *own)]


def _array(form: str, at: list[tuple]):
    """An array of one expression at many places, parsed at once: built one by one they cost more than an epoch's work."""
    return F.expr(f"array({', '.join(form.format(*i) for i in at)})")


def pair_losses(batches: Batches, theta: list[float]) -> DataFrame:
    """EXT-17: ``pair_id, held, n, losses`` of every pair with an anchor, at the fusion logits ``theta``;
    ``losses`` as :func:`_losses` lists them, for a batch of that one pair.

    A pair without nodes that have no counterpart has sums of zero, as the formulas allow. The mean and the
    sums run over all ordered couples of a pair's anchors, the forward couple (i, j) beside the backward
    couple of the same two positions.
    """
    widths, k = batches.widths, len(batches.widths)
    w = np.exp(np.asarray(theta, dtype=float) - max(theta))
    v = (w / w.sum()) ** 2

    def sums(parts):
        for pdf in parts:
            got = [_sums((_rows(a, widths), _rows(b, widths)), _rows(u, widths), v, widths) for a, b, u in zip(pdf["src"], pdf["ref"], pdf["u"])]
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "side": pdf["side"], "x": got})

    def losses(parts):
        for pdf in parts:
            got = [_losses((_rows(a, widths), _rows(b, widths)), (_rows(c, widths), _rows(d, widths)), s, n, v, widths) for a, b, c, d, s, n in zip(pdf["src"], pdf["ref"], pdf["src2"], pdf["ref2"], pdf["sums"], pdf["n"])]
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "held": pdf["held"], "n": pdf["n"], "x": got})

    key = batches.anchored.schema["pair_id"].dataType.simpleString()
    size = 4 * (1 + 2 * k)
    a = batches.anchored
    met = a.select("pair_id", "src", "ref").join(batches.rest.select("pair_id", "side", "u"), "pair_id").mapInPandas(sums, f"pair_id {key}, side INT, x ARRAY<DOUBLE>")
    by_pair = met.groupBy("pair_id").agg(_array("sum(if(side = {}, x[{}], 0D))", [(h, i) for h in (0, 1) for i in range(size)]).alias("sums"))
    both = a.join(a.select("pair_id", F.col("src").alias("src2"), F.col("ref").alias("ref2")), "pair_id").join(by_pair, "pair_id", "left")
    both = both.withColumn("sums", F.coalesce("sums", F.array_repeat(F.lit(0.0), 2 * size))).select("pair_id", "held", "n", "src", "ref", "src2", "ref2", "sums")
    done = both.mapInPandas(losses, f"pair_id {key}, held BOOLEAN, n BIGINT, x ARRAY<DOUBLE>")
    return done.groupBy("pair_id", "held", "n").agg(_array("sum(x[{}])", [(i,) for i in range(1 + 3 * k + k * k)]).alias("losses"))


def combined(mean: np.ndarray, theta, align, contrast, zoom: float = 0.1) -> tuple[float, np.ndarray]:
    """The whole loss of mean ``losses`` and its gradient by ``theta``, ``align`` and ``contrast`` (the
    logarithms of the losses' variances). With a single module there is no fusion: its contrastive loss alone."""
    k = len(theta)
    theta, align, contrast = (np.asarray(x, dtype=float) for x in (theta, align, contrast))
    joint, d_joint, ial, d_ial, icl = mean[0], mean[1 : 1 + k], mean[1 + k : 1 + 2 * k], mean[1 + 2 * k : 1 + 2 * k + k * k].reshape(k, k), mean[1 + 2 * k + k * k :]
    if k == 1:
        return float(icl[0]), np.zeros(3)
    pa, pc = np.exp(-align), np.exp(-contrast)
    loss = zoom * (pa * ial + align).sum() + (pc * icl + contrast).sum() + joint
    by_v = d_joint + zoom * pa @ d_ial
    w = np.exp(theta - theta.max())
    w /= w.sum()
    by_theta = 2 * w * (by_v * w - (by_v * w * w).sum())
    return float(loss), np.concatenate([by_theta, zoom * (1 - pa * ial), 1 - pc * icl])


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """STR-05: a run's epochs so far with ``best``: the first one with the least validation loss."""
    df = spark.read.schema(SNAPSHOT).parquet(folder)
    least = F.min(F.when(F.col("valid_loss").isNotNull() & ~F.isnan("valid_loss"), F.struct("valid_loss", "epoch"))).over(Window.partitionBy())
    return df.withColumn("best", F.coalesce(F.col("epoch") == least["epoch"], F.lit(False)))


def train_fusion(batches: Batches, folder: str, epochs: int, rate: float = 0.05, zoom: float = 0.1) -> DataFrame:
    """STR-05, EXT-17: full-batch Adam on the fusion logits and the losses' variances; returns
    :func:`snapshots`.

    An epoch is one evaluation of all pairs: the training pairs' mean loss and gradient, the validation pairs' mean
    loss (not the last batch's), both at the epoch's parameters. Its snapshot is one
    row in a folder of its own, written before the step; a run that finds snapshots goes on from the last one
    (the step is recomputed from what it holds), so a killed run ends with the same parameters. Epochs beyond
    ``epochs`` are left as they are. No training pair: parameters stay. A gradient that isn't finite is an error.
    """
    spark, k = batches.anchored.sparkSession, len(batches.widths)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    last = spark.read.schema(SNAPSHOT).parquet(folder).orderBy(F.desc("epoch")).first() if found else None
    p, m, s, first = np.zeros(3 * k), np.zeros(3 * k), np.zeros(3 * k), 0
    if last:
        # moments are stored after the epoch's gradient, parameters before its step
        p, m, s, first = np.array(last.theta + last.align + last.contrast), np.array(last.moment), np.array(last.spread), last.epoch + 1
        p = _stepped(p, m, s, first, rate)
    for epoch in range(first, epochs):
        theta, align, contrast = (p[i * k : i * k + k].tolist() for i in range(3))
        width = 1 + 3 * k + k * k
        got = {r.held: (r.n, np.array(r.mean)) for r in pair_losses(batches, theta).groupBy("held").agg(F.count("*").alias("n"), _array("avg(losses[{}])", [(i,) for i in range(width)]).alias("mean")).collect()}
        train, valid = (combined(got[h][1], theta, align, contrast, zoom) if h in got else (None, np.zeros(3 * k)) for h in (False, True))
        if not np.isfinite(train[1]).all():
            raise ValueError(f"epoch {epoch}: the gradient isn't finite")
        m, s = 0.9 * m + 0.1 * train[1], 0.999 * s + 0.001 * train[1] ** 2
        row = (epoch, theta, align, contrast, m.tolist(), s.tolist(), got.get(False, (0,))[0], train[0], got.get(True, (0,))[0], valid[0])
        spark.createDataFrame([row], SNAPSHOT).drop("epoch").coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        p = _stepped(p, m, s, epoch + 1, rate)
    return snapshots(spark, folder)


def _stepped(p, m, s, steps, rate):
    return p - rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)


def neighbourhood_losses(nodes: DataFrame, anchors: DataFrame, widths: list[int], alpha: float = 1.0, beta: float = 1.0, least: float = 0.0) -> DataFrame:
    """EXT-17, the neighbourhood form: ``pair_id, module (the last: the whole vector), n, loss`` over a pair's anchors. Both
    directions' soft margins over the other anchors, and the anchors' own similarities. Anchors without nodes
    don't take part; null vectors have none."""
    starts = np.cumsum([1, *widths[:-1]])
    cut = F.array(*[F.slice("v", int(s), w) for s, w in zip(starts, widths)], F.col("v"))
    a = anchors.select("pair_id", "s", "r").distinct()
    only = nodes.select("pair_id", "side", "node", "v").where(F.size("v") == sum(widths)).select("pair_id", "side", "node", F.posexplode(cut).alias("module", "v"))
    sims = similarities(only.select(F.struct("pair_id", "module").alias("pair_id"), "side", "node", "v")).select("pair_id.pair_id", "pair_id.module", "a", "b", "sim")
    x = sims.join(a.select("pair_id", F.col("s").alias("a")), ["pair_id", "a"]).join(a.select("pair_id", F.col("s").alias("own"), F.col("r").alias("b")), ["pair_id", "b"])
    e = F.when(F.col("a") != F.col("own"), F.exp(alpha * (F.col("sim") - least))).otherwise(0.0)
    rows = x.groupBy("pair_id", "module", "a").agg(F.log1p(F.sum(e)).alias("l"), (-beta * F.log1p(F.max(F.when(F.col("a") == F.col("own"), F.greatest("sim", F.lit(0.0)))))).alias("d"))
    cols = x.groupBy("pair_id", "module", "own").agg(F.log1p(F.sum(e)).alias("l"))
    left = rows.groupBy("pair_id", "module").agg(F.count("*").alias("n"), (F.avg("l") / alpha + F.avg("d")).alias("left"))
    return left.join(cols.groupBy("pair_id", "module").agg((F.avg("l") / alpha).alias("right")), ["pair_id", "module"]).select("pair_id", "module", "n", (F.col("left") + F.col("right")).alias("loss"))
