"""Cross-graph node matching and its metrics.

Nodes: ``pair_id, side (0 source, 1 reference), node, v``. Anchors: ``pair_id, s, r``. Every join is
within a pair, so pairs are the unit of distribution; ranks end in the node id, so ties are settled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.vectors import dot, unit

TIE_DIGITS = 9


def similarities(nodes: DataFrame, within: bool = False) -> DataFrame:
    """JOI-06: ``pair_id, a, b, sim`` of every source with every reference node (``within``: of every
    two different nodes of the pair). Similarities are rounded so that ranks don't hang on the last bit."""
    u = nodes.select("pair_id", "side", "node", unit("v").alias("u"))
    a = u.select("pair_id", F.col("side").alias("side_a"), F.col("node").alias("a"), F.col("u").alias("ua"))
    b = u.select("pair_id", F.col("side").alias("side_b"), F.col("node").alias("b"), F.col("u").alias("ub"))
    on = F.col("a") != F.col("b") if within else (F.col("side_a") == 0) & (F.col("side_b") == 1)
    return a.join(b, "pair_id").where(on).select("pair_id", "a", "b", "side_a", "side_b", F.round(dot("ua", "ub"), TIE_DIGITS).alias("sim"))


def ranks(sims: DataFrame) -> DataFrame:
    """Adds ``rank``: of b among a's partners, the most similar first."""
    return sims.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id", "a").orderBy(F.col("sim").desc(), "b")))


def mutual_candidates(nodes: DataFrame, k: int = 5, cap: int = 48, mutual: bool = True) -> DataFrame:
    """JOI-07: candidates ranked among the other graph's nodes only, both ways.

    A pair needs both ranks at most ``k`` (without ``mutual``: the forward one; a reverse rank beyond
    k counts as k + 1). Order: worst rank, rank sum, forward, reverse rank, ids; ``cap`` a pair.
    """
    s = similarities(nodes)
    f = ranks(s).where(F.col("rank") <= k).select("pair_id", F.col("a").alias("s"), F.col("b").alias("r"), F.col("rank").alias("forward_rank"), "sim")
    back = s.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id", "b").orderBy(F.col("sim").desc(), "a"))).where(F.col("rank") <= k)
    back = back.select("pair_id", F.col("a").alias("s"), F.col("b").alias("r"), F.col("rank").alias("reverse_rank"))
    out = f.join(back, ["pair_id", "s", "r"], "inner" if mutual else "left").withColumn("reverse_rank", F.coalesce("reverse_rank", F.lit(k + 1)))
    out = out.withColumn("worst_rank", F.greatest("forward_rank", "reverse_rank")).withColumn("rank_sum", F.col("forward_rank") + F.col("reverse_rank"))
    w = Window.partitionBy("pair_id").orderBy("worst_rank", "rank_sum", "forward_rank", "reverse_rank", "s", "r")
    return out.withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap)


def official_candidates(nodes: DataFrame, k: int = 3) -> DataFrame:
    """WIN-01 / WIN-02: the k best of all other nodes first, then those of the other graph only."""
    return ranks(similarities(nodes, within=True)).where((F.col("rank") <= k) & (F.col("side_a") == 0) & (F.col("side_b") == 1)).select("pair_id", F.col("a").alias("s"), F.col("b").alias("r"), "rank", "sim")


def alignment_score(nodes: DataFrame) -> DataFrame:
    """AGG-28: sources whose best node of all is a reference node, over the number of reference nodes."""
    top = ranks(similarities(nodes, within=True)).where("rank = 1 AND side_a = 0").groupBy("pair_id").agg(F.count_if(F.col("side_b") == 1).alias("hits"))
    refs = nodes.groupBy("pair_id").agg(F.count_if(F.col("side") == 1).alias("refs"))
    return refs.join(top, "pair_id", "left").select("pair_id", F.coalesce("hits", F.lit(0)).alias("hits"), "refs", (F.coalesce("hits", F.lit(0)) / F.col("refs")).alias("score"))


def pair_metrics(predictions: DataFrame, sims: DataFrame, anchors: DataFrame) -> DataFrame:
    """AGG-15, SET-01: per pair tp, precision, recall, F1 (epsilon 1e-12), top-1 and top-5 hits over
    anchors, and the margin between the mean similarity of anchors and of other pairs (null without anchors)."""
    pred = predictions.select("pair_id", "s", "r").distinct()
    tp = pred.join(anchors, ["pair_id", "s", "r"], "left_semi").groupBy("pair_id").agg(F.count("*").alias("tp"))
    size = lambda df, name: df.groupBy("pair_id").agg(F.count("*").alias(name))
    seen = ranks(sims).select("pair_id", F.col("a").alias("s"), F.col("b").alias("r"), "rank", "sim").join(anchors.withColumn("true", F.lit(1)), ["pair_id", "s", "r"], "left")
    hits = seen.groupBy("pair_id").agg(F.count_if((F.col("true") == 1) & (F.col("rank") == 1)).alias("top1_hit"), F.count_if((F.col("true") == 1) & (F.col("rank") <= 5)).alias("top5_hit"), (F.avg(F.when(F.col("true") == 1, F.col("sim"))) - F.avg(F.when(F.col("true").isNull(), F.col("sim")))).alias("margin"))
    out = hits.join(size(anchors, "anchor_count"), "pair_id", "left").join(size(pred, "pred_count"), "pair_id", "left").join(tp, "pair_id", "left").fillna(0, ["anchor_count", "pred_count", "tp"])
    p, r = F.col("tp") / F.greatest(F.col("pred_count"), F.lit(1)), F.col("tp") / F.greatest(F.col("anchor_count"), F.lit(1))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-12))


def aggregate_metrics(per_pair: DataFrame) -> DataFrame:
    """AGG-16: one row of macro (mean of ratios) and micro (ratio of sums) metrics."""
    t, p, a = F.sum("tp"), F.sum("pred_count"), F.sum("anchor_count")
    return per_pair.agg(
        F.count("*").alias("pairs"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.coalesce(2 * t / F.when(p + a > 0, p + a), F.lit(0.0)).alias("micro_f1"),
        (F.sum("top1_hit") / F.greatest(a, F.lit(1))).alias("micro_top1"), F.avg(F.col("top1_hit") / F.greatest("anchor_count", F.lit(1))).alias("macro_top1"), F.count_if(F.col("pred_count") == 0).alias("zero_candidate"), F.avg("margin").alias("margin"),
    )


def gate_metrics(per_pair: DataFrame) -> DataFrame:
    """AGG-17: macro and micro metrics with fixed denominators: a pair without predictions (anchors) has precision
    (recall, hits) 0, F1 is exactly 0 where both are, and every pair counts. Micro values are null if nothing is pooled."""
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    x = per_pair.withColumn("p", part("tp", "pred_count")).withColumn("r", part("tp", "anchor_count")).withColumn("f", part(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    pooled = x.agg(
        F.count("*").alias("pairs"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"), *[F.avg(part(f"{k}_hit", "anchor_count")).alias(f"macro_{k}") for k in ("top1", "top5")],
        *[F.sum(c).alias(f"pooled_{c}") for c in ("tp", "pred_count", "anchor_count", "top1_hit", "top5_hit")],
    )
    over = lambda a, b: F.try_divide(f"pooled_{a}", f"pooled_{b}")
    out = pooled.withColumn("micro_precision", over("tp", "pred_count")).withColumn("micro_recall", over("tp", "anchor_count")).withColumn("micro_top1", over("top1_hit", "anchor_count")).withColumn("micro_top5", over("top5_hit", "anchor_count"))
    both = F.col("micro_precision") + F.col("micro_recall")
    return out.withColumn("micro_f1", F.when(both == 0, 0.0).otherwise(2 * F.col("micro_precision") * F.col("micro_recall") / both))


def rank_metrics(sims: DataFrame, anchors: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """AGG-25, AGG-26: per pair the mean reciprocal rank of the true matches and hits at k."""
    r = ranks(sims).select("pair_id", F.col("a").alias("s"), F.col("b").alias("r"), "rank")
    return anchors.join(r, ["pair_id", "s", "r"]).groupBy("pair_id").agg(F.count("*").alias("n"), F.avg(1.0 / F.col("rank")).alias("mrr"), *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks])


def all_correct(sims: DataFrame, anchors: DataFrame) -> DataFrame:
    """AGG-27: whether the best-ranked prefix of queries (first 2, half, all) is right throughout; an empty prefix is."""
    best = ranks(sims).where("rank = 1").select("pair_id", F.col("a").alias("s"), F.col("b").alias("got"), "sim")
    q = anchors.join(best, ["pair_id", "s"])
    w = Window.partitionBy("pair_id").orderBy(F.col("sim").desc(), "s")
    q = q.withColumn("at", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("pair_id")))
    good = lambda bound: F.coalesce(F.every(F.when(F.col("at") <= bound, F.col("got") == F.col("r"))), F.lit(True)).cast("int")
    return q.groupBy("pair_id").agg(good(F.lit(2)).alias("best_2"), good(F.floor(F.col("n") / 2)).alias("best_half"), good(F.col("n")).alias("best_all"))


def split_merge_recall(predictions: DataFrame, anchors: DataFrame) -> DataFrame:
    """AGG-24: recall on anchors whose source (reference) has several anchors; null where there are none."""
    w = lambda c: Window.partitionBy("pair_id", c)
    a = anchors.withColumn("of_s", F.count("*").over(w("s"))).withColumn("of_r", F.count("*").over(w("r")))
    hit = a.join(predictions.select("pair_id", "s", "r").distinct().withColumn("hit", F.lit(1)), ["pair_id", "s", "r"], "left")
    rec = lambda c: F.avg(F.when(F.col(c) >= 2, F.coalesce("hit", F.lit(0)).cast("double")))
    return hit.groupBy("pair_id").agg(rec("of_s").alias("split_recall"), rec("of_r").alias("merge_recall"))


def info_nce(sims: DataFrame, positives: DataFrame, temperature: float = 0.1) -> DataFrame:
    """EXT-15 / EXT-16, the value: bidirectional multi-positive log-sum-exp loss per pair, mean over
    rows with a positive. ``positives``: ``pair_id, s, r, weight, ambiguous``; ambiguous cells leave the
    denominator and weigh nothing."""
    x = sims.select("pair_id", F.col("a").alias("s"), F.col("b").alias("r"), (F.col("sim") / temperature).alias("l")).join(positives, ["pair_id", "s", "r"], "left")
    x = x.where("ambiguous IS NULL OR NOT ambiguous")

    def one(side):
        top = x.withColumn("m", F.max("l").over(Window.partitionBy("pair_id", side)))
        row = top.groupBy("pair_id", side).agg(F.log(F.sum(F.exp(F.col("l") - F.col("m")))).alias("all"), F.log(F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.exp(F.col("l") - F.col("m"))))).alias("pos"))
        return row.where("pos IS NOT NULL").groupBy("pair_id").agg(F.avg(F.col("all") - F.col("pos")).alias(f"loss_{side}"))

    return one("s").join(one("r"), "pair_id").withColumn("loss", (F.col("loss_s") + F.col("loss_r")) / 2)


def ratio_test_matches(descriptors: DataFrame, ratio: float = 0.97, cap: int = 700) -> DataFrame:
    """JOI-14: reciprocal nearest descriptors whose nearest distance is at most ``ratio`` of the second's.
    A descriptor with one partner only passes. Order: ratio, source, reference; ``cap`` a pair."""
    a = descriptors.where("side = 0").select("pair_id", F.col("node").alias("s"), F.col("v").alias("vs"))
    b = descriptors.where("side = 1").select("pair_id", F.col("node").alias("r"), F.col("v").alias("vr"))
    d = a.join(b, "pair_id").select("pair_id", "s", "r", F.round(F.sqrt(F.aggregate(F.zip_with("vs", "vr", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)), TIE_DIGITS).alias("d"))
    f, g = Window.partitionBy("pair_id", "s").orderBy("d", "r"), Window.partitionBy("pair_id", "r").orderBy("d", "s")
    d = d.select("*", F.row_number().over(f).alias("fwd"), F.lead("d").over(f).alias("second"), F.row_number().over(g).alias("rev"))
    d = d.where("fwd = 1 AND rev = 1").withColumn("score", F.round(F.when(F.col("second").isNull(), 0.0).when(F.col("second") > 0, F.col("d") / F.col("second")).otherwise(1.0), TIE_DIGITS)).where(F.col("score") <= ratio)
    return d.withColumn("position", F.row_number().over(Window.partitionBy("pair_id").orderBy("score", "s", "r"))).where(F.col("position") <= cap).select("pair_id", "s", "r", "d", "score", "position")


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pdf.pivot(index="a", columns="b", values="sim").sort_index(axis=0).sort_index(axis=1)
    return table.to_numpy(), table.index.to_numpy(), table.columns.to_numpy()


def sinkhorn_matrix(sim: np.ndarray, temperature: float, iterations: int) -> np.ndarray:
    """Alternating row and column normalisation of the clipped exponentials."""
    p = np.exp(np.clip((sim - sim.max()) / temperature, -60.0, 0.0)) + 1e-12
    for _ in range(iterations):
        p = p / p.sum(axis=1, keepdims=True)
        p = p / p.sum(axis=0, keepdims=True)
    return p


def sinkhorn(sims: DataFrame, temperature: float = 0.1, iterations: int = 30) -> DataFrame:
    """FUN-02: ``pair_id, s, r, sim, weight``; 30 alternating sums are one numpy loop over a pair's
    matrix, not 60 shuffles. A group is one pair's objects: bounded by the two graphs."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m, rows, cols = _matrix(pdf)
        w = sinkhorn_matrix(m, temperature, iterations)
        return pd.DataFrame({"pair_id": pdf["pair_id"].iloc[0], "s": np.repeat(rows, len(cols)), "r": np.tile(cols, len(rows)), "sim": m.ravel(), "weight": w.ravel()})

    return sims.select("pair_id", "a", "b", "sim").groupBy("pair_id").applyInPandas(one, "pair_id long, s long, r long, sim double, weight double")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns (shortest augmenting paths with potentials); ties fall
    to the lowest column."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        best, parent, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last = start, -1
        while True:
            through = cost[row] - row_price[row] - col_price
            base = 0.0 if last < 0 else best[last]
            better = ~done & (base + through < best)
            best[better] = base + through[better]
            parent[better] = last
            open_ = np.where(done, np.inf, best)
            j = int(open_.argmin())
            reach = best[j]
            done[j] = True
            last = j
            if owner[j] < 0:
                break
            row = owner[j]
        row_price[start] += reach
        for j in np.flatnonzero(done):
            if j != last:
                row_price[owner[j]] += reach - best[j]
                col_price[j] -= reach - best[j]
        while last >= 0:
            before = parent[last]
            owner[last] = start if before < 0 else owner[before]
            last = before
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def optimal_assignment(scored: DataFrame) -> DataFrame:
    """CLU-25: the one-to-one assignment of the largest total weight per pair (``pair_id, s, r, weight``)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m, rows, cols = _matrix(pdf.rename(columns={"s": "a", "r": "b", "weight": "sim"}))
        got = assign(-m)
        return pd.DataFrame({"pair_id": pdf["pair_id"].iloc[0], "s": [rows[i] for i, _ in got], "r": [cols[j] for _, j in got], "weight": [m[i, j] for i, j in got]})

    return scored.select("pair_id", "s", "r", "weight").groupBy("pair_id").applyInPandas(one, "pair_id long, s long, r long, weight double")
