from pyspark.sql import functions as F

from keelson.functions.vectors import rounded
from keelson.operators import matching as M
from keelson.plans import views as V
from keelson.plans.registry import query

#: Similarity of every source with every reference node, and ranks, in SQL.
SIM = """sims AS (SELECT a.pair_id, a.node AS a, b.node AS b, round(list_inner_product(a.v, b.v) / (greatest(sqrt(list_inner_product(a.v, a.v)), 1e-12) * greatest(sqrt(list_inner_product(b.v, b.v)), 1e-12)), 9) AS sim
  FROM nodes a JOIN nodes b USING (pair_id) WHERE a.side = 0 AND b.side = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id, a ORDER BY sim DESC, b) AS rank, row_number() OVER (PARTITION BY pair_id, b ORDER BY sim DESC, a) AS back FROM sims)"""
WITHIN = """within AS (SELECT *, row_number() OVER (PARTITION BY pair_id, a ORDER BY sim DESC, b) AS rank FROM (
  SELECT a.pair_id, a.node AS a, b.node AS b, a.side AS side_a, b.side AS side_b, round(list_inner_product(a.v, b.v) / (greatest(sqrt(list_inner_product(a.v, a.v)), 1e-12) * greatest(sqrt(list_inner_product(b.v, b.v)), 1e-12)), 9) AS sim
  FROM nodes a JOIN nodes b USING (pair_id) WHERE a.node <> b.node))"""
MUTUAL = """pred AS (SELECT pair_id, a AS s, b AS r, rank, back, sim FROM ranked WHERE rank <= 5 AND back <= 5)"""


@query("join_cross_graph_similarity", V.sql("nodes", f"WITH {SIM} SELECT pair_id, a AS s, b AS r, rank, round(sim, 6) AS sim FROM ranked WHERE rank <= 10"))
def similarity(spark, d):
    """JOI-06, FUN-01."""
    return M.ranks(M.similarities(V.nodes(spark, d))).where("rank <= 10").select("pair_id", F.col("a").alias("s"), F.col("b").alias("r"), F.col("rank").cast("long").alias("rank"), rounded("sim").alias("sim"))


@query(
    "join_mutual_candidates",
    V.sql("nodes", f"""WITH {SIM}, {MUTUAL}
      SELECT * FROM (SELECT pair_id, s, r, rank AS forward_rank, back AS reverse_rank, greatest(rank, back) AS worst_rank, rank + back AS rank_sum, round(sim, 6) AS sim,
        row_number() OVER (PARTITION BY pair_id ORDER BY greatest(rank, back), rank + back, rank, back, s, r) AS position FROM pred) WHERE position <= 48"""),
)
def mutual(spark, d):
    """JOI-07; the flagship."""
    return M.mutual_candidates(V.nodes(spark, d)).select("pair_id", "s", "r", F.col("forward_rank").cast("long").alias("forward_rank"), F.col("reverse_rank").cast("long").alias("reverse_rank"), F.col("worst_rank").cast("long").alias("worst_rank"), F.col("rank_sum").cast("long").alias("rank_sum"), rounded("sim").alias("sim"), F.col("position").cast("long").alias("position"))


@query("join_one_way_candidates", V.sql("nodes", f"""WITH {SIM} SELECT * FROM (SELECT pair_id, a AS s, b AS r, rank AS forward_rank, least(back, 4) AS reverse_rank,
        row_number() OVER (PARTITION BY pair_id ORDER BY greatest(rank, least(back, 4)), rank + least(back, 4), rank, least(back, 4), a, b) AS position FROM ranked WHERE rank <= 3) WHERE position <= 48"""))
def one_way(spark, d):
    """JOI-07 without the mutual filter."""
    return M.mutual_candidates(V.nodes(spark, d), k=3, mutual=False).select("pair_id", "s", "r", F.col("forward_rank").cast("long").alias("forward_rank"), F.col("reverse_rank").cast("long").alias("reverse_rank"), F.col("position").cast("long").alias("position"))


@query("window_official_topk", V.sql("nodes", f"WITH {WITHIN} SELECT pair_id, a AS s, b AS r, rank, round(sim, 6) AS sim FROM within WHERE rank <= 3 AND side_a = 0 AND side_b = 1"))
def official(spark, d):
    """WIN-01, WIN-02."""
    return M.official_candidates(V.nodes(spark, d)).select("pair_id", "s", "r", F.col("rank").cast("long").alias("rank"), rounded("sim").alias("sim"))


@query("agg_alignment_score", V.sql("nodes", f"WITH {WITHIN} SELECT pair_id, count(*) FILTER (WHERE side_a = 0 AND side_b = 1 AND rank = 1) AS hits, any_value(n) AS refs, round(count(*) FILTER (WHERE side_a = 0 AND side_b = 1 AND rank = 1) / any_value(n), 6) AS score FROM within JOIN (SELECT pair_id, count(*) AS n FROM nodes WHERE side = 1 GROUP BY pair_id) USING (pair_id) GROUP BY pair_id"))
def score(spark, d):
    """AGG-28."""
    return M.alignment_score(V.nodes(spark, d)).withColumn("score", rounded("score"))


PER_PAIR = f"""WITH {SIM}, {MUTUAL},
  t AS (SELECT pair_id, count(*) AS tp FROM pred JOIN anchors USING (pair_id, s, r) GROUP BY pair_id), n AS (SELECT pair_id, count(*) AS pred_count FROM pred GROUP BY pair_id), k AS (SELECT pair_id, count(*) AS anchor_count FROM anchors GROUP BY pair_id),
  h AS (SELECT x.pair_id, count(*) FILTER (WHERE y.s IS NOT NULL AND rank = 1) AS top1_hit, count(*) FILTER (WHERE y.s IS NOT NULL AND rank <= 5) AS top5_hit, avg(sim) FILTER (WHERE y.s IS NOT NULL) - avg(sim) FILTER (WHERE y.s IS NULL) AS margin
        FROM ranked x LEFT JOIN anchors y ON x.pair_id = y.pair_id AND x.a = y.s AND x.b = y.r GROUP BY x.pair_id),
  m AS (SELECT h.*, coalesce(tp, 0) AS tp, coalesce(pred_count, 0) AS pred_count, coalesce(anchor_count, 0) AS anchor_count FROM h LEFT JOIN t USING (pair_id) LEFT JOIN n USING (pair_id) LEFT JOIN k USING (pair_id)),
  pp AS (SELECT *, tp / greatest(pred_count, 1) AS precision, tp / greatest(anchor_count, 1) AS recall, 2 * (tp / greatest(pred_count, 1)) * (tp / greatest(anchor_count, 1)) / (tp / greatest(pred_count, 1) + tp / greatest(anchor_count, 1) + 1e-12) AS f1 FROM m)"""


def _per_pair(spark, d):
    n = V.nodes(spark, d)
    return M.pair_metrics(M.mutual_candidates(n, cap=1 << 30), M.similarities(n), V.anchors(spark, d))


@query("agg_pair_node_metrics", V.sql("nodes anchors", f"{PER_PAIR} SELECT pair_id, tp, pred_count, anchor_count, top1_hit, top5_hit, round(margin, 6) AS margin, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pp"))
def per_pair(spark, d):
    """AGG-15, SET-01."""
    return _per_pair(spark, d).select("pair_id", "tp", "pred_count", "anchor_count", "top1_hit", "top5_hit", *[rounded(c).alias(c) for c in ("margin", "precision", "recall", "f1")])


@query("agg_macro_micro", V.sql("nodes anchors", f"""{PER_PAIR} SELECT count(*) AS pairs, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(coalesce(2 * sum(tp) / nullif(sum(pred_count) + sum(anchor_count), 0), 0), 6) AS micro_f1,
   round(sum(top1_hit) / greatest(sum(anchor_count), 1), 6) AS micro_top1, round(avg(top1_hit / greatest(anchor_count, 1)), 6) AS macro_top1, count(*) FILTER (WHERE pred_count = 0) AS zero_candidate, round(avg(margin), 6) AS margin FROM pp"""))
def macro_micro(spark, d):
    """AGG-16."""
    out = M.aggregate_metrics(_per_pair(spark, d))
    return out.select("pairs", "zero_candidate", *[rounded(c).alias(c) for c in out.columns if c not in ("pairs", "zero_candidate")])


@query("agg_gate_metrics", V.sql("nodes anchors", f"""{PER_PAIR}, z AS (SELECT *, tp / pred_count AS p, tp / anchor_count AS r FROM (SELECT tp, nullif(pred_count, 0) AS pred_count, nullif(anchor_count, 0) AS anchor_count, top1_hit, top5_hit FROM pp)),
   g AS (SELECT count(*) AS pairs, avg(coalesce(p, 0)) AS macro_precision, avg(coalesce(r, 0)) AS macro_recall, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS macro_f1, avg(coalesce(top1_hit / anchor_count, 0)) AS macro_top1, avg(coalesce(top5_hit / anchor_count, 0)) AS macro_top5,
     sum(tp) / sum(pred_count) AS micro_precision, sum(tp) / sum(anchor_count) AS micro_recall, sum(top1_hit) / sum(anchor_count) AS micro_top1, sum(top5_hit) / sum(anchor_count) AS micro_top5, 2 * sum(tp) / (sum(pred_count) + sum(anchor_count)) AS micro_f1 FROM z)
   SELECT pairs, {', '.join(f'round({k}_{c}, 6) AS {k}_{c}' for k in ('macro', 'micro') for c in ("precision", "recall", "f1", "top1", "top5"))} FROM g"""))
def gate(spark, d):
    """AGG-17."""
    out = M.gate_metrics(_per_pair(spark, d))
    return out.select("pairs", *[rounded(f"{k}_{c}").alias(f"{k}_{c}") for k in ("macro", "micro") for c in ("precision", "recall", "f1", "top1", "top5")])


@query("agg_mrr_hits", V.sql("nodes anchors", f"""WITH {SIM} SELECT x.pair_id, count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, {', '.join(f'count(*) FILTER (WHERE rank <= {k}) AS hits_{k}' for k in range(1, 6))}
   FROM ranked x JOIN anchors y ON x.pair_id = y.pair_id AND x.a = y.s AND x.b = y.r GROUP BY x.pair_id"""))
def mrr(spark, d):
    """AGG-25, AGG-26."""
    return M.rank_metrics(M.similarities(V.nodes(spark, d)), V.anchors(spark, d)).withColumn("mrr", rounded("mrr"))


@query("agg_all_correct", V.sql("nodes anchors", f"""WITH {SIM}, q AS (SELECT y.pair_id, b = r AS ok, row_number() OVER (PARTITION BY y.pair_id ORDER BY sim DESC, s) AS nth, count(*) OVER (PARTITION BY y.pair_id) AS n FROM anchors y JOIN ranked x ON x.pair_id = y.pair_id AND x.a = y.s WHERE rank = 1)
   SELECT pair_id, CAST(coalesce(bool_and(ok) FILTER (WHERE nth <= 2), true) AS INT) AS best_2, CAST(coalesce(bool_and(ok) FILTER (WHERE nth <= n // 2), true) AS INT) AS best_half, CAST(bool_and(ok) AS INT) AS best_all FROM q GROUP BY pair_id"""))
def sgar(spark, d):
    """AGG-27."""
    return M.all_correct(M.similarities(V.nodes(spark, d)), V.anchors(spark, d))


#: Anchors with several partners: reference nodes whose id has the same remainder.
MULTI = "multi AS (SELECT pair_id, s, r FROM anchors UNION SELECT a.pair_id, a.s, b.r FROM anchors a JOIN anchors b ON a.pair_id = b.pair_id AND a.s % 50 = 0 AND b.s % 50 = 2)"


def _multi(spark, d):
    a = V.anchors(spark, d)
    x, y = a.where("s % 50 = 0").select("pair_id", "s"), a.where("s % 50 = 2").select("pair_id", "r")
    return a.union(x.join(y, "pair_id").select("pair_id", "s", "r")).distinct()


@query("agg_split_merge_recall", V.sql("nodes anchors", f"""WITH {SIM}, {MUTUAL}, {MULTI}, c AS (SELECT m.*, count(*) OVER (PARTITION BY m.pair_id, m.s) AS of_s, count(*) OVER (PARTITION BY m.pair_id, m.r) AS of_r, CAST(p.s IS NOT NULL AS INT) AS hit FROM multi m LEFT JOIN pred p USING (pair_id, s, r))
   SELECT pair_id, round(avg(hit) FILTER (WHERE of_s >= 2), 6) AS split_recall, round(avg(hit) FILTER (WHERE of_r >= 2), 6) AS merge_recall FROM c GROUP BY pair_id"""))
def split_merge(spark, d):
    """AGG-24."""
    return M.split_merge_recall(M.mutual_candidates(V.nodes(spark, d), cap=1 << 30), _multi(spark, d)).select("pair_id", rounded("split_recall").alias("split_recall"), rounded("merge_recall").alias("merge_recall"))


@query("agg_info_nce", V.sql("nodes anchors", f"""WITH {SIM}, x AS (SELECT x.pair_id, a, b, sim / 0.1 AS l, y.s IS NOT NULL AS pos FROM sims x LEFT JOIN anchors y ON x.pair_id = y.pair_id AND x.a = y.s AND x.b = y.r WHERE y.s IS NULL OR y.s % 7 <> 0),
   f AS (SELECT pair_id, avg(l) AS loss_s FROM (SELECT pair_id, a, ln(sum(exp(l))) - ln(sum(exp(l)) FILTER (WHERE pos)) AS l FROM x GROUP BY pair_id, a) WHERE l IS NOT NULL GROUP BY pair_id),
   g AS (SELECT pair_id, avg(l) AS loss_r FROM (SELECT pair_id, b, ln(sum(exp(l))) - ln(sum(exp(l)) FILTER (WHERE pos)) AS l FROM x GROUP BY pair_id, b) WHERE l IS NOT NULL GROUP BY pair_id)
   SELECT pair_id, round(loss_s, 6) AS loss_s, round(loss_r, 6) AS loss_r, round((loss_s + loss_r) / 2, 6) AS loss FROM f JOIN g USING (pair_id)"""))
def nce(spark, d):
    """EXT-15, EXT-16: every seventh source's anchor is ambiguous."""
    pos = V.anchors(spark, d).select("*", F.lit(1.0).alias("weight"), (F.col("s") % 7 == 0).alias("ambiguous"))
    out = M.info_nce(M.similarities(V.nodes(spark, d)), pos)
    return out.select("pair_id", *[rounded(c).alias(c) for c in ("loss_s", "loss_r", "loss")])


@query("join_ratio_test", V.sql("nodes", """WITH d AS (SELECT a.pair_id, a.node AS s, b.node AS r, round(list_distance(a.v, b.v), 9) AS d FROM nodes a JOIN nodes b USING (pair_id) WHERE a.side = 0 AND b.side = 1),
   w AS (SELECT *, row_number() OVER (PARTITION BY pair_id, s ORDER BY d, r) AS f, lead(d) OVER (PARTITION BY pair_id, s ORDER BY d, r) AS second, row_number() OVER (PARTITION BY pair_id, r ORDER BY d, s) AS g FROM d),
   m AS (SELECT *, round(CASE WHEN second IS NULL THEN 0 WHEN second > 0 THEN d / second ELSE 1 END, 9) AS score FROM w WHERE f = 1 AND g = 1)
   SELECT pair_id, s, r, round(d, 6) AS d, round(score, 6) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score, s, r) AS position FROM m WHERE score <= 0.97) WHERE position <= 700"""))
def ratio(spark, d):
    """JOI-14."""
    return M.ratio_test_matches(V.nodes(spark, d)).select("pair_id", "s", "r", rounded("d").alias("d"), rounded("score").alias("score"), F.col("position").cast("long").alias("position"))


@query("udf_sinkhorn_assignment")
def sinkhorn(spark, d):
    """FUN-02, CLU-25: Sinkhorn weights, then the best one-to-one assignment."""
    return M.optimal_assignment(M.sinkhorn(M.similarities(V.nodes(spark, d)))).withColumn("weight", rounded("weight"))
