"""Registered queries over the losses and the training of a multimodal embedding's fusion: four modules of sixteen values."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelson.functions.vectors import rounded
from keelson.operators import fusion_training as FT
from keelson.plans import views as V
from keelson.plans.registry import query
from keelson.sources.durable import shared_dir

WIDTHS, THETA = [16, 16, 16, 16], [0.3, 0.0, -0.2, 0.1]


def _anchors(spark, d):
    """Every seventh source node and its partner have no counterpart: they are the negatives."""
    return V.anchors(spark, d).where("s % 7 <> 0")


def _share(a, f, g):
    return f"1 / (1 + 1 / ({a} / ({f} + 1e-9) + 1e-9) + 1 / ({a} / ({g} + 1e-9) + 1e-9) + 1e-9)"


#: Unit vectors of the modules (0 to 3) and similarities of every two nodes with roles, joint as module 4; sums over negatives by end.
PARTS = f"""k AS (SELECT pair_id, s, r FROM anchors WHERE s % 7 <> 0),
  u AS (SELECT n.pair_id, side, node, coalesce(ks.s, kr.s) AS own, m, list_transform(v[16 * m + 1 : 16 * m + 16], lambda x: x / greatest(sqrt(list_inner_product(v[16 * m + 1 : 16 * m + 16], v[16 * m + 1 : 16 * m + 16])), 1e-12)) AS u
    FROM nodes n LEFT JOIN k ks ON side = 0 AND ks.pair_id = n.pair_id AND ks.s = node LEFT JOIN k kr ON side = 1 AND kr.pair_id = n.pair_id AND kr.r = node, range(4) t(m)),
  each AS (SELECT a.pair_id, a.side AS side_a, b.side AS side_b, a.own AS i, b.own AS j, a.node AS a, b.node AS b, a.m, list_inner_product(a.u, b.u) AS sim FROM u a JOIN u b ON a.pair_id = b.pair_id AND a.m = b.m WHERE a.own IS NOT NULL AND (b.own IS NULL OR a.side <> b.side)),
  sims AS (SELECT pair_id, side_a, side_b, i, j, a, b, m, sim FROM each UNION ALL
    SELECT pair_id, side_a, side_b, i, j, a, b, 4, sum(sim * ([exp(0.6), 1, exp(-0.4), exp(0.2)])[m + 1]) / (exp(0.6) + 1 + exp(-0.4) + exp(0.2)) FROM each GROUP BY ALL),
  z AS (SELECT pair_id, side_a, m, sum(exp(sim / 0.1)) FILTER (WHERE side_b = 0) AS c0, sum(exp(sim / 0.1)) FILTER (WHERE side_b = 1) AS c1, sum(exp(sim)) FILTER (WHERE side_b = 0) AS l0, sum(exp(sim)) FILTER (WHERE side_b = 1) AS l1 FROM sims WHERE j IS NULL GROUP BY ALL),
  q AS (SELECT s.pair_id, s.side_a, s.m, i, j, {_share("exp(sim / 0.1)", "CASE WHEN s.side_a = 0 THEN coalesce(c0, 0) ELSE coalesce(c1, 0) END", "CASE WHEN s.side_a = 0 THEN coalesce(c1, 0) ELSE coalesce(c0, 0) END")} AS qc,
    {_share("exp(sim)", "CASE WHEN s.side_a = 0 THEN coalesce(l0, 0) ELSE coalesce(l1, 0) END", "CASE WHEN s.side_a = 0 THEN coalesce(l1, 0) ELSE coalesce(l0, 0) END")} AS ql
    FROM sims s LEFT JOIN z USING (pair_id, side_a, m) WHERE j IS NOT NULL),
  f AS (SELECT pair_id, m, i, j, any_value(qc) FILTER (WHERE side_a = 0) AS ca, any_value(qc) FILTER (WHERE side_a = 1) AS cb, any_value(ql) FILTER (WHERE side_a = 0) AS la, any_value(ql) FILTER (WHERE side_a = 1) AS lb FROM q GROUP BY ALL)"""


@query("agg_embedding_losses", V.sql("nodes anchors", f"""WITH {PARTS} SELECT pair_id, CASE WHEN x.m = 4 THEN 'joint' ELSE 'module ' || x.m END AS part, CAST(sqrt(count(*)) AS BIGINT) AS n, round(avg(-ln((ca + cb) / 2)), 6) AS contrastive,
   round(CASE WHEN x.m < 4 THEN 0.05 * sum(exp(la) * (la - ln(ja)) + exp(lb) * (lb - ln(jb))) END, 6) AS alignment FROM f x JOIN (SELECT pair_id, i, j, la AS ja, lb AS jb FROM f WHERE m = 4) y USING (pair_id, i, j) GROUP BY pair_id, x.m"""))
def losses(spark, d):
    """EXT-17: contrastive losses of the modules and the joint embedding, alignment losses of the modules."""
    b = FT.Batches(V.nodes(spark, d), _anchors(spark, d), WIDTHS, F.lit(False))
    k = len(WIDTHS)
    parts = [F.struct(F.lit("joint").alias("part"), F.col("losses")[0].alias("contrastive"), F.lit(None).cast("double").alias("alignment"))]
    parts += [F.struct(F.lit(f"module {m}").alias("part"), F.col("losses")[1 + 2 * k + k * k + m].alias("contrastive"), F.col("losses")[1 + k + m].alias("alignment")) for m in range(k)]
    return FT.pair_losses(b, THETA).select("pair_id", "n", F.explode(F.array(*parts)).alias("x")).select("pair_id", "x.part", "n", rounded("x.contrastive").alias("contrastive"), rounded("x.alignment").alias("alignment"))


@query("train_fusion_weights")
def train(spark, d):
    """STR-05, EXT-17: five epochs, every fifth pair held out for validation; the snapshots with the best one."""
    b = FT.Batches(V.nodes(spark, d), _anchors(spark, d), WIDTHS, F.col("pair_id") % 5 == 0)
    out = FT.train_fusion(b, f"{shared_dir(spark)}/keelson/fusion-{uuid.uuid4().hex}", epochs=5)
    return out.select("epoch", "train_pairs", "valid_pairs", rounded("train_loss").alias("train_loss"), rounded("valid_loss").alias("valid_loss"), "best", F.transform("theta", lambda x: F.round(x, 6)).alias("theta"))


@query("agg_neighbourhood_losses", V.sql("nodes anchors", """WITH k AS (SELECT pair_id, s, r FROM anchors WHERE s % 7 <> 0),
  c AS (SELECT pair_id, side, node, m, CASE WHEN m = 4 THEN v ELSE v[16 * m + 1 : 16 * m + 16] END AS v FROM nodes, range(5) t(m)),
  x AS (SELECT a.pair_id, a.m, ka.s AS i, kb.s AS j, round(list_inner_product(a.v, b.v) / (greatest(sqrt(list_inner_product(a.v, a.v)), 1e-12) * greatest(sqrt(list_inner_product(b.v, b.v)), 1e-12)), 9) AS sim
    FROM c a JOIN k ka ON a.pair_id = ka.pair_id AND a.side = 0 AND a.node = ka.s JOIN c b ON b.pair_id = a.pair_id AND b.m = a.m AND b.side = 1 JOIN k kb ON b.pair_id = kb.pair_id AND b.node = kb.r),
  f AS (SELECT pair_id, m, i, ln(1 + coalesce(sum(exp(sim)) FILTER (WHERE i <> j), 0)) - ln(1 + greatest(max(sim) FILTER (WHERE i = j), 0)) AS l FROM x GROUP BY ALL),
  g AS (SELECT pair_id, m, j, ln(1 + coalesce(sum(exp(sim)) FILTER (WHERE i <> j), 0)) AS l FROM x GROUP BY ALL)
  SELECT pair_id, CAST(m AS INT) AS module, n, round(fl + gl, 6) AS loss FROM (SELECT pair_id, m, count(*) AS n, avg(l) AS fl FROM f GROUP BY ALL) JOIN (SELECT pair_id, m, avg(l) AS gl FROM g GROUP BY ALL) USING (pair_id, m)"""))
def neighbourhood(spark, d):
    """EXT-17, the neighbourhood form, by module and for the whole vector."""
    return FT.neighbourhood_losses(V.nodes(spark, d), _anchors(spark, d), WIDTHS).withColumn("loss", rounded("loss"))
