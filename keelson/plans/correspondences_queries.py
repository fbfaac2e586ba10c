from pyspark.sql import functions as F

from keelson.functions.se3 import yaw_transform
from keelson.functions.vectors import rounded
from keelson.operators import correspondences as C
from keelson.operators import points as P
from keelson.plans import views as V
from keelson.plans.registry import query

#: Correspondences from line items: parts of some orders are a pair, a supplier a node pair.
CORR = """corr AS (SELECT l_partkey % 50 + 50 * (l_orderkey // 1500) AS pair_id, l_suppkey % 5 AS node_pair, l_orderkey * 1000 + l_suppkey AS idx, l_quantity * 0.07::DOUBLE AS sx, l_discount * 9::DOUBLE AS sy, l_extendedprice / 31000::DOUBLE AS sz,
  l_quantity * 0.07::DOUBLE + 0.3::DOUBLE + (l_orderkey % 5) * 0.013::DOUBLE AS rx, l_discount * 9::DOUBLE - (l_orderkey % 7) * 0.011::DOUBLE AS ry, l_extendedprice / 31000::DOUBLE + 0.1::DOUBLE AS rz, l_tax + (l_orderkey % 97) / 97::DOUBLE AS score FROM lineitem)"""
TOP = "top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, idx) AS rank FROM corr) WHERE rank <= 1000)"


def corr(spark, d):
    return V.table(spark, d, "lineitem").select(
        F.expr("l_partkey % 50 + 50 * (l_orderkey div 1500)").alias("pair_id"), F.expr("l_suppkey % 5").alias("node_pair"), F.expr("l_orderkey * 1000 + l_suppkey").alias("idx"), F.expr("l_quantity * 0.07D").alias("sx"), F.expr("l_discount * 9D").alias("sy"), F.expr("l_extendedprice / 31000D").alias("sz"),
        F.expr("l_quantity * 0.07D + 0.3D + (l_orderkey % 5) * 0.013D").alias("rx"), F.expr("l_discount * 9D - (l_orderkey % 7) * 0.011D").alias("ry"), F.expr("l_extendedprice / 31000D + 0.1D").alias("rz"), F.expr("l_tax + (l_orderkey % 97) / 97D").alias("score"),
    )


@query("scan_best_correspondences", f"WITH {CORR}, {TOP}, n AS (SELECT pair_id, count(*) < 40 AS too_few FROM corr GROUP BY pair_id) SELECT pair_id, idx, rank, too_few FROM top JOIN n USING (pair_id)")
def best(spark, d):
    """SRC-14."""
    return C.best_correspondences(corr(spark, d)).select("pair_id", "idx", F.col("rank").cast("long").alias("rank"), "too_few")


@query("window_node_pair_cap", f"WITH {CORR}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, node_pair ORDER BY score DESC, idx) AS rank FROM corr), n AS (SELECT pair_id, count(DISTINCT node_pair) AS n FROM corr GROUP BY pair_id) SELECT pair_id, node_pair, idx, rank FROM r JOIN n USING (pair_id) WHERE rank <= greatest(1000 // n, 1)")
def cap(spark, d):
    """WIN-03, WIN-16."""
    return C.cap_per_node_pair(corr(spark, d).select("pair_id", "node_pair", "idx", "score")).select("pair_id", "node_pair", "idx", F.col("rank").cast("long").alias("rank"))


@query("window_prior_rescoring", f"""WITH {CORR}, p AS (SELECT pair_id, node_pair, avg(sx) AS prior FROM corr GROUP BY ALL), z AS (SELECT pair_id, node_pair, (prior - avg(prior) OVER w) / CASE WHEN stddev_pop(prior) OVER w < 1e-8 THEN 1 ELSE stddev_pop(prior) OVER w END AS z FROM p WINDOW w AS (PARTITION BY pair_id)),
   s AS (SELECT c.pair_id, c.node_pair, idx, CASE WHEN max(score) OVER v > 0 THEN score / max(score) OVER v ELSE 0 END * exp(z) AS weight FROM corr c JOIN z USING (pair_id, node_pair) WINDOW v AS (PARTITION BY c.pair_id, c.node_pair))
   SELECT * FROM (SELECT pair_id, node_pair, idx, round(weight, 6) AS weight, row_number() OVER (PARTITION BY pair_id ORDER BY round(weight, 9) DESC, node_pair, idx) AS rank FROM s) WHERE rank <= 1000""")
def rescoring(spark, d):
    """WIN-04, WIN-05."""
    c = corr(spark, d)
    prior = c.groupBy("pair_id", "node_pair").agg(F.avg("sx").alias("prior"))
    return C.global_top(C.rescored(c, prior)).select("pair_id", "node_pair", "idx", rounded("weight").alias("weight"), F.col("rank").cast("long").alias("rank"))


LENGTHS = "sqrt((a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2 + (a.sz - b.sz) ** 2) AS ds, sqrt((a.rx - b.rx) ** 2 + (a.ry - b.ry) ** 2 + (a.rz - b.rz) ** 2) AS dr"


@query("join_compatibility_graph", f"WITH {CORR}, {TOP}, x AS MATERIALIZED (SELECT a.pair_id, a.idx AS a, b.idx AS b, {LENGTHS} FROM top a JOIN top b ON a.pair_id = b.pair_id AND a.idx < b.idx), e AS (SELECT * FROM x WHERE abs(ds - dr) <= 0.0203 AND least(ds, dr) >= 0.5) SELECT pair_id, idx, count(*) AS degree, round(max(ds), 6) AS longest FROM (SELECT pair_id, a AS idx, ds FROM e UNION ALL SELECT pair_id, b, ds FROM e) GROUP BY ALL")
def graph(spark, d):
    """JOI-09: the graph's degrees, and the longest edge of each correspondence."""
    x = C.compatible_pairs(C.best_correspondences(corr(spark, d)), 0.0203, 0.5)
    ends = x.select("pair_id", F.explode(F.array("a", "b")).alias("idx"), "ds")
    return ends.groupBy("pair_id", "idx").agg(F.count("*").alias("degree"), F.max("ds").alias("longest")).withColumn("longest", rounded("longest"))


@query("join_relative_compatibility", f"WITH {CORR}, {TOP}, x AS MATERIALIZED (SELECT a.pair_id, a.idx AS a, b.idx AS b, {LENGTHS} FROM top a JOIN top b ON a.pair_id = b.pair_id AND a.idx < b.idx) SELECT pair_id, count(*) AS edges, count(DISTINCT a) AS left_nodes FROM x WHERE abs(ds - dr) <= greatest(0.0203, 0.0173 * greatest(ds, dr)) AND least(ds, dr) >= 0.02 GROUP BY pair_id")
def relative(spark, d):
    """JOI-10."""
    x = C.compatible_pairs(C.best_correspondences(corr(spark, d)), 0.0203, 0.02, 0.0173)
    return x.groupBy("pair_id").agg(F.count("*").alias("edges"), F.count_distinct("a").alias("left_nodes"))


@query("join_region_compatibility", V.sql("points", """WITH n AS (SELECT label + 1000 * scan_id AS node, scan_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY label, scan_id), k AS (SELECT a.node AS a, b.node AS b, row_number() OVER (PARTITION BY a.node ORDER BY round((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2, 9), b.node) AS k FROM n a JOIN n b ON a.scan_id = b.scan_id AND a.node <> b.node),
   e AS (SELECT DISTINCT least(a, b) AS low, greatest(a, b) AS high FROM k WHERE k <= 4), c AS (SELECT a.scan_id AS pair_id, a.node AS s, b.node AS r, a.cx AS sx, a.cy AS sy, a.cz AS sz, b.cx AS rx, b.cy AS ry, b.cz AS rz FROM n a JOIN n b ON b.node = a.node + 1000 + CASE WHEN a.node % 3 = 0 THEN 1 ELSE 0 END),
   x AS (SELECT a.pair_id, a.s AS s1, a.r AS r1, b.s AS s2, b.r AS r2, """ + LENGTHS + """ FROM c a JOIN c b ON a.pair_id = b.pair_id AND a.s < b.s AND a.r <> b.r)
   SELECT pair_id, s1, r1, s2, r2 FROM x JOIN e f ON f.low = least(s1, s2) AND f.high = greatest(s1, s2) JOIN e g ON g.low = least(r1, r2) AND g.high = greatest(r1, r2) WHERE abs(ds - dr) <= greatest(0.1, 0.2 * greatest(ds, dr))"""))
def region(spark, d):
    """JOI-11, JOI-12: objects of one scan against those of the next."""
    o = P.object_statistics(V.points(spark, d)).withColumn("node", F.col("label") + 1000 * F.col("scan_id"))
    edges = P.nearest_objects(o.select("scan_id", F.col("node").alias("label"), "cx", "cy", "cz"))
    cand = o.select(F.col("scan_id").alias("pair_id"), F.col("node").alias("s"), (F.col("node") + 1000 + F.when(F.col("node") % 3 == 0, 1).otherwise(0)).alias("r"))
    return C.region_compatible(cand, o.select("node", "cx", "cy", "cz"), edges)


@query("agg_residual_statistics", f"""WITH {CORR}, x AS (SELECT pair_id, sqrt((cos(radians(2.0)) * sx - sin(radians(2.0)) * sy + 0.3 - rx) ** 2 + (sin(radians(2.0)) * sx + cos(radians(2.0)) * sy - 0.05 - ry) ** 2 + (sz - rz) ** 2) AS res FROM corr)
   SELECT pair_id, count(*) AS n, round(median(res), 6) AS median, round(avg(res), 6) AS mean, round(quantile_cont(res, 0.9), 6) AS p90, round(sqrt(avg(res * res)), 6) AS rmse, count(*) FILTER (WHERE res < 0.15) AS inliers, round(avg(CASE WHEN res < 0.15 THEN 1.0 ELSE 0.0 END), 6) AS inlier_ratio FROM x GROUP BY pair_id""")
def residual(spark, d):
    """AGG-39, AGG-46, SE3-05."""
    c = corr(spark, d).withColumn("transform", yaw_transform(F.lit(2.0), F.lit(0.3), F.lit(-0.05)))
    out = C.residuals(c, inlier=0.15)
    return out.select("pair_id", "n", "inliers", *[rounded(x).alias(x) for x in ("median", "mean", "p90", "rmse", "inlier_ratio")])


@query("compare_array_fields", "SELECT a.vec_id AS vec_id, true AS same_shape, round(list_max(list_transform(range(1, 65), lambda i: abs(CAST(a.embedding AS DOUBLE[])[i] - CAST(b.embedding AS DOUBLE[])[i]))), 6) AS largest, CAST(list_min(list_filter(range(1, 65), lambda i: abs(CAST(a.embedding AS DOUBLE[])[i] - CAST(b.embedding AS DOUBLE[])[i]) > 0.3)) - 1 AS INT) AS first_beyond FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 2")
def fields(spark, d):
    """CMP-06: every vector against its even neighbour."""
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    even = e.where("vec_id % 2 = 0")
    right = even.union(even.select(F.col("vec_id") + 1, "v"))
    return C.array_difference(e, right.join(e.select("vec_id"), "vec_id", "left_semi"), "vec_id", "v", 0.3).withColumn("largest", rounded("largest"))


@query("agg_array_statistics", "WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) SELECT label, count(*) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, round(sum(abs(v)), 4) AS l1, round(sqrt(sum(v * v)), 4) AS l2, count(*) FILTER (WHERE v = 0) AS zeros, count(*) FILTER (WHERE abs(v) > 0 AND abs(v) < 1.17549435e-38) AS subnormal, count(*) FILTER (WHERE isnan(v)) AS nans, count(*) FILTER (WHERE isinf(v)) AS infs FROM x GROUP BY label")
def statistics(spark, d):
    """CMP-07."""
    out = C.array_statistics(V.table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), "label", "v")
    return out.select("label", "n", "zeros", "subnormal", "nans", "infs", *[rounded(c).alias(c) for c in ("least", "most", "mean", "std")], rounded("l1", 4).alias("l1"), rounded("l2", 4).alias("l2"))


@query("window_largest_remainder", "WITH l AS (SELECT l_linenumber AS pair_id, l_suppkey AS item, count(*) AS length FROM lineitem GROUP BY ALL), x AS (SELECT *, length * 1000 / sum(length) OVER (PARTITION BY pair_id) AS exact FROM l), q AS (SELECT *, greatest(floor(exact), 1) AS quota, row_number() OVER (PARTITION BY pair_id ORDER BY round(exact - floor(exact), 9) DESC, item) AS rank FROM x) SELECT pair_id, item, length, CAST(quota + CASE WHEN rank <= 1000 - sum(quota) OVER (PARTITION BY pair_id) THEN 1 ELSE 0 END AS BIGINT) AS target FROM q")
def remainder(spark, d):
    """WIN-17."""
    n = V.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("pair_id"), F.col("l_suppkey").alias("item")).agg(F.count("*").alias("length"))
    return C.largest_remainder(n, 1000).withColumn("target", F.col("target").cast("long"))
