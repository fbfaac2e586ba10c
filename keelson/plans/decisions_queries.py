from pyspark.sql import functions as F

from keelson.functions import se3
from keelson.functions.vectors import rounded

from keelson.operators import decisions as D
from keelson.operators import matching as M
from keelson.operators import trajectories as T
from keelson.plans import views as V
from keelson.plans.consensus_queries import VERDICT, cliques
from keelson.plans.matching_queries import SIM
from keelson.plans.registry import query

CROSS = {"cross_deg": 5.0003, "cross_m": 0.25003}
BOUNDS = {"deg": 5.0003, "m": 0.10003}


def stage_sql(quorum, rival=99):
    """The verdicts of both directions and of their medoids together, over ``workers``: ``pair_id, usable, reasons``, the forward
    medoid's ``yaw, x, y``."""
    direction = VERDICT.format(rival=rival, deg=5.0003, m=0.10003, quorum=quorum).replace("SELECT pair_id, direction, CAST(size AS INT)", ", dv AS (SELECT pair_id, direction, CAST(size AS INT)", 1)
    return f"WITH {cliques(5.0003, 0.10003)}, {direction}), " + """
  d AS (SELECT dv.*, w.yaw, w.x, w.y FROM dv LEFT JOIN workers w ON w.pair_id = dv.pair_id AND w.direction = dv.direction AND w.replicate = dv.medoid), p AS (SELECT DISTINCT pair_id FROM workers),
  j AS (SELECT p.pair_id, coalesce(list_transform(f.reasons, lambda r: 'forward:' || r), ['forward:missing']) AS fr, coalesce(list_transform(g.reasons, lambda r: 'reverse:' || r), ['reverse:missing']) AS rr, coalesce(f.usable, false) AND coalesce(g.usable, false) AS both_, abs(f.yaw + g.yaw) AS rot, sqrt((f.x + cos(radians(f.yaw)) * g.x - sin(radians(f.yaw)) * g.y) ** 2 + (f.y + sin(radians(f.yaw)) * g.x + cos(radians(f.yaw)) * g.y) ** 2) AS shift, f.yaw AS yaw, f.x AS x, f.y AS y
        FROM p LEFT JOIN (SELECT * FROM d WHERE direction = 'forward') f USING (pair_id) LEFT JOIN (SELECT * FROM d WHERE direction = 'reverse') g USING (pair_id)),
  k AS (SELECT pair_id, list_concat(list_concat(fr, rr), CASE WHEN both_ THEN list_filter([CASE WHEN rot > 5.0003 THEN 'cross:rotation' END, CASE WHEN shift > 0.25003 THEN 'cross:translation' END], lambda r: r IS NOT NULL) ELSE [] END) AS reasons, yaw, x, y FROM j)
  SELECT pair_id, len(reasons) = 0 AS usable, reasons, yaw, x, y FROM k"""


@query("decide_stage_order", V.sql("workers", f"SELECT pair_id, usable, reasons FROM ({stage_sql(2)})"))
def stage(spark, d):
    """CLU-07, CLU-19, CLU-20."""
    return D.stage_order(V.workers(spark, d), ["pair_id"], **BOUNDS, quorum=2, **CROSS).select("pair_id", "usable", "reasons")


#: A pair once for each of its records, without that one.
LEFT_OUT = """SELECT w.* REPLACE (w.pair_id || ':' || o.direction || ':' || o.replicate AS pair_id), w.pair_id AS whole FROM base w JOIN base o ON w.pair_id = o.pair_id AND (w.direction <> o.direction OR w.replicate <> o.replicate)"""


@query("decide_jackknife_stability", V.sql("workers", f"""WITH base AS (SELECT * FROM workers), whole AS ({stage_sql(2)}), jack AS (WITH workers AS ({LEFT_OUT}) SELECT * FROM ({stage_sql(1)})),
  n AS (SELECT pair_id, count(*) AS scenarios FROM base GROUP BY pair_id),
  k AS (SELECT whole.pair_id, count(*) FILTER (WHERE jack.usable) AS usable_scenarios, count(*) FILTER (WHERE jack.usable AND whole.usable AND abs(jack.yaw - whole.yaw) <= 2.0003 AND sqrt((jack.x - whole.x) ** 2 + (jack.y - whole.y) ** 2) <= 0.05003) AS still
    FROM jack JOIN whole ON whole.pair_id = CAST(split_part(jack.pair_id, ':', 1) AS BIGINT) GROUP BY ALL)
  SELECT pair_id, scenarios, coalesce(usable_scenarios, 0) AS usable_scenarios, coalesce(still, 0) AS still, usable, usable AND usable_scenarios = scenarios AND still = scenarios AS stable FROM whole JOIN n USING (pair_id) LEFT JOIN k USING (pair_id)"""))
def stability(spark, d):
    """CLU-08, WIN-19."""
    return D.stability(V.workers(spark, d), ["pair_id"], **BOUNDS, quorum=2, drift_deg=2.0003, drift_m=0.05003, **CROSS)


@query("decide_policy_comparison", V.sql("workers", "SELECT policy, count(*) AS pairs, count(*) FILTER (WHERE usable) AS usable FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, usable FROM ({stage_sql(*a)})" for p, a in {"pairs": (2,), "triples": (3,), "no_rival": (2, 2)}.items()) + ") GROUP BY policy"))
def comparison(spark, d):
    """CLU-09: by policy, how many pairs are usable."""
    named = {"pairs": {"quorum": 2}, "triples": {"quorum": 3}, "no_rival": {"quorum": 2, "rival": 2}}
    x = D.policies(V.workers(spark, d), ["pair_id"], {k: v | BOUNDS | CROSS for k, v in named.items()})
    return x.groupBy("policy").agg(F.count("*").alias("pairs"), F.count_if("usable").alias("usable"))


@query("fun_interpolated_transform", V.sql("workers", "SELECT signature, round(yaw * 0.3, 4) + 0.0 AS yaw, round(x * 0.3, 6) + 0.0 AS x, round(y * 0.3, 6) + 0.0 AS y FROM workers"))
def interpolation(spark, d):
    """SE3-07."""
    one = F.array(*[F.lit(v) for v in se3.IDENTITY])
    w = V.workers(spark, d).withColumn("t", se3.interpolate(one, F.col("transform"), F.lit(0.3)))
    return w.select("signature", rounded(se3.euler_deg("t")[2], 4).alias("yaw"), rounded(se3.at("t", 0, 3)).alias("x"), rounded(se3.at("t", 1, 3)).alias("y"))


@query("agg_top1_node_f1", V.sql("nodes anchors", f"WITH {SIM}, p AS (SELECT pair_id, a AS s, b AS r FROM ranked WHERE rank = 1 AND pair_id % 4 > 0), h AS (SELECT pair_id, count(*) AS tp FROM p JOIN anchors USING (pair_id, s, r) GROUP BY pair_id), n AS (SELECT pair_id, count(*) AS n FROM p GROUP BY pair_id), k AS (SELECT pair_id, count(*) AS k FROM anchors GROUP BY pair_id) SELECT q.pair_id, round(CASE WHEN n IS NULL THEN 0 ELSE 2.0 * coalesce(tp, 0) / (n + k) END, 6) AS f1, n IS NULL AS failed FROM (SELECT DISTINCT pair_id FROM nodes) q LEFT JOIN n USING (pair_id) LEFT JOIN k USING (pair_id) LEFT JOIN h USING (pair_id)"))
def top1(spark, d):
    """CMP-13, CMP-14: every fourth pair has failed."""
    n = V.nodes(spark, d)
    return D.top1_f1(M.ranks(M.similarities(n.where("pair_id % 4 > 0"))), V.anchors(spark, d), n).withColumn("f1", rounded("f1"))


@query("validate_derived_decision", V.sql("runs", "WITH g AS (SELECT pair_id, count(*) FILTER (WHERE accepted) AS passes, count(*) FILTER (WHERE rre > 23) AS vetoes FROM runs GROUP BY pair_id), v AS (SELECT *, CASE WHEN passes = 4 AND vetoes = 0 THEN 'accepted' ELSE 'rejected' END AS derived, CASE WHEN pair_id % 9 = 0 THEN 'accepted' WHEN passes = 4 AND vetoes = 0 THEN 'accepted' ELSE 'rejected' END AS stored FROM g) SELECT *, derived = stored AS agrees FROM v"))
def derived(spark, d):
    """CMP-15, CMP-16: every ninth stored verdict says accepted."""
    o = V.runs(spark, d).select("pair_id", F.col("accepted").alias("passed"), F.coalesce(F.col("rre") > 23, F.lit(False)).alias("vetoed"))
    s = o.groupBy("pair_id").agg(F.count_if("passed").alias("p"), F.count_if("vetoed").alias("v")).select("pair_id", F.when((F.col("pair_id") % 9 == 0) | ((F.col("p") == 4) & (F.col("v") == 0)), "accepted").otherwise("rejected").alias("verdict"))
    return D.derived_decision(o, s, "pair_id", 4)


@query("select_fixed_ordinals", "SELECT ordinal, CASE WHEN n = 1 THEN o_custkey END AS o_custkey, coalesce(n, 0) = 1 AS found FROM (VALUES (0), (5), (11), (999999999)) v(o) JOIN (SELECT 1) ON true LEFT JOIN (SELECT o_orderkey AS k, count(*) AS n, min(o_custkey) AS o_custkey FROM orders GROUP BY o_orderkey) ON k = o CROSS JOIN (SELECT 0) z(zz)".replace("SELECT ordinal,", "SELECT CAST(o AS BIGINT) AS ordinal,"))
def ordinals(spark, d):
    """CMP-17; a fixed selection is the feature."""
    return D.by_ordinals(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), "o_custkey"), "o_custkey", [0, 5, 11, 999999999])


@query("agg_strict_bag", "SELECT o_custkey AS key, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS slot, count(*) AS n FROM orders GROUP BY ALL")
def bag(spark, d):
    """FUN-19."""
    o = V.table(spark, d, "orders")
    voc = o.select(F.col("o_orderpriority").alias("name")).distinct().withColumn("slot", F.substring("name", 1, 1).cast("int") - 1)
    return D.bag_strict(o.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name")), voc)


@query("agg_assignment_features")
def features(spark, d):
    """FUN-03: on Sinkhorn weights, with coefficients for the budget."""
    f = D.budget(D.assignment_features(M.sinkhorn(M.similarities(V.nodes(spark, d)))), {"mutual": 20.0, "best_sim": 10.0}, 2.0, 1, F.col("sources"))
    return f.select("pair_id", "sources", "references", *[rounded(c).alias(c) for c in ("best_sim", "mutual", "best_weight", "top_weight")], "budget")


@query("agg_meter_means", V.sql("runs", "SELECT dataset, round(avg(rre), 5) AS rre, round(avg(rte), 5) AS rte FROM runs GROUP BY dataset"))
def meters(spark, d):
    """CMP-30, AGG-30."""
    return D.meter_means(V.runs(spark, d), "dataset", ["rre", "rte"])


@query("udf_ordered_clusters")
def ordered(spark, d):
    """CLU-13, CLU-14: loop edges of a sequence that agree on their distance."""
    edge_id = F.shiftleft(F.col("source").cast("long"), 32).bitwiseOR(F.col("target").cast("long"))
    e = T.loop_pairs(T.anchors(V.poses(spark, d).withColumn("t", se3.yaw_transform("yaw", "x", "y")), 3), 12, 1.25)
    c = e.select("sequence_id", edge_id.alias("id"), "distance")
    a, b = c.select("sequence_id", F.col("id").alias("a"), F.col("distance").alias("da")), c.select("sequence_id", F.col("id").alias("b"), F.col("distance").alias("db"))
    near = a.join(b, "sequence_id").where("a < b AND abs(da - db) < 0.02").select("sequence_id", "a", "b")
    fresh = near.select(*[F.col(k).alias(k) for k in near.columns])
    other = T.loop_pairs(T.anchors(V.poses(spark, d).withColumn("t", se3.yaw_transform("yaw", "x", "y")), 3), 12, 1.25)
    return D.ordered_clusters(other.select("sequence_id", edge_id.alias("id")), fresh, "sequence_id", most=3)


@query("udf_hull_centres")
def hulls(spark, d):
    """EXT-11."""
    out = D.hull_centres(V.points(spark, d), ["scan_id", "label"])
    return out.select("scan_id", "label", "vertices", *[rounded(c).alias(c) for c in ("cx", "cy", "cz")])


@query("udf_face_samples")
def faces(spark, d):
    """EXT-22: a scan's triangles of three points that follow each other by id."""
    from pyspark.sql import Window

    w = Window.partitionBy("scan_id", "label").orderBy("row_id")
    p = V.points(spark, d).withColumn("n", F.row_number().over(w) - 1)
    t = p.groupBy("scan_id", "label", F.floor(F.col("n") / 3).alias("tri")).agg(*[F.max(F.when(F.col("n") % 3 == i, F.col(c))).alias(f"{v}{c}") for i, v in enumerate("abc") for c in "xyz"]).where("cx IS NOT NULL")
    out = D.face_samples(t.withColumn("key", F.col("scan_id") * 1000 + F.col("label")), "key", 20)
    return out.select("key", "place", *[rounded(c).alias(c) for c in "xyz"])



