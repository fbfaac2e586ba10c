from pyspark.sql import functions as F

from keelson.functions import audit
from keelson.functions.vectors import rounded
from keelson.operators import labels as L
from keelson.operators import points as P
from keelson.plans import views as V
from keelson.plans.registry import query

STATS = """c AS (SELECT DISTINCT scan_id, label, floor(x / 0.4) AS i, floor(y / 0.4) AS j, floor(z / 0.4) AS k FROM points), n AS (SELECT scan_id, label, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT a.scan_id AS pair_id, a.label AS a, b.label AS b, count(*) AS common FROM c a JOIN c b ON b.scan_id = a.scan_id + 1 AND a.i = b.i AND a.j = b.j AND a.k = b.k GROUP BY ALL),
  s AS (SELECT pair_id, a, b, common, common / x.n AS cover_a, common / y.n AS cover_b, least(x.n, y.n) / greatest(x.n, y.n) AS size_ratio FROM m JOIN n x ON x.scan_id = pair_id AND x.label = a JOIN n y ON y.scan_id = pair_id + 1 AND y.label = b),
  l AS (SELECT *, CASE WHEN least(cover_a, cover_b) >= 0.3003 AND size_ratio >= 0.5 THEN 'positive' WHEN least(cover_a, cover_b) < 0.1003 THEN 'negative' ELSE 'ambiguous' END AS label FROM s), h AS (SELECT *, label = 'negative' AND greatest(cover_a, cover_b) >= 0.3003 AS hard FROM l)"""


def _labelled(spark, d):
    return L.classified(L.pair_statistics(V.points(spark, d), 0.4), 0.3003, 0.1003)


@query("join_object_pair_statistics", V.sql("points", f"WITH {STATS} SELECT pair_id, a, b, common, round(cover_a, 6) AS cover_a, round(cover_b, 6) AS cover_b, round(size_ratio, 6) AS size_ratio, label, hard FROM h"))
def statistics(spark, d):
    """JOI-34, JOI-35, FUN-08."""
    return _labelled(spark, d).select("pair_id", "a", "b", "common", *[rounded(c).alias(c) for c in ("cover_a", "cover_b", "size_ratio")], "label", "hard")


@query("agg_label_audit", V.sql("points", f"WITH {STATS}, w AS (SELECT *, count(*) FILTER (WHERE label = 'positive') OVER (PARTITION BY pair_id, a) AS of_a, count(*) FILTER (WHERE label = 'positive') OVER (PARTITION BY pair_id, b) AS of_b FROM h) SELECT pair_id, count(*) FILTER (WHERE label = 'positive') AS positive, count(*) FILTER (WHERE label = 'negative') AS negative, count(*) FILTER (WHERE label = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE hard) AS hard, count(*) FILTER (WHERE label = 'positive' AND of_a = 1 AND of_b = 1) AS one_to_one, count(DISTINCT a) FILTER (WHERE label = 'positive' AND of_a > 1) AS split, count(DISTINCT b) FILTER (WHERE label = 'positive' AND of_b > 1) AS merged FROM w GROUP BY pair_id"))
def audited(spark, d):
    """AGG-23."""
    return L.pair_audit(V.points(spark, d), 0.4, 0.3003, 0.1003)


@query("agg_detection_scores", V.sql("runs", "WITH c AS (SELECT dataset, count(*) FILTER (WHERE coverage >= 0.4003 AND rre <= 8) AS tp, count(*) FILTER (WHERE coverage >= 0.4003 AND NOT rre <= 8) AS fp, count(*) FILTER (WHERE NOT coverage >= 0.4003 AND rre <= 8) AS fn FROM runs WHERE coverage IS NOT NULL GROUP BY dataset), p AS (SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM c) SELECT *, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM p"))
def detection(spark, d):
    """AGG-29, AGG-30."""
    r = V.runs(spark, d).where("coverage IS NOT NULL")
    return L.detection(r, "dataset", F.col("coverage"), F.col("rre") <= 8, 0.4003).withColumn("f1", rounded("f1"))


@query("fun_rule_margins", V.sql("workers", "SELECT signature, 'overlap' AS measure, round(overlap / 0.25 - 1, 6) + 0.0 AS margin FROM workers UNION ALL SELECT signature, 'rmse', round(1 - rmse / 0.08, 6) + 0.0 FROM workers"))
def margins(spark, d):
    """AGG-41."""
    return L.margins(V.workers(spark, d), "signature", {"overlap": (0.25, True), "rmse": (0.08, False)}).withColumn("margin", rounded("margin"))


@query("fun_geometry_kernel", V.sql("points", """WITH v AS (SELECT scan_id AS key, label AS node, unnest([0, 1, 2, 3]) AS pos, unnest([avg(x), avg(y), avg(z), sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2)]) AS x FROM points GROUP BY scan_id, label),
  z AS (SELECT key, node, pos, CASE WHEN stddev_pop(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS z FROM v WINDOW w AS (PARTITION BY key, pos)) SELECT a.key, a.node AS a, b.node AS b, round(exp(-sum((a.z - b.z) ** 2) / 4 / 2), 6) AS similarity FROM z a JOIN z b ON a.key = b.key AND a.pos = b.pos AND a.node < b.node GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY a.key, a.node, b.node")))
def kernel(spark, d):
    """FUN-04."""
    o = P.object_statistics(V.points(spark, d)).select(F.col("scan_id").alias("key"), F.col("label").alias("node"), F.array("cx", "cy", "cz", "extent").alias("v"))
    return L.kernel(o).withColumn("similarity", rounded("similarity"))


@query("decide_geometry_gate", V.sql("runs", "WITH s AS (SELECT pair_id, sum(rre) FILTER (WHERE arm = 'baseline') AS bp, sum(rre) FILTER (WHERE arm = 'candidate') AS cp, max(rte) FILTER (WHERE arm = 'baseline') AS be, max(rte) FILTER (WHERE arm = 'candidate') AS ce, avg(coverage) FILTER (WHERE arm = 'baseline') AS bc, avg(coverage) FILTER (WHERE arm = 'candidate') AS cc FROM runs GROUP BY pair_id), r AS (SELECT pair_id, round(cp / greatest(bp, 1e-12::DOUBLE), 9) AS p, round(ce / greatest(be, 1e-12::DOUBLE), 9) AS e, round(cc / greatest(bc, 1e-12::DOUBLE), 9) AS c FROM s WHERE bp IS NOT NULL AND be IS NOT NULL AND bc IS NOT NULL) SELECT pair_id, coalesce(p >= 0.85 AND e >= 0.8 AND c <= 1.05, false) AS safe, coalesce(p >= 0.85 AND e >= 0.8 AND c <= 1.05, false) AND c <= 0.9 AS improved FROM r"))
def gate(spark, d):
    """FUN-10."""
    r = V.runs(spark, d)
    arm = lambda a, c: F.when(F.col("arm") == a, F.col(c))
    s = r.groupBy("pair_id").agg(*[f(arm(a, c)).alias(f"{n}_{k}") for a, n in (("baseline", "base"), ("candidate", "cand")) for f, c, k in ((F.sum, "rre", "points"), (F.max, "rte", "extent"), (F.avg, "coverage", "conflict"))])
    return L.geometry_gate(s.where("base_points IS NOT NULL AND base_extent IS NOT NULL AND base_conflict IS NOT NULL")).select("pair_id", "safe", "improved")


@query("window_hash_permutation", "SELECT l_linenumber AS grp, l_suppkey AS item, row_number() OVER (PARTITION BY l_linenumber ORDER BY md5('run:' || l_linenumber || ':' || l_suppkey), l_suppkey) - 1 AS place FROM (SELECT DISTINCT l_linenumber, l_suppkey FROM lineitem)")
def permutation(spark, d):
    """FUN-14."""
    x = V.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("grp"), F.col("l_suppkey").alias("item")).distinct()
    return L.hash_order(x, "grp", "item", "run").withColumn("place", F.col("place").cast("long"))


@query("sample_with_replacement", "WITH p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('s:' || grp || ':' || item), item) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT o_custkey AS grp, o_orderkey AS item FROM orders)) SELECT grp, item, place + t * n AS place FROM p, range(0, 10) r(t) WHERE place + t * n < 10")
def resample(spark, d):
    """CMP-28; a sample is the feature."""
    x = V.table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("item"))
    return L.resampled(x, "grp", "item", 10, "s").withColumn("place", F.col("place").cast("long"))


@query("join_prefix_children", "SELECT CAST(o_custkey AS VARCHAR) AS scan, list(o_custkey || '_' || o_orderkey ORDER BY o_custkey || '_' || o_orderkey) AS children FROM orders GROUP BY o_custkey")
def children(spark, d):
    """JOI-19."""
    return L.prefix_children(V.table(spark, d, "orders").select(F.concat_ws("_", "o_custkey", "o_orderkey").alias("id")))


#: Labels go from sets to items and back until they stay; 60 rounds are more than the graph needs.
MERGED = """WITH RECURSIVE m AS MATERIALIZED (SELECT DISTINCT o_custkey AS set_id, o_orderkey // 7 AS item FROM orders),
   l AS (SELECT 0 AS round, set_id, set_id AS grp FROM (SELECT DISTINCT set_id FROM m) UNION ALL
     SELECT r, set_id, grp FROM (SELECT any_value(round) + 1 AS r, m.set_id, min(low) AS grp, min(any_value(old)) OVER () AS first FROM (SELECT round, m.item, min(grp) OVER (PARTITION BY m.item) AS low, m.set_id AS of_set, grp AS old FROM l JOIN m USING (set_id) WHERE round < 60) x JOIN m ON m.item = x.item AND m.set_id = x.of_set GROUP BY m.set_id))
   SELECT set_id, grp FROM l WHERE round = 60"""


@query("cluster_merged_sets", MERGED)
def merged(spark, d):
    """SET-06."""
    o = V.table(spark, d, "orders")
    return L.merged_sets(o.select(F.col("o_custkey").alias("set_id"), F.floor(F.col("o_orderkey") / 7).alias("item")))


@query("validate_paths", "SELECT o_orderkey, o_orderkey % 5 > 0 AND o_orderpriority <> '1-URGENT' AS allowed FROM orders")
def paths(spark, d):
    """VAL-02."""
    o = V.table(spark, d, "orders").withColumn("path", F.concat(F.when(F.col("o_orderkey") % 5 == 0, "/other/").otherwise("/root/"), F.lower("o_orderpriority"), F.lit("/"), F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", audit.path_allowed(F.col("path"), "/root", ["1-URGENT"]).alias("allowed"))


#: Events' properties, every second one with a forbidden key, as many as ten containers deep in arrays and objects.
NESTED = """n AS (SELECT event_id, concat('{"id": ', event_id, ', "n": ', repeat('[{"inner": ', CAST(event_id % 6 AS INT)), CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN replace(props, '"k"', '"Transform"') ELSE props END, repeat('}]', CAST(event_id % 6 AS INT)), '}') AS text FROM events)"""


@query("validate_json_keys", f"""WITH {NESTED}, t AS (SELECT event_id, j.fullkey AS path FROM n, json_tree(n.text) j WHERE typeof(j.key) = 'VARCHAR' AND (lower(j.key) IN ('transform', 'pose') OR lower(j.key) LIKE 'gt%')),
   p AS (SELECT event_id, list_sort(list(DISTINCT replace(path, '"', ''))) AS paths FROM t GROUP BY event_id) SELECT n.event_id, paths IS NOT NULL AS banned, coalesce(paths, CAST([] AS VARCHAR[])) AS paths FROM n LEFT JOIN p USING (event_id)""")
def json_keys(spark, d):
    """VAL-06, VAL-07, VAL-08: every second row's key is renamed, and all are nested."""
    e = V.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    e = e.withColumn("props", F.when(F.col("k") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"Transform"'))).otherwise(F.col("props")))
    deep = (F.col("event_id") % 6).cast("int")
    e = e.select("event_id", F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "n": '), F.repeat(F.lit('[{"inner": '), deep), "props", F.repeat(F.lit("}]"), deep), F.lit("}")).alias("text"))
    return audit.forbidden_keys(e, "event_id", "text", ["transform", "pose"]).withColumnRenamed("key", "event_id")
