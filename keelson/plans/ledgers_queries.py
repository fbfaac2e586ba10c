from pyspark.sql import functions as F

from keelson.operators import ledgers as L
from keelson.plans import views as V
from keelson.plans.registry import query


def _orders(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"), "o_orderstatus", F.col("o_orderkey").alias("position"))


@query("join_ledger_merge", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 101 > 0 THEN o_orderkey END AS position, o_custkey AS value, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 53 > 0 THEN 'existing' WHEN o_orderstatus = 'O' THEN 'backfill' END AS origin, CASE WHEN o_orderkey % 101 = 0 THEN 'unexpected' WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_orderstatus = 'F' AND o_orderkey % 53 = 0 THEN 'in_both' END AS fault FROM orders WHERE o_orderkey % 101 > 0 OR o_orderstatus <> 'P'".replace("o_custkey AS value", "CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS value"))
def ledger(spark, d):
    """JOI-28."""
    o = _orders(spark, d)
    return L.merged_ledger(o.where("key % 101 > 0").select("key", "position"), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O' OR (o_orderstatus = 'F' AND key % 53 = 0)"), "key")


@query("join_hypothesis_bind", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 17 = 0 THEN 'not_exact' WHEN o_orderkey % 19 = 0 THEN 'not_prepared' WHEN o_orderkey % 23 = 0 THEN 'identity' END AS fault FROM orders WHERE o_orderkey % 17 > 0 OR o_orderkey % 19 > 0")
def hypotheses(spark, d):
    """JOI-29, JOI-30."""
    o = _orders(spark, d)
    return L.bound_hypotheses(o.where("key % 17 > 0"), o.where("key % 19 > 0").withColumn("value", F.col("value") + F.when(F.col("key") % 23 == 0, 1).otherwise(0)), ["key"], "value")


@query("join_worker_matrix", V.sql("workers", """WITH k AS (SELECT DISTINCT pair_id FROM workers), w AS (SELECT pair_id, d.direction, CAST(r.replicate AS INT) AS replicate FROM k CROSS JOIN (VALUES ('forward'), ('reverse')) d(direction) CROSS JOIN range(0, 4) r(replicate)), h AS (SELECT pair_id, direction, replicate, count(*) AS n FROM workers GROUP BY ALL)
   SELECT * FROM (SELECT coalesce(w.pair_id, h.pair_id) AS pair_id, coalesce(w.direction, h.direction) AS direction, coalesce(w.replicate, h.replicate) AS replicate, CASE WHEN w.pair_id IS NULL THEN 'extra' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS fault FROM w FULL JOIN h ON w.pair_id = h.pair_id AND w.direction = h.direction AND w.replicate = h.replicate) WHERE fault IS NOT NULL"""))
def matrix(spark, d):
    """JOI-36."""
    return L.matrix_faults(V.workers(spark, d), "pair_id", {"direction": ["forward", "reverse"], "replicate": list(range(4))})


@query("set_multiset_difference", "WITH a AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O') SELECT l_suppkey, l_linenumber, only_in, count(*) AS n FROM (SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL")
def multiset(spark, d):
    """JOI-32, SET-01."""
    li = V.table(spark, d, "lineitem")
    return L.multiset_difference(li.where("l_returnflag <> 'R'").select("l_suppkey", "l_linenumber"), li.where("l_linestatus = 'O'").select("l_suppkey", "l_linenumber")).groupBy("l_suppkey", "l_linenumber", "only_in").agg(F.count("*").alias("n"))


@query("guard_partition", "SELECT * FROM (SELECT o_orderkey AS key, list_sort(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'done' END, CASE WHEN o_orderstatus = 'O' OR o_orderkey % 29 = 0 THEN 'open' END], lambda x: x IS NOT NULL)) AS parts, CASE WHEN o_orderkey % 31 = 0 AND (o_orderstatus <> 'P' OR o_orderkey % 29 = 0) THEN 'not_requested' WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderstatus = 'P' AND o_orderkey % 29 > 0 THEN 'in_none' WHEN o_orderstatus = 'F' AND o_orderkey % 29 = 0 THEN 'in_several' END AS fault FROM orders) WHERE fault IS NOT NULL".replace("SELECT * FROM (SELECT o_orderkey", "SELECT key, CASE WHEN len(parts) > 0 THEN parts END AS parts, fault FROM (SELECT o_orderkey"))
def partition(spark, d):
    """CLU-23, CMP-02."""
    o = _orders(spark, d)
    return L.partition_faults(o.where("key % 31 > 0"), {"done": o.where("o_orderstatus = 'F'"), "open": o.where("o_orderstatus = 'O' OR key % 29 = 0")}, "key")


def _tree(spark, d):
    t = _orders(spark, d).select(F.col("key").alias("task"), F.col("key").alias("ordinal"), "o_orderstatus")
    return t, t.where("task > 0").select("task", F.floor((F.col("task") - 1) / 2).alias("parent"))


@query("plan_ready_tasks", "WITH done AS (SELECT o_orderkey AS task FROM orders WHERE o_orderstatus = 'F') SELECT task, task AS ordinal, task = min(task) OVER () AS first FROM (SELECT o_orderkey AS task FROM orders WHERE o_orderstatus <> 'F') t WHERE task = 0 OR (task - 1) // 2 IN (SELECT task FROM done)")
def ready(spark, d):
    """CLU-26, STR-04."""
    t, e = _tree(spark, d)
    return L.ready_tasks(t.select("task", "ordinal"), e, t.where("o_orderstatus = 'F'").select("task"))


@query("plan_task_levels", "WITH RECURSIVE l AS (SELECT CAST(0 AS BIGINT) AS task, 0 AS level UNION ALL SELECT o_orderkey, level + 1 FROM l JOIN orders ON o_orderkey > 0 AND (o_orderkey - 1) // 2 = l.task) SELECT task, level FROM l")
def depth(spark, d):
    """CLU-26."""
    t, e = _tree(spark, d)
    return L.levels(e, t.where("task = 0"))


@query("agg_stage_counts", "SELECT o_orderpriority AS stage, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 3000 WHEN '2-HIGH' THEN 3001 END AS expected, coalesce(count(*) = CASE o_orderpriority WHEN '1-URGENT' THEN 3000 WHEN '2-HIGH' THEN 3001 END, false) AS agrees FROM orders GROUP BY 1")
def stages(spark, d):
    """AGG-49."""
    return L.stage_counts(V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("stage")), {"1-URGENT": 3000, "2-HIGH": 3001})


@query("window_union_offsets", "SELECT l_linenumber AS scan_id, l_suppkey AS node, n, CAST(coalesce(sum(n) OVER (PARTITION BY l_linenumber ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM (SELECT l_linenumber, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)".replace("AS begin", 'AS "begin"'))
def offsets(spark, d):
    """AGG-48."""
    n = V.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("scan_id"), F.col("l_suppkey").alias("node")).agg(F.count("*").alias("n"))
    return L.offsets(n, "scan_id", "node", "n")


@query("fun_pair_key", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS source, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS reference FROM orders")
def keys(spark, d):
    """CMP-19, FUN-15: every third key has a second separator."""
    o = _orders(spark, d).select("key", F.concat_ws("_to_", F.col("key").cast("string"), F.col("value").cast("string"), F.when(F.col("key") % 3 == 0, F.lit("x"))).alias("pair"))
    return L.pair_key(o, "pair").select("key", "source", "reference")
