"""Reference-shaped inputs, derived from the given tables.

Each view is a DataFrame here and a common table expression in :data:`SQL`, written independently, so
that a query and its SQL start from the same rows. Nothing is gathered on one task: row numbers are
by key, and ids come from the tables' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions.se3 import yaw_transform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object nodes of a pair of graphs: ``pair_id, side (0 source, 1 reference), node, v``. A pair has at most 500 nodes."""
    return table(spark, sf_dir, "embeddings").select(F.expr("label + 1000 * (vec_id div 500)").alias("pair_id"), (F.col("vec_id") % 2).cast("int").alias("side"), F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("v"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True matches ``pair_id, s, r``: i-th source with i-th reference node."""
    w = Window.partitionBy("pair_id", "side").orderBy("node")
    n = nodes(spark, sf_dir).select("pair_id", "side", "node", F.row_number().over(w).alias("i"))
    a, b = n.where("side = 0").select("pair_id", "i", F.col("node").alias("s")), n.where("side = 1").select("pair_id", "i", F.col("node").alias("r"))
    return a.join(b, ["pair_id", "i"]).select("pair_id", "s", "r")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation triples ``scan_id, sub, obj, name, pos``. Lines and orders meet over all shuffle partitions, and eight for each split of the
    lines at least: they are so few bytes that adaptive execution, or a fixed number, would leave millions of rows for one task to sort."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * li.rdd.getNumPartitions())
    li, o = li.where("l_orderkey IS NOT NULL").repartition(parts, "l_orderkey"), o.where("o_orderkey IS NOT NULL").repartition(parts, "o_orderkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.expr("l_orderkey div 2000").alias("scan_id"), F.col("l_suppkey").alias("sub"), (F.col("l_partkey") % 40).alias("obj"), F.concat_ws("/", "l_returnflag", "o_orderpriority").alias("name"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points ``scan_id, label, row_id, x, y, z``; label 0 is background."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 2000").alias("scan_id"), (F.col("l_suppkey") % 97).alias("label"), F.expr("(l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey").alias("row_id"),
        F.expr("(l_quantity * 0.05D + l_discount) / 1.0301007D").alias("x"), F.expr("(l_tax * 10D + (l_suppkey % 10) * 0.25D) / 1.0701013D").alias("y"), F.expr("l_extendedprice / 43051D").alias("z"),
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera poses ``sequence_id, ordinal, frame_id, timestamp_us, event_type, yaw, x, y``; a true pose
    (``true_yaw, true_x, true_y``) of most frames."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("ordinal", F.row_number().over(w) - 1)
    return e.select(
        F.col("user_id").alias("sequence_id"), "ordinal", F.col("event_id").alias("frame_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"), "event_type",
        F.expr("ordinal * 2.5D + value * 0.0100007D").alias("yaw"), F.expr("ordinal * 0.0500003D + value * 0.0010000711D").alias("x"), F.expr("(event_id % 11) * 0.0200001D").alias("y"),
        F.expr("CASE WHEN event_type <> 'error' THEN ordinal * 2.5D END").alias("true_yaw"), F.expr("CASE WHEN event_type <> 'error' THEN ordinal * 0.05D END").alias("true_x"), F.expr("CASE WHEN event_type <> 'error' THEN 0.1D END").alias("true_y"),
    )


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated direction records ``pair_id, direction, replicate (0..4), signature, yaw, x, y, transform,
    overlap, rmse, accepted, solver``: five a direction; further ones are those of further pairs."""
    w = Window.partitionBy("o_custkey", F.col("o_orderkey") % 2).orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("nth", F.row_number().over(w) - 1).withColumn("replicate", F.col("nth") % 5)
    o = o.select(
        F.expr("o_custkey + (nth div 5) * 4294967296").alias("pair_id"), F.expr("IF(o_orderkey % 2 = 0, 'forward', 'reverse')").alias("direction"), "replicate", F.col("o_orderkey").alias("signature"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 40D ELSE 0D END + (CAST(o_totalprice AS BIGINT) % 900) / 200D").alias("yaw"), F.expr("(CAST(o_totalprice AS BIGINT) % 500) / 2500D").alias("x"), F.expr("(o_orderkey % 13) / 200D").alias("y"),
        F.expr("0.2D + (CAST(o_totalprice AS BIGINT) % 61) / 100D").alias("overlap"), F.expr("0.02D + (o_orderkey % 17) / 200D").alias("rmse"), F.expr("o_orderstatus <> 'P' OR o_orderkey % 3 > 0").alias("accepted"), F.col("o_orderpriority").alias("solver"),
    )
    return o.withColumn("transform", yaw_transform("yaw", "x", "y"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment rows ``dataset, split, pair_id, arm, repeat, status, accepted, rre, rte, coverage, metric``.
    Failed rows have no metrics."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("dataset"), F.expr("IF(c_nationkey % 2 = 0, 'held_out', 'development')").alias("split"), F.col("o_custkey").alias("pair_id"), F.expr("IF(o_orderkey % 2 = 0, 'baseline', 'candidate')").alias("arm"), F.col("o_orderkey").alias("repeat"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed' ELSE 'failed' END").alias("status"), F.expr("o_orderstatus <> 'P' AND o_orderkey % 5 < 3").alias("accepted"),
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN (CAST(o_totalprice AS BIGINT) % 2400) / 100D END").alias("rre"), F.expr("CASE WHEN o_orderstatus <> 'P' THEN (CAST(o_totalprice AS BIGINT) % 700) / 1000D END").alias("rte"),
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 101) / 100D END").alias("coverage"), F.col("o_orderpriority").alias("combo"),
    )


#: The same views for DuckDB.
SQL = {
    "nodes": "SELECT label + 1000 * (vec_id // 500) AS pair_id, CAST(vec_id % 2 AS INT) AS side, vec_id AS node, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "anchors": "SELECT a.pair_id, a.node AS s, b.node AS r FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY node) AS i FROM nodes WHERE side = 0) a JOIN (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY node) AS i FROM nodes WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i",
    "relations": "SELECT l_orderkey // 2000 AS scan_id, l_suppkey AS sub, l_partkey % 40 AS obj, l_returnflag || '/' || o_orderpriority AS name, l_orderkey * 8 + l_linenumber AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "points": "SELECT l_orderkey // 2000 AS scan_id, l_suppkey % 97 AS label, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS row_id, (l_quantity * 0.05::DOUBLE + l_discount) / 1.0301007::DOUBLE AS x, (l_tax * 10::DOUBLE + (l_suppkey % 10) * 0.25::DOUBLE) / 1.0701013::DOUBLE AS y, l_extendedprice / 43051::DOUBLE AS z FROM lineitem",
    "poses": """SELECT user_id AS sequence_id, ordinal, event_id AS frame_id, epoch_us(ts) AS timestamp_us, event_type, ordinal * 2.5::DOUBLE + value * 0.0100007::DOUBLE AS yaw, ordinal * 0.0500003::DOUBLE + value * 0.0010000711::DOUBLE AS x, (event_id % 11) * 0.0200001::DOUBLE AS y,
      CASE WHEN event_type <> 'error' THEN ordinal * 2.5::DOUBLE END AS true_yaw, CASE WHEN event_type <> 'error' THEN ordinal * 0.05::DOUBLE END AS true_x, CASE WHEN event_type <> 'error' THEN 0.1::DOUBLE END AS true_y
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS ordinal FROM events)""",
    "workers": """SELECT o_custkey + (nth // 5) * 4294967296 AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'forward' ELSE 'reverse' END AS direction, CAST(nth % 5 AS INT) AS replicate, o_orderkey AS signature,
      CASE WHEN o_orderkey % 7 = 0 THEN 40 ELSE 0 END + (CAST(trunc(o_totalprice) AS BIGINT) % 900) / 200::DOUBLE AS yaw, (CAST(trunc(o_totalprice) AS BIGINT) % 500) / 2500::DOUBLE AS x, (o_orderkey % 13) / 200::DOUBLE AS y,
      0.2::DOUBLE + (CAST(trunc(o_totalprice) AS BIGINT) % 61) / 100::DOUBLE AS overlap, 0.02::DOUBLE + (o_orderkey % 17) / 200::DOUBLE AS rmse, o_orderstatus <> 'P' OR o_orderkey % 3 > 0 AS accepted, o_orderpriority AS solver
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS INT) AS nth FROM orders)""",
    "runs": """SELECT c_mktsegment AS dataset, CASE WHEN c_nationkey % 2 = 0 THEN 'held_out' ELSE 'development' END AS split, o_custkey AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS arm, o_orderkey AS repeat,
      CASE WHEN o_orderstatus IN ('F', 'O') THEN 'completed' ELSE 'failed' END AS status, o_orderstatus <> 'P' AND o_orderkey % 5 < 3 AS accepted, CASE WHEN o_orderstatus <> 'P' THEN (CAST(trunc(o_totalprice) AS BIGINT) % 2400) / 100::DOUBLE END AS rre,
      CASE WHEN o_orderstatus <> 'P' THEN (CAST(trunc(o_totalprice) AS BIGINT) % 700) / 1000::DOUBLE END AS rte, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 101) / 100::DOUBLE END AS coverage, o_orderpriority AS combo
      FROM orders JOIN customer ON o_custkey = c_custkey""",
}
#: Which views a view reads.
NEEDS = {"anchors": ["nodes"]}


def sql(names: str, body: str) -> str:
    """``body`` with the named views (and those they read) as common table expressions in front.

    A body may begin with further expressions of its own: "WITH a AS (...) SELECT ...".
    """
    order: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    rest = ", " + body[15 if recursive else 5 :] if body.upper().startswith("WITH ") else " " + body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + rest
