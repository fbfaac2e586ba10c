"""Files that are written from the given tables and read back by the sources, and hashes of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelson.functions import se3
from keelson.functions.vectors import rounded
from keelson.operators import decisions as D
from keelson.operators import ledgers as L
from keelson.plans import views as V
from keelson.plans.registry import query
from keelson.sources import frames, scene
from keelson.sources.durable import shared_dir


def _text(df, what: str) -> str:
    """Writes the one string column as lines of text files in the shared folder; where they are."""
    path = f"{shared_dir(df.sparkSession)}/keelson/{what}-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


@query("scan_first_root", "SELECT o_custkey AS record, arg_min(o_orderpriority, o_orderkey) AS root, arg_min(o_orderstatus, o_orderkey) AS body FROM orders GROUP BY o_custkey")
def first_root(spark, d):
    """SRC-04: of a record found under several roots, the one of the first root."""
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("priority"), F.col("o_orderpriority").alias("root"), F.col("o_orderstatus").alias("body"))
    return scene.first_root(o, "record", "priority").drop("priority")


@query("scan_vocabulary", "SELECT p_type AS name, row_number() OVER (ORDER BY p_type) - 1 AS slot FROM (SELECT DISTINCT p_type FROM part)")
def vocabulary(spark, d):
    """SRC-16, SRC-20: a word list's lines in their order; the words of a vocabulary are few."""
    names = V.table(spark, d, "part").select("p_type").distinct().orderBy("p_type").coalesce(1)
    return scene.read_vocabulary(spark, _text(names, "vocabulary")).select("name", F.col("slot").cast("long").alias("slot"))


@query("scan_label_map", "SELECT p_partkey AS id, p_brand AS label FROM part WHERE p_partkey % 7 > 0")
def label_map(spark, d):
    """SRC-17: every seventh key isn't a number."""
    p = V.table(spark, d, "part").select(F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("n/a "), "p_partkey")).otherwise(F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").alias("size"), F.col("p_brand").alias("label"))
    path = f"{shared_dir(spark)}/keelson/labels-{uuid.uuid4().hex}"
    p.write.option("header", "true").csv(path)
    return scene.read_label_map(spark, path, "id", "label")


_POSE = "round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(cos(radians(yaw)), 5) + 0.0 AS c, round(sin(radians(yaw)), 5) + 0.0 AS s"


def _placed(t):
    return t.select("frame_id", "timestamp_us", *[(rounded(se3.at("t", i, k), 5) + F.lit(0.0)).alias(n) for n, i, k in (("x", 0, 3), ("y", 1, 3), ("c", 0, 0), ("s", 1, 0))])


@query("scan_trajectory", V.sql("poses", f"SELECT frame_id, timestamp_us, {_POSE} FROM poses"))
def trajectory(spark, d):
    """SRC-10."""
    t = V.poses(spark, d).select("frame_id", "timestamp_us", se3.yaw_transform("yaw", "x", "y").alias("t"))
    return _placed(frames.read_trajectory(spark, _text(t.select(F.to_json(F.struct("frame_id", "timestamp_us", "t"))), "trajectory")))


@query("scan_legacy_trajectory", V.sql("poses", f"SELECT frame_id, timestamp_us, {_POSE} FROM poses WHERE event_type <> 'error'"))
def legacy(spark, d):
    """SRC-11: world to camera in millimetres, read as camera to world in metres; frames of failed events aren't allowed."""
    p = V.poses(spark, d)
    back = se3.inverse("t")
    line = F.concat_ws(" ", F.col("frame_id").cast("string"), F.col("timestamp_us").cast("string"), F.transform(back, lambda v, i: F.when(i.isin(3, 7, 11), v * 1000).otherwise(v).cast("string")))
    path = _text(p.select("frame_id", "timestamp_us", se3.yaw_transform("yaw", "x", "y").alias("t")).select(line), "legacy")
    return _placed(frames.read_legacy_trajectory(spark, path, p.where("event_type <> 'error'").select("frame_id")))


@query("scan_headers", "SELECT 's' || s_suppkey AS key, s_name || ' = ' || s_nationkey AS value FROM supplier")
def headers(spark, d):
    """SRC-07, SRC-18: lines of keys and values, with others between them."""
    s = V.table(spark, d, "supplier")
    lines = s.select(F.explode(F.array(F.concat(F.lit("s"), "s_suppkey", F.lit(" = "), "s_name", F.lit(" = "), "s_nationkey"), F.concat(F.lit("# "), "s_name"))))
    return frames.key_values(spark, _text(lines, "headers")).select("key", "value")


@query("scan_mesh", "SELECT 'v' AS kind, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_tax::DOUBLE AS c FROM lineitem UNION ALL SELECT 'f', l_orderkey, l_orderkey + 1, l_linenumber FROM lineitem")
def mesh(spark, d):
    """SRC-19: a vertex and a face for each line item; faces name textures as well."""
    li = V.table(spark, d, "lineitem")
    v = F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("double").cast("string") for c in ("l_quantity", "l_discount", "l_tax")])
    f = F.concat(F.lit("f "), "l_orderkey", F.lit("/1/2 "), F.col("l_orderkey") + 1, F.lit("//3  "), "l_linenumber")
    vertices, faces = scene.read_obj(spark, _text(li.select(F.explode(F.array(v, F.lit("# note"), f))), "mesh"))
    return vertices.select(F.lit("v").alias("kind"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c")).union(faces.select(F.lit("f"), *[F.col(c).cast("double") for c in "abc"]))


@query("validate_manifest_hashes", """SELECT s_suppkey, s_name, sha256(concat('{"s_name":"', s_name, '","s_nationkey":', s_nationkey, ',"s_suppkey":', s_suppkey, '}')) AS payload_sha256 FROM supplier""")
def manifest(spark, d):
    """SRC-09: rows with their payload's hash; a row whose hash is another's would be an error."""
    s = V.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    stored = s.join(L.row_hash(s, ["s_suppkey"]).withColumnRenamed("row_sha256", "payload_sha256"), "s_suppkey")
    return D.verified_manifest(stored, ["s_suppkey", "s_name", "s_nationkey"]).select("s_suppkey", "s_name", "payload_sha256")


@query("fun_row_hash", """SELECT c_custkey, sha256(concat('{"c_custkey":', c_custkey, ',"c_mktsegment":"', c_mktsegment, '","c_nationkey":', c_nationkey, '}')) AS row_sha256 FROM customer""")
def row_hash(spark, d):
    """FUN-13."""
    return L.row_hash(V.table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment"), ["c_custkey"])
