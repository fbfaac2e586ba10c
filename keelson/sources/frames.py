"""Frame sources: listings, key-value headers, journals, trajectories. All with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions.se3 import at, inverse, is_valid

JOURNAL = "frame_id string, timestamp_us long, color_path string, depth_path string, storage_status string, admitted_to_fusion boolean"


def framed_manifest(frames: DataFrame, start_us: int = 1_000_000, period_us: int = 33_333) -> DataFrame:
    """SRC-06, SRC-07: frames in the order of their ids with made-up, evenly spaced timestamps."""
    w = Window.partitionBy("sequence_id").orderBy("frame_id")
    return frames.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long")).withColumn("timestamp_us", F.lit(start_us) + F.col("ordinal") * period_us)


def depth_listing(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: ``sequence_id, frame_id`` of the files ``<sequence>/depth/<frame>.png`` under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.regexp_extract("path", "([^/]+)/depth/[^/]+$", 1).alias("sequence_id"), F.regexp_extract("path", "([^/]+)\\.png$", 1).alias("frame_id")).where("sequence_id <> ''")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07, SRC-18: lines "key = value" of a header file: ``file, key, value``; other lines are left out.
    Spark's readers skip files whose names begin with an underscore or a dot; such headers need another name."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.split("value", " = ", 2).alias("kv")).where(F.size("kv") == 2)
    return t.select("file", F.trim(F.get("kv", F.lit(0))).alias("key"), F.trim(F.get("kv", F.lit(1))).alias("value"))


def intrinsics(header: DataFrame, key: str) -> DataFrame:
    """SRC-07: fx, fy, cx, cy from places 0, 5, 2, 6 of the 16 numbers under a key."""
    v = F.transform(F.split("value", "\\s+"), lambda x: x.try_cast("double"))
    return header.where(F.col("key") == key).select("file", *[F.get(v, F.lit(i)).alias(n) for n, i in (("fx", 0), ("fy", 5), ("cx", 2), ("cy", 6))])


def admitted(journal: DataFrame) -> DataFrame:
    """SRC-08: rows whose storage is complete and that were admitted; nulls are refused."""
    return journal.where((F.col("storage_status") == "complete") & F.col("admitted_to_fusion").eqNullSafe(F.lit(True)))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: an NDJSON journal; a line that isn't JSON is an error."""
    return admitted(spark.read.schema(JOURNAL).option("mode", "FAILFAST").json(path))


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: ``frame_id, timestamp_us, t`` as JSON lines; repeated frames and invalid transforms are errors."""
    t = spark.read.schema("frame_id long, timestamp_us long, t array<double>").option("mode", "FAILFAST").json(path)
    bad = F.when(F.count("*").over(Window.partitionBy("frame_id")) > 1, "repeated frame").when(~is_valid("t"), "invalid transform")
    return t.withColumn("bad", bad).where(F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.col("bad"), F.lit(" "), F.col("frame_id").cast("string"))).cast("boolean")).otherwise(True)).drop("bad")


def read_legacy_trajectory(spark: SparkSession, path: str, allowed: DataFrame | None = None) -> DataFrame:
    """SRC-11: lines of frame id, timestamp and 16 numbers, world to camera in millimetres; gives camera to world
    in metres, of the allowed frames only."""
    f = F.transform(F.split(F.trim("value"), "\\s+"), lambda x: x.try_cast("double"))
    x = spark.read.text(path).withColumn("f", f).where(F.size("f") == 18)
    metres = F.transform(F.slice("f", 3, 16), lambda v, i: F.when(i.isin(3, 7, 11), v / 1000).otherwise(v))
    out = x.select(F.get("f", F.lit(0)).cast("long").alias("frame_id"), F.get("f", F.lit(1)).cast("long").alias("timestamp_us"), metres.alias("m")).select("frame_id", "timestamp_us", inverse("m").alias("t"))
    return out if allowed is None else out.join(allowed.select("frame_id"), "frame_id", "left_semi")


def positions(trajectory: DataFrame) -> DataFrame:
    return trajectory.select("*", *[at("t", i, 3).alias(c) for i, c in enumerate("xyz")])
