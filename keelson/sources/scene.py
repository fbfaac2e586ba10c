"""Scene-graph sources: JSON graphs, transforms, vocabularies, label maps, meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPHS = "scans array<struct<scan:string,objects:array<struct<id:long,label:string,attributes:map<string,array<string>>>>,relationships:array<array<string>>>>"
RESCANS = "reference string, type string, scans array<struct<reference:string,transform:array<double>>>"


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-02: ``objects (scan_id, object_id, label)``, ``attributes (scan_id, object_id, name)``, ``relations
    (scan_id, sub, obj, name, pos)`` of a JSON file of scans; the attributes' map of lists is flattened."""
    s = spark.read.schema(GRAPHS).option("multiLine", "true").option("mode", "FAILFAST").json(path).select(F.explode("scans").alias("s"))
    o = s.select(F.col("s.scan").alias("scan_id"), F.explode("s.objects").alias("o"))
    objects = o.select("scan_id", F.col("o.id").alias("object_id"), F.col("o.label").alias("label"))
    attributes = o.select("scan_id", F.col("o.id").alias("object_id"), F.explode(F.flatten(F.map_values("o.attributes"))).alias("name"))
    r = s.select(F.col("s.scan").alias("scan_id"), F.posexplode("s.relationships").alias("pos", "r"))
    relations = r.select("scan_id", F.get("r", F.lit(0)).cast("long").alias("sub"), F.get("r", F.lit(1)).cast("long").alias("obj"), F.get("r", F.lit(3)).alias("name"), F.col("pos").cast("long").alias("pos"))
    return objects, attributes, relations


def read_rescans(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05, SRC-15, JOI-18: ``reference, scan, t`` of rescans that have a transform (column-major in the file)."""
    from keelson.functions.se3 import transpose

    x = spark.read.schema(RESCANS).option("multiLine", "true").json(path).select("reference", F.explode("scans").alias("s"))
    return x.where("s.transform IS NOT NULL").select("reference", F.col("s.reference").alias("scan"), transpose(F.col("s.transform")).alias("t"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16, SRC-20: ``name, slot`` in the order of a file's lines. A whole file is one row, as a word list is small
    and its line order counts."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("slot", "name"))
    return lines.where("name <> ''").select("name", "slot")


def read_label_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """SRC-17: two columns of a CSV with a header; rows whose key isn't a number are left out."""
    return spark.read.option("header", "true").csv(path).where(F.col(key).rlike("^[0-9]+$")).select(F.col(key).cast("long").alias(key), value)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-19: ``vertices (file, x, y, z)`` and ``faces (file, a, b, c)`` of mesh files; faces keep the file's 1-based
    vertex numbers."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim("value"), "\\s+").alias("w"))
    v = t.where("w[0] = 'v'").select("file", *[F.get("w", F.lit(i)).try_cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))])
    f = t.where("w[0] = 'f'").select("file", *[F.substring_index(F.get("w", F.lit(i)), "/", 1).cast("long").alias(c) for i, c in ((1, "a"), (2, "b"), (3, "c"))])
    return v, f


def first_root(records: DataFrame, key: str, priority: str) -> DataFrame:
    """SRC-04: of records found under several roots, the one of the first root."""
    return records.groupBy(key).agg(F.min_by(F.struct(*[c for c in records.columns if c != key]), priority).alias("_r")).select(key, "_r.*")
