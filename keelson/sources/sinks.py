"""Sinks: create-only, fail-closed, with hashes that this engine can check again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.se3 import is_valid


def no_nan(df: DataFrame) -> DataFrame:
    """SNK-01: an error where a double is NaN or infinite."""
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(c, F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{c} isn't finite")).cast(kind)).otherwise(F.col(c)))
    return df


def write_new(df: DataFrame, path: str, format: str = "parquet") -> None:
    """SNK-01, SNK-04: refuses a target that exists."""
    no_nan(df).write.mode("errorifexists").format(format).save(path)


def write_trajectory(poses: DataFrame, path: str) -> None:
    """SNK-02: poses with a hash of their values rounded half-even to seven digits; an invalid transform is an error."""
    ok = poses.withColumn("t", F.when(is_valid("t"), F.col("t")).otherwise(F.raise_error(F.lit("invalid transform")).cast("array<double>")))
    text = F.to_json(F.struct("frame_id", "timestamp_us", F.transform("t", lambda x: F.bround(x, 7)).alias("t")))
    ok.withColumn("stable_sha256", F.sha2(text, 256)).write.mode("errorifexists").parquet(path)


def write_decisions(decisions: DataFrame, path: str) -> None:
    """SNK-05, SEM-02: all decisions; transforms of the usable ones only. A usable one without a transform is an error."""
    checked = decisions.withColumn("usable", F.when(F.col("usable") & F.col("transform").isNull(), F.raise_error(F.lit("usable without a transform")).cast("boolean")).otherwise(F.col("usable")))
    checked.drop("transform").write.mode("errorifexists").json(f"{path}/decisions")
    checked.where("usable").select("pair_id", "transform").write.mode("errorifexists").json(f"{path}/transforms")


def write_summary(df: DataFrame, path: str, columns: list[str]) -> None:
    """SNK-08: the named columns, with a header."""
    df.select(*columns).write.mode("errorifexists").option("header", "true").csv(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SNK-03: ``path, bytes, sha256`` of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_sample(rows: DataFrame, path: str, key: str, item: str, most: int = 7) -> None:
    """SNK-07: at most ``most`` items of each key, by a hash (the feature is a sample)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.xxhash64(key, item), item)
    rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n").write.mode("errorifexists").json(path)
