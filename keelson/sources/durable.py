"""Tables in the folder that the driver and all executors share: where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keelson-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame, what: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: its lineage ends there,
    so a lost executor costs a read and not a recomputation. ``schema``: to read it with, for types that are stored as
    others."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keelson/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete a table that :func:`durable` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/keelson/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
