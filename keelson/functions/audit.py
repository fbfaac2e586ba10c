"""Checks of paths, keys and schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.sources.durable import durable


def path_allowed(path: Column, root: str, forbidden: Iterable[str]) -> Column:
    """VAL-02: inside the root, without ".." and without a forbidden part (in any case). Null isn't allowed."""
    parts = F.split(F.lower(path), "/")
    bad = F.arrays_overlap(parts, F.array(*[F.lit(x.lower()) for x in [*forbidden, ".."]]))
    return F.coalesce(path.startswith(root.rstrip("/") + "/") & ~bad, F.lit(False))


def forbidden_fields(schema: T.DataType, forbidden: Iterable[str], prefix: str = "") -> list[str]:
    """VAL-06, VAL-07, SEM-01: the paths of all fields, however deep, whose name is forbidden or begins with "gt"."""
    names = {x.lower() for x in forbidden}
    out: list[str] = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            at = f"{prefix}{f.name}"
            if f.name.lower() in names or f.name.lower().startswith("gt"):
                out.append(at)
            out += forbidden_fields(f.dataType, names, at + ".")
    elif isinstance(schema, T.ArrayType):
        out += forbidden_fields(schema.elementType, names, prefix)
    elif isinstance(schema, T.MapType):
        out += forbidden_fields(schema.valueType, names, prefix)
    return out


def nested_keys(rows: DataFrame, key: str, json: str) -> DataFrame:
    """VAL-07, VAL-08: every object key in JSON texts, however deep: ``key, depth, path, name``.

    Texts are variants that are opened level by level, objects by key and arrays by position, until no container is left;
    each level is a stored table of the containers only, so a text is read again only as deep as it goes. ``path`` is in
    JSONPath's form, ``depth`` counts the containers around the key. Texts that aren't JSON, and nulls, have no keys."""
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("key"), F.col(json).alias("text"), F.lit("$").alias("path"))
    found, depth = None, 0
    while True:
        opened = level.select("key", "path", F.try_parse_json("text").alias("v")).where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        inner = opened.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "value"))
        at = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), "name"))
        container = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
        now = durable(inner.select("key", F.lit(depth).alias("depth"), at.alias("path"), "name", F.when(container, F.to_json("value")).alias("text")), "json-level")
        keys = now.where("name IS NOT NULL").select("key", "depth", "path", "name")
        found = keys if found is None else found.unionByName(keys)
        level, depth = now.where("text IS NOT NULL").select("key", "text", "path"), depth + 1
        if level.isEmpty():
            return found


def forbidden_keys(rows: DataFrame, key: str, json: str, forbidden: Iterable[str]) -> DataFrame:
    """VAL-06, VAL-07, VAL-08 over JSON texts: ``key, banned, paths`` for each row; ``paths`` of the object keys, at any depth, that have a
    forbidden name in any case or begin with "gt", sorted. Rows are told by ``key``."""
    low = F.lower("name")
    bad = nested_keys(rows, key, json).where(low.isin(*[x.lower() for x in forbidden]) | low.startswith("gt"))
    paths = bad.groupBy("key").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    out = rows.select(F.col(key).alias("key")).join(paths, "key", "left")
    return out.select("key", F.col("paths").isNotNull().alias("banned"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))
