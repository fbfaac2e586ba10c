"""Pieces the operators share: bounded bitmaps, joins with hot keys, connected components, and the durable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.sources.durable import drop_durable, durable

#: The white space that the contracts name, as a regular-expression class.
SPACES = r"[\x20\x09-\x0D]"
NON_SPACES = r"[^\x20\x09-\x0D]"


def words_text(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it needs to differ from all column names in ``taken``."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return out


# -- bitmaps of bounded size -------------------------------------------------------------------

#: A bitmap's size as a power of two: at most 32 MiB are broadcast.
LEAST_BITS, MOST_BITS = 16, 28
#: Bits for each key.
ROOM = 16


def bitmap_of(keys: DataFrame, hashed: Column) -> tuple[DataFrame, int] | None:
    """A bitmap over 64-bit hashes of a stored table's keys, in rows of 4 KiB, and its size as a power of two: ``ROOM`` bits for
    each key. None if there are so many keys that the largest bitmap would let most other rows through as well."""
    n = keys.count()
    bits = max(LEAST_BITS, (n * ROOM - 1).bit_length() if n else 0)
    if bits > MOST_BITS + 2:
        return None
    bits = min(bits, MOST_BITS)
    x = F.pmod(hashed, F.lit(1 << bits)) + F.lit(1)
    rows = keys.select(F.bitmap_bucket_number(x).alias("bucket"), F.bitmap_bit_position(x).alias("at")).distinct().groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    return durable(rows, "bitmap"), bits


def marked(df: DataFrame, hashed: Column, keys: DataFrame, keys_hashed: Column, name: str) -> DataFrame:
    """Adds ``name``: whether a row's hash may be one of the keys' (a stored table). Never false for a key; true for few others,
    or for all rows if the keys are too many for a bitmap. ``df`` may have columns of any names but ``name``."""
    found = bitmap_of(keys, keys_hashed)
    if found is None:
        return df.withColumn(name, F.lit(True))
    bitmap, bits = found
    bucket, held = fresh([*df.columns, name], "_bucket", "_bits")
    x = F.pmod(hashed, F.lit(1 << bits)) + F.lit(1)
    at = F.bitmap_bit_position(x)
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # the shift by a column, written as a division, as shiftright() takes literals only
    on = F.floor(byte / F.pow(F.lit(2.0), at % 8)).cast("long") % 2 == 1
    return (
        df.withColumn(bucket, F.bitmap_bucket_number(x))
        .join(F.broadcast(bitmap.select(F.col("bucket").alias(bucket), F.col("bits").alias(held))), bucket, "left")
        .withColumn(name, F.coalesce(on, F.lit(False)))
        .drop(bucket, held)
    )


# -- joins with hot keys -----------------------------------------------------------------------

#: Keys of more than one in so many rows are hot: there are at most so many of them.
HOT = 1000


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key and in ``n`` how many of the ``total`` rows have it.

    Keys of more than ``total / HOT`` rows are fewer than ``HOT``, so their facts are broadcast and their rows stay where they
    are; all other rows are shuffled, and none of their keys is large. ``how`` is inner or left; keys aren't null. ``n`` is
    left out."""
    hot, cold = facts.where(F.col(n) * HOT > total).drop(n), facts.where(F.col(n) * HOT <= total).drop(n)
    there = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return there.unionByName(rest)


# -- rows that stay --------------------------------------------------------------------------------


def row_key(doc_id: Column, digest: Column) -> Column:
    """A key of a row's id and text; rows without an id are told apart by the text alone."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), digest.cast("string"))


def keep_told(docs: DataFrame, told: DataFrame, doc_id: Column, digest: Column) -> DataFrame:
    """``docs`` as ``told`` says: ``doc_id, digest, n, stays`` for keys of an id and a digest, ``n`` rows each. Rows of a key that
    doesn't stay go, of a key that stays one row is kept (the one with the smallest hash), and rows of all other keys are kept.

    A bitmap of the ids lets most rows pass while scanning; only rows that it marks are shuffled, so the other texts stay where
    they are. ``digest`` is worked out for marked rows only.
    """
    mark, key, stays = fresh(docs.columns, "_marked", "_key", "_stays")
    told = durable(told.select(F.xxhash64("doc_id").alias("id_hash"), row_key(F.col("doc_id"), F.col("digest")).alias(key), "n", F.col("stays").alias(stays)), "told")
    rows = marked(docs, F.xxhash64(doc_id.cast("long")), told, F.col("id_hash"), mark)
    doubtful = rows.where(F.col(mark)).drop(mark).withColumn(key, row_key(doc_id, digest))
    total = told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_hot(doubtful, told.drop("id_hash"), [key], "n", max(total, 1), "left")
    out = rows.where(~F.col(mark)).select(*docs.columns).unionByName(joined.where(F.col(stays).isNull()).select(*docs.columns))
    if told.where(F.col(stays)).isEmpty():
        return out
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = joined.where(F.col(stays)).groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*plain)).alias("_one"))
    return out.unionByName(one.select("_one.*"))


# -- connected components ----------------------------------------------------------------------


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of an edge table: ``(node, root)``, root the smallest node of its component.

    Alternates the two star contractions: every node first hangs its larger neighbours on its smallest
    neighbour, then itself and its smaller neighbours on the smallest. Each round is two aggregations
    and two joins over a shrinking edge table, until nothing changes; nothing is gathered per component, and a node
    with a large share of the edges meets them by a broadcast of its one row. Self loops and null
    ends are dropped; a node without an edge does not appear.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = durable(e, "edges")
    size, before = e.count(), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        far = durable(join_hot(both.where("v > u"), low.where("n > 0"), ["u"], "n", size).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        low = far.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = join_hot(far, low, ["u"], "n", size).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        now = durable(near, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_durable(e)
        drop_durable(far)
        e, size = now, state[0]
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
