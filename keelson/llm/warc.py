"""Fixity audits of WARC archives with Merkle trees.

A manifest has one row a record: ``archive, offset, length, record_sha256``. Its tree is built over byte ranges: a leaf
is the hash of the records that begin in one range of ``RANGE`` bytes, in order of their offsets, and a node the hash of
its ``FANOUT`` children's. Ranges and not ordinals number the nodes, so a lost record changes its own branch only and
no global numbering is needed; a group is bounded by what begins in a range, or by the fan-out.

Two replicas are compared from their archives' roots down. On every level only the children of nodes that differ are
looked at, so where replicas agree the audit costs one row an archive; what is left at the bottom is compared record
by record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.lexicon import batches
from keelson.sources.durable import durable

RANGE = 1 << 16
FANOUT = 16
PER_ARCHIVE = 500


def response_record(record_id: Column, url: Column, body: Column) -> Column:
    """A WARC response record as text; nulls are empty, the length is the body's in UTF-8."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), text(record_id), F.lit(">\r\nWARC-Target-URI: "), text(url), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text(body)).cast("string"), F.lit("\r\n\r\n")
    )
    return F.concat(head, text(body), F.lit("\r\n\r\n"))


def lay_out(records: DataFrame, archive: str = "archive", order: tuple[str, ...] = ("page_id", "record_sha256"), length: str = "length") -> DataFrame:
    """Adds ``offset``: records of an archive one after another in the given order. An archive is one group; its rows
    are numbers and digests, not contents."""
    w = Window.partitionBy(archive).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of uncompressed WARC files: ``archive, offset, length, kind, uri, record_sha256``.

    A file is read by one task, as the format has no place to start from but its beginning. A damaged head ends
    the file's records there: the rest is one record of kind ``damaged``."""
    import hashlib

    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("record_sha256", pa.string())])

    def split(name: str, data: memoryview) -> Iterator[tuple]:
        at, raw = 0, bytes(data)
        while at < len(raw):
            end = raw.find(b"\r\n\r\n", at)
            lines = raw[at:end].decode("utf-8", "replace").split("\r\n") if end > 0 else [""]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = fields.get("content-length", "")
            stop = end + 4 + int(size) + 4 if lines[0].startswith("WARC/") and size.isdigit() else -1
            if stop < 0 or stop > len(raw):
                yield name, at, len(raw) - at, "damaged", None, hashlib.sha256(raw[at:]).hexdigest()
                return
            yield name, at, stop - at, fields.get("warc-type"), fields.get("warc-target-uri"), hashlib.sha256(raw[at:stop]).hexdigest()
            at = stop

    def of(it):
        yield from batches((row for b in it for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for row in split(name, data)), schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("path"), "content").mapInArrow(of, "archive string, offset long, length long, kind string, uri string, record_sha256 string")


def _hash(parts: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: F.concat_ws(":", p["k"].cast("string"), p["v"])), "\n"), 256)


def leaves(manifest: DataFrame) -> DataFrame:
    """Level 0 of the trees: ``archive, idx, hash`` for each byte range in which records begin."""
    parts = manifest.select("archive", F.floor(F.col("offset") / RANGE).alias("idx"), F.struct(F.col("offset").alias("k"), F.concat_ws(":", F.col("length").cast("string"), F.col("record_sha256")).alias("v")).alias("part"))
    return parts.groupBy("archive", "idx").agg(_hash("part").alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    up = nodes.select("archive", F.floor(F.col("idx") / FANOUT).alias("up"), F.struct(F.col("idx").alias("k"), F.col("hash").alias("v")).alias("part"))
    return up.groupBy("archive", F.col("up").alias("idx")).agg(_hash("part").alias("hash"))


def tree(manifest: DataFrame, levels: int) -> list[DataFrame]:
    """Stored levels, leaves first; the last has one node (0) an archive."""
    out = [durable(leaves(manifest), "merkle")]
    for _ in range(levels):
        out.append(durable(parents(out[-1]), "merkle"))
    return out


def depth(*manifests: DataFrame) -> int:
    """Levels above the leaves until one node covers every archive."""
    most = max([(m.agg(F.max("offset")).first()[0] or 0) for m in manifests])
    n, levels = most // RANGE + 1, 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that only one side has."""
    x = a.select(*keys, F.col("hash").alias("ha")).join(b.select(*keys, F.col("hash").alias("hb")), keys, "full")
    return x.where(~F.col("ha").eqNullSafe(F.col("hb"))).select(*keys)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """The records in which two replicas differ: ``archive, offset, status, left_sha256, right_sha256``.

    ``status`` is corrupt (same place, other content or length), missing (the left replica only has it) or extra. Equal
    replicas and empty manifests give no rows. Offsets are unique within an archive of a replica; null archives are
    left out. Other columns of the manifests are left out."""
    a, b = (durable(m.where("archive IS NOT NULL").select("archive", "offset", "length", "record_sha256"), "manifest") for m in (left, right))
    levels = depth(a, b)
    ta, tb = tree(a, levels), tree(b, levels)
    wrong = differing(ta[-1], tb[-1], ["archive", "idx"])
    for level in range(levels - 1, -1, -1):
        under = durable(wrong.select("archive", F.col("idx").alias("up")), "differing")
        below = [t[level].withColumn("up", F.floor(F.col("idx") / FANOUT)).join(under, ["archive", "up"], "left_semi") for t in (ta, tb)]
        wrong = differing(*below, ["archive", "idx"])
    ranges = durable(wrong, "differing")
    ra, rb = (m.withColumn("idx", F.floor(F.col("offset") / RANGE)).join(ranges, ["archive", "idx"], "left_semi").select("archive", "offset", F.struct("length", "record_sha256").alias(n)) for m, n in ((a, "l"), (b, "r")))
    x = ra.join(rb, ["archive", "offset"], "full").where(~F.col("l").eqNullSafe(F.col("r")))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("corrupt")
    return x.select("archive", "offset", status.alias("status"), F.col("l.record_sha256").alias("left_sha256"), F.col("r.record_sha256").alias("right_sha256"))


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", per_archive: int = PER_ARCHIVE) -> DataFrame:
    """Pages as records of archives of ``per_archive`` ids: ``page_id, archive, offset, length, record_sha256`` and
    ``damaged_sha256``, the digest of the same record with its body's first character overwritten (null without a
    body). Contents are hashed while scanning; only numbers and digests are shuffled. Pages without an id go to
    archives by a hash of their content."""
    i = F.col(page_id).cast("long")
    record = response_record(i, F.col(url), F.col(html))
    damaged = response_record(i, F.col(url), F.concat(F.lit("#"), F.substring(F.col(html), 2, 1 << 30)))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    spread = F.lit(-1) - F.pmod(F.xxhash64(url, html), F.lit(1000))
    rows = pages.select(i.alias("page_id"), F.coalesce(F.floor(i / per_archive), spread).alias("archive"), F.octet_length(record).cast("long").alias("length"), sha(record).alias("record_sha256"), F.when(F.length(F.col(html)) > 0, sha(damaged)).alias("damaged_sha256"))
    return lay_out(rows)
