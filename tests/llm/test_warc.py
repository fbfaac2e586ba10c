"""Fixity audits against a plain comparison of manifests, and the reader against files written here."""

import hashlib

import numpy as np

from keelson.llm import warc


def manifest(spark, rows):
    return spark.createDataFrame([(a, o, n, s) for (a, o), (n, s) in rows.items()], "archive long, offset long, length long, record_sha256 string")


def test_audit_finds_all_differences(spark):
    rng = np.random.default_rng(0)
    left = {}
    for a in range(6):
        at = 0
        for i in range(rng.integers(1, 60)):
            n = int(rng.integers(100, 300_000))
            left[a, at] = (n, f"h{a}.{i}")
            at += n
    right = dict(left)
    keys = sorted(left)
    for i in rng.choice(len(keys), 12, replace=False):
        k = keys[i]
        if k[0] == 5:
            continue
        if i % 3 == 0:
            del right[k]
        else:
            right[k] = (right[k][0], "damaged")
    right[2, 10**9] = (5, "new")
    want = {(k, "missing" if k not in right else "extra" if k not in left else "corrupt") for k in {*left, *right} if left.get(k) != right.get(k)}
    got = {((r["archive"], r["offset"]), r["status"]) for r in warc.audit(manifest(spark, left), manifest(spark, right)).collect()}
    assert got == want
    assert warc.audit(manifest(spark, left), manifest(spark, left)).count() == 0


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "archive long, offset long, length long, record_sha256 string, extra string")
    assert warc.audit(empty, empty).count() == 0
    one = manifest(spark, {(1, 0): (5, "x")})
    assert [r["status"] for r in warc.audit(one, empty).collect()] == ["missing"]
    assert [r["status"] for r in warc.audit(empty, one).collect()] == ["extra"]


def test_records_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, None, None), (None, "u", ""), (3, "v", "x" * 70_000), (3, "v", "x" * 70_000)], "page_id long, url string, html string")
    rows = pages.select("page_id", warc.response_record(*map(__import__("pyspark").sql.functions.col, ("page_id", "url", "html"))).alias("r")).collect()
    data = b"".join(r["r"].encode() for r in rows)
    (tmp_path / "a.warc").write_bytes(data)
    got = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    at = 0
    for r, g in zip(rows, got, strict=True):
        raw = r["r"].encode()
        assert (g["offset"], g["length"], g["kind"], g["record_sha256"]) == (at, len(raw), "response", hashlib.sha256(raw).hexdigest())
        at += len(raw)
    (tmp_path / "a.warc").write_bytes(data[:-9])
    assert warc.read_warc(spark, str(tmp_path)).where("kind = 'damaged'").count() == 1
    laid = warc.archived(pages).collect()
    assert len(laid) == 5 and len({(r["archive"], r["offset"]) for r in laid}) == 5
    by_id = {r["page_id"]: r for r in laid}
    assert by_id[1]["record_sha256"] == hashlib.sha256(rows[0]["r"].encode()).hexdigest() and by_id[2]["damaged_sha256"] is None


def test_archived_nothing(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
