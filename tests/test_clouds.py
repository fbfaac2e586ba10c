"""Cloud files written here read back equal, in several ranges a file; the submap sink commits all or nothing."""

import io
import os

import numpy as np
import pytest

from keelson.sources import clouds
from pyspark.sql import functions as F

RNG = np.random.default_rng(4)
N = 3_000
DTYPE = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("objectId", "<i4"), ("w", "<f8")]


def records(n=N):
    out = np.zeros(n, DTYPE)
    for c in "xyz":
        out[c] = RNG.normal(size=n).astype("f4")
    out["red"], out["objectId"], out["w"] = RNG.integers(0, 256, n), RNG.integers(0, 60, n), RNG.normal(size=n)
    return out


def ply(rows, form) -> bytes:
    names = {"<f4": "float", "|u1": "uchar", "<i4": "int", "<f8": "double"}
    head = f"ply\nformat {form} 1.0\ncomment made here\nelement vertex {len(rows)}\n" + "".join(f"property {names[rows.dtype[n].str]} {n}\n" for n in rows.dtype.names)
    head += "element face 2\nproperty list uchar int vertex_indices\nend_header\n"
    if form == "ascii":
        return (head + "".join(" ".join(repr(v.item()) for v in r) + "\n" for r in rows) + "3 0 1 2\n3 2 1 0\n").encode()
    d = rows if form.endswith("little_endian") else rows.astype(rows.dtype.newbyteorder(">"))
    return head.encode() + d.tobytes() + b"\x03\x00\x00\x00\x00"


def same(got, rows):
    got = sorted(got, key=lambda r: r["at"])
    assert len(got) == len(rows)
    for n in rows.dtype.names:
        assert np.array_equal(np.array([r[n] for r in got]), rows[n]), n


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, form):
    rows = records()
    (tmp_path / "a.ply").write_bytes(ply(rows, form))
    df = clouds.read_cloud(spark, str(tmp_path / "a.ply"), range_bytes=9_001)
    assert df.rdd.getNumPartitions() > 5 and dict(df.dtypes)["objectId"] == "int" and dict(df.dtypes)["w"] == "double"
    same(df.collect(), rows)
    for size in (19, 100_000_000):  # ranges that cut lines anywhere
        few = rows[:40]
        (tmp_path / "few.ply").write_bytes(ply(few, form))
        same(clouds.read_cloud(spark, str(tmp_path / "few.ply"), range_bytes=size).coalesce(4).collect(), few)
        (tmp_path / "points.ply").write_bytes(ply(few, form).replace(b"element face 2\nproperty list uchar int vertex_indices\n", b"").replace(b"3 0 1 2\n3 2 1 0\n", b""))
        same(clouds.read_cloud(spark, str(tmp_path / "points.ply"), range_bytes=size).coalesce(4).collect(), few)


def test_npy_with_pushed_ids(spark, tmp_path):
    rows = records()
    np.save(tmp_path / "data.npy", rows)
    df = clouds.read_cloud(spark, f"file://{tmp_path}/data.npy", range_bytes=10_000)
    same(df.collect(), rows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = clouds.read_cloud(spark, f"file://{tmp_path}/data.npy", range_bytes=10_000)
        some = df.where("objectId IN (3, 5) AND w > 0")
        assert "Filter (objectId" not in some._jdf.queryExecution().executedPlan().toString()
        same(some.collect(), rows[np.isin(rows["objectId"], [3, 5]) & (rows["w"] > 0)])
        same(df.where("objectId = 7").collect(), rows[rows["objectId"] == 7])
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    np.save(tmp_path / "plain.npy", np.arange(12, dtype="<i8").reshape(4, 3))
    assert sorted(map(tuple, clouds.read_cloud(spark, str(tmp_path / "plain.npy")).drop("file").collect())) == [(k, 3 * k, 3 * k + 1, 3 * k + 2) for k in range(4)]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_predicted_graphs(spark, tmp_path, save):
    files = {}
    for name in ("s1", "s2"):
        labels = np.concatenate([np.zeros(70, int), np.full(60, 1), np.full(50, 2), np.full(49, 3)])
        edges = np.array([[1, 2], [1, 2], [2, 1], [1, 3], [0, 1]])
        names = np.array(["close by", "close by", "none", "left", "left"])
        files[name] = labels
        save(tmp_path / f"{name}.npz", xyz=RNG.normal(size=(len(labels), 3)), labels=labels, relation_edges=edges, relation_labels=names)
    points, relations = clouds.read_predicted_graph(spark, str(tmp_path))
    assert {(r["file"].rsplit("/", 1)[-1], r["label"]): r["n"] for r in points.groupBy("file", "label").agg(F.count("*").alias("n")).collect()} == {(f"{s}.npz", k): n for s in files for k, n in ((1, 60), (2, 50))}
    assert sorted((r["file"].rsplit("/", 1)[-1], r["sub"], r["obj"], r["name"]) for r in relations.collect()) == [(f"{s}.npz", 1, 2, "close by") for s in ("s1", "s1", "s2", "s2")]
    with pytest.raises(Exception, match="different lengths"):
        clouds.read_cloud(spark, str(tmp_path)).count()
    parts = clouds.read_cloud(spark, str(tmp_path), "xyz", range_bytes=1000).rdd.getNumPartitions()
    assert parts == 2 if save is np.savez_compressed else parts > 8


def test_odd_files(spark, tmp_path):
    np.save(tmp_path / "none.npy", records(0))
    assert clouds.read_cloud(spark, str(tmp_path / "none.npy")).count() == 0
    (tmp_path / "bad.ply").write_bytes(b"not a ply")
    with pytest.raises(Exception, match="PLY header"):
        clouds.read_cloud(spark, str(tmp_path / "bad.ply")).count()
    with pytest.raises(Exception, match="no cloud files"):
        os.makedirs(tmp_path / "empty")
        clouds.read_cloud(spark, str(tmp_path / "empty")).count()
    (tmp_path / "short.ply").write_bytes(ply(records(3), "ascii").replace(b"3 0 1 2\n", b"").replace(b"vertex 3", b"vertex 4"))
    with pytest.raises(Exception, match="a vertex of 4 numbers"):
        clouds.read_cloud(spark, str(tmp_path / "short.ply")).count()


def submaps(spark, n=500):
    return spark.range(n).select((F.col("id") % 3).alias("sequence_id"), (F.col("id") % 5).alias("anchor"), F.col("id").alias("row"), (F.col("id") * 0.5).alias("x"))


def test_submaps_commit_once(spark, tmp_path):
    path = f"{tmp_path}/maps"
    clouds.write_submaps(submaps(spark), path, order=("row",), note="made by a test")
    assert sorted(os.listdir(tmp_path)) == ["maps"]
    status = {r["submap"]: (r["rows"], r["status"]) for r in clouds.verify_submaps(spark, path).collect()}
    assert len(status) == 15 and sum(n for n, _ in status.values()) == 500 and {s for _, s in status.values()} == {"intact"}
    z = np.load(f"{path}/1/2.npz")
    assert z["row"].tolist() == [k for k in range(500) if k % 3 == 1 and k % 5 == 2] and np.allclose(z["x"], z["row"] * 0.5) and "made by a test" in str(z["provenance"])
    assert clouds.read_cloud(spark, path, "row,x").count() == 500
    with pytest.raises(Exception, match="never written over"):
        clouds.write_submaps(submaps(spark), path)
    with open(f"{path}/0/0.npz", "r+b") as f:
        f.seek(100)
        f.write(b"?")
    os.remove(f"{path}/0/1.npz")
    np.savez(f"{path}/2/9.npz", x=np.zeros(1))
    status = {r["submap"]: r["status"] for r in clouds.verify_submaps(spark, path).collect()}
    assert {k: v for k, v in status.items() if v != "intact"} == {"0/0": "changed", "0/1": "missing", "2/9": "unlisted"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = submaps(spark).withColumn("x", F.when(F.col("row") == 321, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken row"):
        clouds.write_submaps(bad, f"{tmp_path}/maps")
    assert os.listdir(tmp_path) == []
    split = submaps(spark).repartition(4)
    spark.dataSource.register(clouds.SubmapSink)
    with pytest.raises(Exception, match="two tasks"):
        split.sortWithinPartitions("sequence_id", "anchor").write.format("keelson_submaps").option("keys", "sequence_id,anchor").mode("append").save(f"{tmp_path}/maps")
    assert os.listdir(tmp_path) == []
