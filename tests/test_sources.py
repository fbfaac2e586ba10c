"""Sources, sinks and streams."""

import json

import pytest

from keelson.operators import trajectories
from keelson.plans import views
from keelson.sources import frames, scene, sinks
from keelson.streaming import replay
from pyspark.sql import functions as F

ONE = [float(i % 5 == 0) for i in range(16)]


def test_journal(spark, tmp_path):
    lines = [{"frame_id": "a", "timestamp_us": 1, "storage_status": "complete", "admitted_to_fusion": True}, {"frame_id": "b", "storage_status": "complete"}, {"frame_id": "c", "storage_status": "partial", "admitted_to_fusion": True}]
    (tmp_path / "j.ndjson").write_text("\n".join(map(json.dumps, lines)))
    assert [r["frame_id"] for r in frames.read_journal(spark, str(tmp_path)).collect()] == ["a"]


def test_trajectory(spark, tmp_path):
    ok = {"frame_id": 1, "timestamp_us": 5, "t": ONE}
    (tmp_path / "a").write_text(json.dumps(ok))
    (tmp_path / "b").write_text("\n".join([json.dumps(ok)] * 2))
    (tmp_path / "c").write_text(json.dumps(ok | {"t": [2.0] * 16}))
    assert frames.read_trajectory(spark, str(tmp_path / "a")).count() == 1
    for name, why in (("b", "repeated frame"), ("c", "invalid transform")):
        with pytest.raises(Exception, match=why):
            frames.read_trajectory(spark, str(tmp_path / name)).collect()


def test_legacy_trajectory(spark, tmp_path):
    (tmp_path / "t.txt").write_text("7 100 1 0 0 1000 0 1 0 2000 0 0 1 0 0 0 0 1\nshort line\n8 100 1 0 0 0 0 1 0 0 0 0 1 0 0 0 0 1\n")
    allowed = spark.createDataFrame([(7,)], "frame_id long")
    r = frames.positions(frames.read_legacy_trajectory(spark, str(tmp_path), allowed)).collect()
    assert [(x["frame_id"], x["x"], x["y"], x["z"]) for x in r] == [(7, -1.0, -2.0, 0.0)]


def test_header(spark, tmp_path):
    (tmp_path / "info.txt").write_text("m_frames = 3\nm_calibration = 1 0 3 0 0 2 4 0 0 0 1 0 0 0 0 1\nnoise\n")
    kv = frames.key_values(spark, str(tmp_path / "info.txt"))
    assert kv.count() == 2
    r = frames.intrinsics(kv, "m_calibration").first()
    assert (r["fx"], r["fy"], r["cx"], r["cy"]) == (1.0, 2.0, 3.0, 4.0)


def test_listing(spark, tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / s / "depth").mkdir(parents=True)
        for f in ("0", "10"):
            (tmp_path / s / "depth" / f"{f}.png").write_bytes(b"x")
    listed = frames.depth_listing(spark, str(tmp_path))
    assert listed.count() == 4
    assert {r["timestamp_us"] for r in frames.framed_manifest(listed).collect()} == {1_000_000, 1_033_333}


def test_scene_files(spark, tmp_path):
    g = {"scans": [{"scan": "s", "objects": [{"id": 1, "label": "x", "attributes": {"color": ["red", "big"], "shape": ["flat"]}}], "relationships": [["1", "2", "3", "left"]]}]}
    (tmp_path / "g.json").write_text(json.dumps(g, indent=1))
    o, a, r = scene.read_graphs(spark, str(tmp_path / "g.json"))
    assert o.count() == 1 and a.count() == 3 and tuple(r.first()) == ("s", 1, 2, "left", 0)
    t = [float(i) for i in range(16)]
    (tmp_path / "r.json").write_text(json.dumps([{"reference": "a", "type": "x", "scans": [{"reference": "b", "transform": t}, {"reference": "c"}]}]))
    got = scene.read_rescans(spark, str(tmp_path / "r.json")).collect()
    assert len(got) == 1 and got[0]["t"][1] == 4.0
    (tmp_path / "v.txt").write_text("b\na\n")
    assert {x["name"]: x["slot"] for x in scene.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {"b": 0, "a": 1}
    (tmp_path / "m.csv").write_text("id,name\n1,x\nq,y\n")
    assert scene.read_label_map(spark, str(tmp_path / "m.csv"), "id", "name").count() == 1
    (tmp_path / "m.obj").write_text("v 0 0 1\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3/3\n# c\n")
    v, f = scene.read_obj(spark, str(tmp_path / "m.obj"))
    assert v.count() == 3 and (f.first()["a"], f.first()["c"]) == (1, 3)
    rec = spark.createDataFrame([("p", 2, "late"), ("p", 1, "early")], "pair string, root int, path string")
    assert scene.first_root(rec, "pair", "root").first()["path"] == "early"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0)], "a int, b double")
    sinks.write_new(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_new(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="isn't finite"):
        sinks.write_new(df.withColumn("b", F.lit(float("nan"))), str(tmp_path / "n"))
    d = spark.createDataFrame([("p", True, ONE), ("q", False, None)], "pair_id string, usable boolean, transform array<double>")
    sinks.write_decisions(d, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/decisions")).count() == 2 and spark.read.json(str(tmp_path / "d/transforms")).count() == 1
    with pytest.raises(Exception, match="usable without a transform"):
        sinks.write_decisions(d.withColumn("usable", F.lit(True)), str(tmp_path / "e"))
    p = spark.createDataFrame([(1, 2, ONE)], "frame_id long, timestamp_us long, t array<double>")
    sinks.write_trajectory(p, str(tmp_path / "t"))
    assert len(spark.read.parquet(str(tmp_path / "t")).first()["stable_sha256"]) == 64
    sinks.write_summary(df, str(tmp_path / "s"), ["b"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "s")).columns == ["b"]
    assert sinks.file_hashes(spark, str(tmp_path / "s")).count() >= 1
    sinks.write_sample(spark.range(30).select((F.col("id") % 2).alias("k"), "id"), str(tmp_path / "w"), "k", "id")
    assert spark.read.json(str(tmp_path / "w")).count() == 14


def test_stream_equals_batch(spark, tmp_path):
    p = views.poses(spark, "/root/testdata/sf0.001").select("sequence_id", "ordinal", F.expr("transform(sequence(0, 4), i -> (frame_id * 7 + i * 11) % 60)").alias("points"))
    batch = {tuple(r) for r in trajectories.accumulated_subscans(p, 30).collect()}
    # two files, the second with the later frames of every sequence
    p.where("ordinal < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    run = lambda: replay.accumulated_subscans(stream, 30).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    run()
    p.where("ordinal >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


def test_windowed_counts(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = replay.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    s.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination(300)
    assert spark.table("counts").agg(F.sum("frames")).first()[0] == e.count()


def test_journal_stream(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.ndjson").write_text(json.dumps({"frame_id": "a", "timestamp_us": 1, "storage_status": "complete", "admitted_to_fusion": True}))
    replay.journal_stream(spark, str(tmp_path / "j")).writeStream.format("memory").queryName("journal").trigger(availableNow=True).start().awaitTermination(300)
    assert spark.table("journal").count() == 1
