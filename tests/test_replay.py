"""Replay with state: a stream, restarted between its files, gives what the batch operator gives."""

import random

import pytest

from keelson.operators import trajectories as T
from keelson.streaming import replay

ROWS = "sequence_id long, frame long, kind string, at_us long, tracked boolean"


def run(spark, make, schema, folder, parts, name):
    """The rows of a stream over ``parts``, each its own run from the same checkpoint."""
    source, out = f"file://{folder}/in-{name}", f"file://{folder}/out-{name}"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source))
        q = stream.writeStream.option("checkpointLocation", f"file://{folder}/state-{name}").trigger(availableNow=True).start(out, "json", "append")
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.schema(stream.schema).json(out).collect()


def test_outcomes_are_the_batch_ones_after_restarts(spark, tmp_path):
    rng, second, rows = random.Random(6), 1_000_000, []
    for s in (1, 2, 3):
        for f in range(12):
            t = (10 + f) * second
            rows.append((s, f, "request", t, None))
            if rng.random() < 0.8:
                rows.append((s, f, "answer", t + rng.randint(0, 3 * second), rng.random() < 0.7))
        rows.append((s, 500, "answer", 15 * second, True))  # never asked for
    rows.sort(key=lambda r: (r[3], r[1]))
    rows[5:5] = [(1, None, "answer", second, True), (1, 3, None, second, None), (1, 3, "answer", None, True)]
    cuts = [rows[:20], rows[20:21], rows[21:45], rows[45:]]
    end = [[(99, f, "request", (f + 1) * 100_000 * second, None)] for f in range(2)]  # moves the watermark on
    got = run(spark, lambda x: replay.outcomes(x, 2 * second, "30 seconds"), ROWS, tmp_path, [*cuts, *end], "outcomes")
    want = T.replay_outcomes(spark.createDataFrame(rows, ROWS), 2 * second).collect()
    assert sorted(map(tuple, (r for r in got if r["sequence_id"] != 99)), key=repr) == sorted(map(tuple, want), key=repr)
    assert {r["status"] for r in want} == {"tracked", "lost", "timeout", "unasked"}


def test_subscans_are_the_batch_ones_after_restarts(spark, tmp_path):
    rng = random.Random(8)
    schema = "sequence_id long, ordinal int, points array<long>"
    rows = [(s, o, [rng.randint(0, 60) for _ in range(5)]) for s in (1, 2) for o in range(30)]
    parts = [[r for r in rows if low <= r[1] < low + 10] for low in (0, 10, 20)]
    got = run(spark, lambda x: replay.accumulated_subscans(x, 15), schema, tmp_path, parts, "subscans")
    want = T.accumulated_subscans(spark.createDataFrame(rows, schema), 15).collect()
    assert len(want) > 4 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_frame_asked_for_twice_is_an_error(spark, tmp_path):
    rows = [(1, 4, "request", 1_000_000, None)]
    with pytest.raises(Exception, match="is asked for after frame 4"):
        run(spark, lambda x: replay.outcomes(x, 1000), ROWS, tmp_path, [rows, rows], "twice")


def test_outcomes_of_odd_rows(spark):
    rows = [(1, 0, "request", 5, None), (1, 0, "answer", 4, True), (2, 0, "answer", 9, None), (2, 0, "answer", 7, True), (2, 0, "request", 6, None), (3, 1, "request", 0, None), (3, 1, "answer", 10, None), (4, None, "request", 1, None), (4, 0, None, 1, None), (None, 0, "answer", 1, True), (4, 1, "request", None, None)]
    got = {r["sequence_id"]: (r["status"], r["latency_us"]) for r in T.replay_outcomes(spark.createDataFrame(rows, ROWS), 10).collect()}
    assert got == {1: ("timeout", None), 2: ("tracked", 1), 3: ("lost", 10)}
    assert T.replay_outcomes(spark.createDataFrame([], ROWS), 10).count() == 0
