"""Frame replay as a stream: the batch operators' results, kept up to date.

The batch forms in :mod:`keelson.operators.trajectories` are the source of truth; a stream that has seen all
frames gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keelson.operators import trajectories as T
from keelson.sources.frames import JOURNAL, admitted


def journal_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """SRC-08: admitted frames of a growing folder of NDJSON journals."""
    return admitted(spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_per_trigger).json(path))


def windowed_counts(events: DataFrame, time: str = "ts", lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """STR-01: frames and tracked frames by time window, with a bound on lateness."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("frames"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "frames", "value")


def accumulated_subscans(frames: DataFrame, threshold: int) -> DataFrame:
    """STR-02 as a stateful operator: the seen points of a sequence live in state until ``threshold`` of them end a
    subscan. ``sequence_id, ordinal, points``; frames of one trigger are put in order, a frame older than the state
    is an error (STR-03: no lateness)."""

    return _stateful(frames.select("sequence_id", "ordinal", "points"), _Subscans(threshold), "sequence_id long, subscan int, first int, last int, points int", "none")


def outcomes(rows: DataFrame, patience_us: int, lateness: str = "10 minutes") -> DataFrame:
    """STR-01 as a stream: :func:`keelson.operators.trajectories.replay_outcomes` of requests and answers as they come.

    Only frames that wait for their other half are state, each a map entry of its own; a timer of the event time ends them
    ``patience_us`` on, once the watermark has passed. Rows may come in any order within ``lateness``, requests
    by rising frames (a frame asked for again, or out of turn, is an error: STR-03). Of several answers the first that comes ends a frame."""
    timed = rows.where(T.WHOLE).select("sequence_id", "frame", "kind", "at_us", "tracked", F.timestamp_micros("at_us").alias("time")).withWatermark("time", lateness)
    return _stateful(timed, _Outcomes(patience_us), "sequence_id long, frame long, status string, latency_us long", "eventtime")


def _stateful(df: DataFrame, processor: StatefulProcessor, out: str, time: str) -> DataFrame:
    """``processor`` for each sequence. Maps and timers need the session's state store to be the one with column families."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df.groupBy("sequence_id").transformWithStateInPandas(processor, outputStructType=out, outputMode="append", timeMode=time)


class _Subscans(StatefulProcessor):
    """The seen points are a map: a trigger reads and writes the points of its own frames, not all there are."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "point long", "ordinal int")
        self.head = handle.getValueState("head", "last int, subscan int, first int, size int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, subscan, first, size = self.head.get() or (-1, 0, -1, 0)
        out = []
        for o, points in pd.concat(list(rows)).sort_values("ordinal")[["ordinal", "points"]].itertuples(index=False):
            if o <= last:
                raise ValueError(f"frame {o} of sequence {key[0]} comes after frame {last}")
            last, first = int(o), int(o) if first < 0 else first
            for p in {int(x) for x in points}:
                if not self.seen.containsKey((p,)):
                    self.seen.updateValue((p,), (last,))
                    size += 1
            if size >= self.threshold:
                out.append((key[0], subscan, first, last, size))
                self.seen.clear()
                subscan, first, size = subscan + 1, -1, 0
        self.head.update((last, subscan, first, size))
        yield pd.DataFrame(out, columns=["sequence_id", "subscan", "first", "last", "points"])

    def close(self) -> None:
        pass


class _Outcomes(StatefulProcessor):
    def __init__(self, patience_us: int):
        self.patience = patience_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "frame long", "asked long, answered long, tracked boolean")
        self.last = handle.getValueState("last", "frame long")

    def _ended(self, key, frame, asked, answered, tracked):
        if asked is None:
            return (key[0], frame, "unasked", None)
        if answered is None or not 0 <= answered - asked <= self.patience:
            return (key[0], frame, "timeout", None)
        return (key[0], frame, "tracked" if tracked else "lost", answered - asked)

    def _frame(self, out) -> Iterator[pd.DataFrame]:
        x = pd.DataFrame(out, columns=["sequence_id", "frame", "status", "latency_us"])
        yield x.astype({"latency_us": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x, out, waiting = pd.concat(list(rows)), [], {}
        last = self.last.exists() and self.last.get()[0]
        last = None if last is False else last
        ordered = x.assign(answer=x["kind"] != "request", tracked=x["tracked"].eq(True)).sort_values(["answer", "frame", "at_us", "tracked"])
        for frame, answer, at, tracked in ordered[["frame", "answer", "at_us", "tracked"]].itertuples(index=False):
            frame, at = int(frame), int(at)
            known = waiting.get(frame) or (self.open.containsKey((frame,)) and tuple(self.open.getValue((frame,)))) or None
            if not answer:
                if last is not None and frame <= last:
                    raise ValueError(f"frame {frame} of sequence {key[0]} is asked for after frame {last}")
                last = frame
                waiting[frame] = (at, *(known[1:] if known else (None, None)))
            elif known is None and last is not None and frame <= last:
                continue  # the frame has ended: answered, or waited for too long
            elif known is None or known[1] is None:
                waiting[frame] = (known[0] if known else None, at, bool(tracked))
        for frame, (asked, answered, tracked) in waiting.items():
            if asked is not None and answered is not None:
                out.append(self._ended(key, frame, asked, answered, tracked))
                if self.open.containsKey((frame,)):
                    self.open.removeKey((frame,))
            else:
                self.open.updateValue((frame,), (asked, answered, tracked))
                self.handle.registerTimer((asked if asked is not None else answered) // 1000 + self.patience // 1000 + 1)
        if last is not None:
            self.last.update((last,))
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (frame,), (asked, answered, tracked) in list(self.open.iterator()):
            if (asked if asked is not None else answered) // 1000 + self.patience // 1000 + 1 <= now:
                out.append(self._ended(key, frame, asked, answered, tracked))
                self.open.removeKey((frame,))
        yield from self._frame(out)

    def close(self) -> None:
        pass
