"""Keyed state with event-time timers: rows wait until the watermark has passed them, are worked through in order, and state goes
after an idle time.  So late rows within the delay change nothing, the last run is emitted, and no key stays for ever.

The sessions that run these need the state store provider ``STORE`` under ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Hands rows to ``step`` by time, then frame, once the watermark has passed them; after ``idle`` milliseconds ``finished`` ends a key.

    Rows have ``at`` (milliseconds), ``frame_index`` and the columns of ``fields``; the state of a key is a tuple as in ``kept``.
    Rows at or before the watermark are late and left out, as everywhere in a stream.
    """

    fields: list[str]
    waiting_kind: str
    kept: str
    out: list[str]

    def __init__(self, idle_millis: int):
        self.idle = idle_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at bigint, frame_index bigint, {self.waiting_kind}")
        self.state = handle.getValueState("state", f"last bigint, {self.kept}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, latest = timerValues.getCurrentWatermarkInMs(), None
        for batch in rows:
            for row in batch.to_dict("records"):
                at = int(row["at"])
                if at > passed:
                    self.waiting.appendValue((at, int(row["frame_index"]), *[float(row[f]) for f in self.fields]))
                    latest = max(at, latest or at)
        if latest is not None:
            self.handle.registerTimer(latest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        stored = tuple(self.state.get()) if self.state.exists() else None
        last, state = (stored[0], stored[1:]) if stored else (None, None)
        out = []
        for at, frame, *values in due:
            if last is not None and at - last >= self.idle:
                out += self.finished(key, state)
                state = None
            state, made = self.step(key, state, frame, values)
            out += made
            last = at
        if due:
            self.handle.registerTimer(last + self.idle)
        if last is not None and now - last >= self.idle:
            out += self.finished(key, state)
            self.state.clear()
        elif due:
            self.state.update((last, *state))
        yield pd.DataFrame(out, columns=self.out)

    def step(self, key: tuple, state: tuple | None, frame: int, values: list[float]) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def finished(self, key: tuple, state: tuple) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


class Runs(InOrder):
    """A row for each run of the hysteresis state when it closes or its video falls silent."""

    fields, waiting_kind, kept = ["speed"], "speed double", "stopped boolean, start bigint, finish bigint"
    out = ["video_id", "stopped", "start_frame", "end_frame"]

    def __init__(self, idle_millis: int, enter: float, leave: float):
        super().__init__(idle_millis)
        self.enter, self.leave = enter, leave

    def step(self, key, state, frame, values):
        stopped, start, finish = state or (False, None, None)
        now = values[0] <= (self.leave if stopped else self.enter)
        if start is None:
            return (now, frame, frame), []
        if now == stopped:
            return (stopped, start, frame), []
        return (now, frame, frame), [(key[0], stopped, start, finish)]

    def finished(self, key, state):
        return [(key[0], *state)]


class Velocity(InOrder):
    """Velocity against the observation before of the same track; the first one after a silence has none."""

    fields, waiting_kind, kept = ["x", "z"], "x double, z double", "frame bigint, x double, z double"
    out = ["video_id", "track_id", "frame_index", "obj_vx", "obj_vz", "has_rel_motion"]

    def step(self, key, state, frame, values):
        x, z = values
        if state is None:
            return (frame, x, z), [(*key, frame, 0.0, 0.0, False)]
        gap = max(1, frame - state[0])
        return (frame, x, z), [(*key, frame, (x - state[1]) / gap, (z - state[2]) / gap, True)]


def timed(rows: DataFrame, time: str, delay: str) -> DataFrame:
    return rows.withWatermark(time, delay).withColumn("at", F.unix_millis(F.col(time).cast("timestamp")))


def closed_runs(frames: DataFrame, time: str, delay: str, idle_millis: int, enter: float, leave: float) -> DataFrame:
    """video_id, stopped, start_frame, end_frame of a stream of (video_id, frame_index, speed, time)."""
    if enter > leave:
        raise ValueError("a stop must be harder to enter than to keep")
    return timed(frames, time, delay).groupBy("video_id").transformWithStateInPandas(
        Runs(idle_millis, enter, leave), "video_id bigint, stopped boolean, start_frame bigint, end_frame bigint", "Append", "EventTime"
    )


def velocities(observations: DataFrame, time: str, delay: str, idle_millis: int) -> DataFrame:
    """Velocities of a stream of (video_id, track_id, frame_index, x, z, time), in the order of time whatever the order of arrival."""
    return timed(observations, time, delay).groupBy("video_id", "track_id").transformWithStateInPandas(
        Velocity(idle_millis), "video_id bigint, track_id bigint, frame_index bigint, obj_vx double, obj_vz double, has_rel_motion boolean", "Append", "EventTime"
    )


def store_batch(path: str):
    """A ``foreachBatch`` sink of (example_id, confidence): a batch that is replayed takes its own place again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        best = batch.groupBy("example_id").agg(F.max("confidence").alias("score"))
        best.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stored_predictions(spark: SparkSession, path: str) -> DataFrame:
    """example_id, score: the best confidence over all batches."""
    return spark.read.parquet(path).groupBy("example_id").agg(F.max("score").alias("score"))
