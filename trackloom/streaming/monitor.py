"""Streaming forms; every function takes a batch or a streaming DataFrame and gives the same rows for both."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.operators.ordered import Ordered, previous, running_sum

#: Microseconds of one chunk of a subject.
CHUNK_MICROS = 15 * 60 * 1_000_000


def watermarked(events: DataFrame, time: str, delay: str) -> DataFrame:
    return events.withWatermark(time, delay) if events.isStreaming else events


def interval_report(events: DataFrame, time: str, length: str, failed: Column, latency: Column, delay: str) -> DataFrame:
    """Events, failure rate and mean latency per tumbling interval."""
    return (
        watermarked(events, time, delay)
        .groupBy(F.window(time, length).alias("w"))
        .agg(F.count("*").alias("events"), F.avg(failed.cast("double")).alias("failure_rate"), F.avg(latency).alias("mean_latency"))
        .select(F.col("w.start").alias("interval_start"), "events", "failure_rate", "mean_latency")
    )


def rolling_alerts(events: DataFrame, time: str, length: str, slide: str, failed: Column, limit: float, least: int, delay: str) -> DataFrame:
    """Sliding intervals whose failure rate is above the limit."""
    return (
        watermarked(events, time, delay)
        .groupBy(F.window(time, length, slide).alias("w"))
        .agg(F.count("*").alias("events"), F.avg(failed.cast("double")).alias("failure_rate"))
        .filter((F.col("events") >= least) & (F.col("failure_rate") > limit))
        .select(F.col("w.start").alias("interval_start"), "events", "failure_rate")
    )


def quiet_gap_sessions(events: DataFrame, keys: Sequence[str], time: str, gap: str, size: Column, delay: str) -> DataFrame:
    """Rows of a subject joined until a quiet gap.  A table is cut into chunks of time, so a busy subject is many tasks."""
    if events.isStreaming:
        return (
            watermarked(events, time, delay)
            .groupBy(*keys, F.session_window(time, gap).alias("w"))
            .agg(F.count("*").alias("events"), F.max(size).alias("peak"))
            .select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "peak")
        )
    quiet = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"interval {gap}")) - F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp"))
    at = events.select(*keys, F.col(time).alias("__at"), F.unix_micros(F.col(time).cast("timestamp")).alias("__us"), size.alias("__size")).filter("__us is not null")
    chunk = F.floor(F.col("__us") / CHUNK_MICROS)
    seen = Ordered(keys, ["__us"], chunk).scan(at, __before=previous(F.col("__us")))
    starts = seen.withColumn("__joins", F.coalesce((F.col("__us") - F.col("__before") < quiet).cast("int"), F.lit(0)))
    # of rows at one time the one that begins a session comes first
    numbered = Ordered(keys, ["__us", "__joins"], chunk).scan(starts, __session=running_sum(1 - F.col("__joins")))
    return numbered.groupBy(*keys, "__session").agg(
        F.min("__at").alias("session_start"), (F.max("__at") + F.expr(f"interval {gap}")).alias("session_end"), F.count("*").alias("events"), F.max("__size").alias("peak")
    ).drop("__session")


def votes_once(votes: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Each vote key once; the stream forgets keys beyond the watermark."""
    if votes.isStreaming:
        return votes.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return votes.dropDuplicates(list(keys))


def fire_rules(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Arriving (example_id, template) facts joined with the static rule table of single-atom rules."""
    return facts.join(rules, "template").select("example_id", "rule_id", "confidence")


def store_predictions(batch: DataFrame, path: str) -> None:
    """Sink for ``foreachBatch``: the best confidence per example of the micro-batch."""
    batch.groupBy("example_id").agg(F.max("confidence").alias("score")).write.mode("append").parquet(path)


def track_velocity(observations: DataFrame) -> DataFrame:
    """Velocity against the previous observation of the same track, with the last position as state.

    Rows are (video_id, track_id, frame_index, x, z); those of one micro-batch are sorted by frame.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, x, z = state.get if state.exists else (None, None, None)
        pdf = pd.concat(list(batches)).sort_values("frame_index")
        out = []
        for row in pdf.itertuples(index=False):
            if frame is None:
                out.append((key[0], key[1], row.frame_index, 0.0, 0.0, False))
            else:
                gap = max(1, row.frame_index - frame)
                out.append((key[0], key[1], row.frame_index, (row.x - x) / gap, (row.z - z) / gap, True))
            frame, x, z = int(row.frame_index), float(row.x), float(row.z)
        state.update((frame, x, z))
        yield pd.DataFrame(out, columns=["video_id", "track_id", "frame_index", "obj_vx", "obj_vz", "has_rel_motion"])

    return observations.groupBy("video_id", "track_id").applyInPandasWithState(
        step,
        "video_id bigint, track_id bigint, frame_index int, obj_vx double, obj_vz double, has_rel_motion boolean",
        "frame int, x double, z double",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def closing_runs(frames: DataFrame, enter: float, leave: float) -> DataFrame:
    """Hysteresis state per video, a row for each run when it closes; the open run is the state.

    Rows are (video_id, frame_index, speed); a run closes when the state flips.
    """
    if enter > leave:
        raise ValueError("a stop must be harder to enter than to keep")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stopped, start, end = state.get if state.exists else (False, None, None)
        pdf = pd.concat(list(batches)).sort_values("frame_index")
        out = []
        for row in pdf.itertuples(index=False):
            now = row.speed <= (leave if stopped else enter)
            if start is not None and now != stopped:
                out.append((key[0], bool(stopped), start, end))
                start = None
            if start is None:
                start = int(row.frame_index)
            stopped, end = bool(now), int(row.frame_index)
        state.update((stopped, start, end))
        yield pd.DataFrame(out, columns=["video_id", "stopped", "start_frame", "end_frame"])

    return frames.groupBy("video_id").applyInPandasWithState(
        step,
        "video_id bigint, stopped boolean, start_frame int, end_frame int",
        "stopped boolean, start int, end int",
        "append",
        GroupStateTimeout.NoTimeout,
    )
