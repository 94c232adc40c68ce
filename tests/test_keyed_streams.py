"""Keyed state with timers: order of arrival, idle keys and replayed batches."""

import datetime as dt
import random

import pytest

from trackloom.streaming import keyed

START = dt.datetime(2024, 1, 1)
IDLE = 60_000


@pytest.fixture(scope="module")
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, keyed.STORE)
    yield
    spark.conf.set(name, before)


def stream(spark, tmp_path, batches, schema, build):
    """The rows of each batch as a file, read one by one."""
    source = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (
        build(frame).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def shuffled(rows, seed, size):
    """Rows in batches of about ``size`` seconds, mixed inside and a little across."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[-1] + dt.timedelta(seconds=rng.randrange(4)))
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_runs_with_silence_and_late_rows(spark, store, tmp_path):
    speeds = [9, 9, 1, 2, 3, 9, 9, 1, 1, 9]
    rows = [(7, i, float(s), at(i)) for i, s in enumerate(speeds)]
    rows += [(8, i, 1.0, at(i)) for i in range(5)] + [(8, i, 1.0, at(200 + i)) for i in range(10, 13)]
    # another video moves the time on, so that all others fall silent
    rows += [(9, i, 5.0, at(i)) for i in range(0, 600, 10)]
    schema = "video_id bigint, frame_index bigint, speed double, ts timestamp"
    got = stream(spark, tmp_path, shuffled(rows, 1, 12), schema, lambda df: keyed.closed_runs(df, "ts", "10 seconds", IDLE, 1.0, 3.0))
    want = [(7, False, 0, 1), (7, True, 2, 4), (7, False, 5, 6), (7, True, 7, 8), (7, False, 9, 9), (8, True, 0, 4), (8, True, 10, 12)]
    assert [r for r in got if r[0] != 9] == sorted(want)


def test_velocities_in_the_order_of_time(spark, store, tmp_path):
    rng = random.Random(2)
    rows, want = [], []
    for track in range(4):
        before = None
        for frame in sorted(rng.sample(range(40), 25)):
            x = rng.random()
            rows.append((1, track, frame, x, -x, at(frame)))
            v = 0.0 if before is None else (x - before[1]) / (frame - before[0])
            want.append((1, track, frame, round(v, 9), round(-v, 9), before is not None))
            before = (frame, x)
    rows += [(2, 0, f, 0.0, 0.0, at(f)) for f in range(100, 400, 50)]
    schema = "video_id bigint, track_id bigint, frame_index bigint, x double, z double, ts timestamp"
    got = stream(spark, tmp_path, shuffled(rows, 3, 25), schema, lambda df: keyed.velocities(df, "ts", "10 seconds", IDLE))
    assert [(*r[:3], round(r[3], 9), round(r[4], 9) + 0.0, r[5]) for r in got if r[0] == 1] == sorted(want)


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "predictions")
    write = keyed.store_batch(path)
    first = spark.createDataFrame([(1, 0.2), (1, 0.6), (2, 0.4)], "example_id bigint, confidence double")
    for batch, n in ((first, 0), (first, 0), (first.filter("example_id = 1").withColumn("confidence", first["confidence"] + 0.1), 1)):
        write(batch, n)
    assert spark.read.parquet(path).count() == 3
    assert sorted((r[0], round(r[1], 6)) for r in keyed.stored_predictions(spark, path).collect()) == [(1, 0.7), (2, 0.4)]
