"""Stream results equal batch results; files come back as written."""

import json

from pyspark.sql import functions as F

from trackloom.sources import readers, stores
from trackloom.streaming import monitor

EVENTS = "/root/testdata/sf0.001/events.parquet"


def replay(spark, tmp_path, df, order, build, parts=3):
    """Write rows in time order as files, stream them one by one and collect the sink."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df = df.cache()
    low, high = df.agg(F.min(order).cast("double"), F.max(order).cast("double")).collect()[0]
    for i in range(parts):
        a, b = low + (high - low) * i / parts, low + (high - low) * (i + 1) / parts
        inside = (F.col(order).cast("double") >= a) & ((F.col(order).cast("double") < b) | F.lit(i == parts - 1))
        df.filter(inside).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        build(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    df.unpersist()
    return spark.read.parquet(sink)


def test_interval_report_stream(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    build = lambda df: monitor.interval_report(df, "ts", "1 day", F.col("event_type") == "error", F.col("value"), "1 hour")
    want = {r.interval_start: r.events for r in build(events).collect()}
    got = {r.interval_start: r.events for r in replay(spark, tmp_path, events, "ts", build).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(want) - len(got) <= 2  # the last intervals are still open


def test_track_velocity_stream(spark, tmp_path):
    rows = [(v, k, f, float(f * f), float(v)) for v in range(3) for k in range(2) for f in (0, 1, 3, 4, 8)]
    df = spark.createDataFrame(rows, "video_id bigint, track_id bigint, frame_index int, x double, z double")
    got = {(r.video_id, r.track_id, r.frame_index): r.obj_vx for r in replay(spark, tmp_path, df, "frame_index", monitor.track_velocity).collect()}
    assert len(got) == len(rows)
    assert got[0, 0, 0] == 0.0 and got[1, 1, 3] == 4.0 and got[2, 0, 8] == 12.0


def test_runs_close_in_stream(spark, tmp_path):
    speeds = [9, 9, 1, 2, 3, 9, 9, 1, 1, 9]
    df = spark.createDataFrame([(7, i, float(s)) for i, s in enumerate(speeds)], "video_id bigint, frame_index int, speed double")
    got = replay(spark, tmp_path, df, "frame_index", lambda s: monitor.closing_runs(s, 1.0, 3.0)).collect()
    assert sorted((r.start_frame, r.end_frame, r.stopped) for r in got) == [(0, 1, False), (2, 4, True), (5, 6, False), (7, 8, True)]


def test_annotation_round_trip(spark, tmp_path):
    document = {
        "schema_version": 1, "annotator": "x", "video": {"id": None, "fps": 5.0, "frame_count": 20},
        "keyframes": [{"frame": 0, "timestamp": 0.0, "label": "forward"}],
        "segments": [{"start_frame": 0, "end_frame": 9, "label": "forward"}, {"start_frame": 10, "end_frame": 19, "label": "left"}],
    }
    (tmp_path / "clip_a.json").write_text(json.dumps(document, indent=1))
    got = readers.read_annotations(spark, str(tmp_path)).collect()
    assert [(r.video_id, r.start_frame, r.end_frame, r.label) for r in got] == [("clip_a", 0, 9, "forward"), ("clip_a", 10, 19, "left")]


def test_prediction_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"video_id": "a", "segments": [{"start": 0, "end": 3, "event": "left"}]}))
    labels = [{"frame_index": i, "label": "forward" if i < 2 else "static"} for i in range(4)]
    (tmp_path / "b.json").write_text(json.dumps({"video_id": "b", "frame_labels": labels}))
    got = sorted(map(tuple, readers.read_predictions(spark, str(tmp_path)).collect()))
    assert got == [("a", 0, 3, "left"), ("b", 0, 1, "forward"), ("b", 2, 3, "static")]


def test_labels_without_frames_are_left_out(spark, tmp_path):
    (tmp_path / "l.csv").write_text("videoName,frameIndex,x1,y1,x2,y2,category,id\nv,0,1,2,3,4,Car,7\nv,,1,2,3,4,Car,8\nv,5,1,2,3,x,Bus,9\n")
    frames = spark.createDataFrame([("v", 0), ("v", 5)], "video_id string, frame_index int")
    got = sorted((r.frame_index, r.label, r.y2, r.track_id) for r in readers.read_labels(spark, str(tmp_path / "l.csv"), frames).collect())
    assert got == [(0, "car", 4.0, 7), (5, "bus", None, 9)]


def test_stored_results_are_reused(spark, tmp_path):
    path, config = str(tmp_path / "results"), {"window": 5}
    rows = spark.createDataFrame([(1, 0.5), (2, 0.7)], "video_id int, score double")
    stores.write_results(rows, path, config, 1)
    videos = spark.createDataFrame([(1,), (2,), (3,)], "video_id int")
    stored = stores.manifest(stores.read_results(spark, path))
    assert [r.video_id for r in stores.pending(videos, stored, config, 1).collect()] == [3]
    assert stores.pending(videos, stored, config, 2).count() == 3


def test_scene_tables(spark, tmp_path):
    data = {
        "scene": [{"token": "s", "name": "one"}], "sample": [{"token": "p1", "scene_token": "s", "timestamp": 5}],
        "sample_annotation": [{"token": "a", "sample_token": "p1", "instance_token": "i", "visibility_token": "1", "attribute_tokens": ["t2", "t1"]}],
        "sample_data": [
            {"token": "d1", "sample_token": "p1", "calibrated_sensor_token": "c1", "ego_pose_token": "e"},
            {"token": "d2", "sample_token": "p1", "calibrated_sensor_token": "c2", "ego_pose_token": "e"},
        ],
        "instance": [{"token": "i", "category_token": "k"}], "category": [{"token": "k", "name": "car"}],
        "attribute": [{"token": "t1", "name": "moving"}, {"token": "t2", "name": "parked"}], "visibility": [{"token": "1", "level": "v0-40"}],
        "calibrated_sensor": [{"token": "c1", "sensor_token": "n1"}, {"token": "c2", "sensor_token": "n2"}],
        "sensor": [{"token": "n1", "channel": "CAM_FRONT"}, {"token": "n2", "channel": "LIDAR_TOP"}],
        "ego_pose": [{"token": "e", "translation": [0.0, 0.0, 0.0], "rotation": [1.0, 0.0, 0.0, 0.0]}],
    }
    for name, rows in data.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    tables = readers.read_scene_tables(spark, str(tmp_path))
    record = readers.annotation_records(tables).collect()[0]
    assert (record.category, record.visibility, record.attributes) == ("car", "v0-40", ["moving", "parked"])
    media = readers.media_records(tables, ["LIDAR_TOP", "CAM_FRONT"]).collect()
    assert [m.channel for m in media] == ["LIDAR_TOP"]
