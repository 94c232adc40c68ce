"""Readers that bring stored label, scene, annotation and prediction files to row tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_COLUMNS = "videoName string, frameIndex string, x1 string, y1 string, x2 string, y2 string, category string, id string"
SCENE_TABLES = [
    "scene",
    "sample",
    "sample_annotation",
    "sample_data",
    "instance",
    "category",
    "attribute",
    "visibility",
    "calibrated_sensor",
    "sensor",
    "ego_pose",
]
ANNOTATION = """schema_version int, annotator string,
 video struct<id:string,path:string,fps:double,frame_count:int,duration_seconds:double>,
 keyframes array<struct<frame:int,timestamp:double,label:string>>,
 segments array<struct<start_frame:int,end_frame:int,label:string>>"""
PREDICTION = """video_id string, num_frames int,
 segments array<struct<start_frame:int,end_frame:int,start:int,end:int,label:string,event:string>>,
 frame_labels array<struct<frame_index:int,label:string>>"""


def read_labels(spark: SparkSession, path: str, frames: DataFrame | None = None) -> DataFrame:
    """Object boxes from CSV; rows of frames that do not exist are left out."""
    raw = spark.read.csv(path, header=True, schema=LABEL_COLUMNS)
    number = lambda c: F.col(c).try_cast("double")
    rows = raw.select(
        F.col("videoName").alias("video_id"),
        F.col("frameIndex").try_cast("int").alias("frame_index"),
        *[number(c).alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.lower(F.trim("category")).alias("label"),
        F.col("id").try_cast("bigint").alias("track_id"),
    ).filter("frame_index is not null")
    return rows if frames is None else rows.join(frames, ["video_id", "frame_index"], "left_semi")


def read_scene_tables(spark: SparkSession, folder: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The keyed JSON tables of a multi-sensor scene data set, each also a temporary view."""
    tables = {}
    for name in SCENE_TABLES:
        reader = spark.read
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        tables[name] = reader.json(f"{folder}/{name}.json", multiLine=True)
        tables[name].createOrReplaceTempView(name)
    return tables


def ordered_samples(samples: DataFrame, most: int | None = None) -> DataFrame:
    """Samples of each scene by time, which is the order of their linked list."""
    from trackloom.operators.ordered import Ordered, row_number

    order = Ordered(["scene_token"], ["timestamp", "token"], F.floor(F.col("timestamp") / 60_000_000))
    placed = order.scan(samples, position=row_number())
    return placed if most is None else placed.filter(F.col("position") <= most)


def annotation_records(t: dict[str, DataFrame]) -> DataFrame:
    """Annotations with category, visibility and the names of their attributes.

    The lookup tables are joined by token; Spark broadcasts those it finds small.  Attribute names are gathered per
    annotation, which holds a handful.
    """
    key = lambda df, name, *cols: df.select(F.col("token").alias(f"{name}_token"), *cols)
    names = (
        t["sample_annotation"]
        .select(F.col("token"), F.explode("attribute_tokens").alias("attribute_token"))
        .join(key(t["attribute"], "attribute", F.col("name").alias("attribute")), "attribute_token")
        .groupBy("token")
        .agg(F.array_sort(F.collect_list("attribute")).alias("attributes"))
    )
    return (
        t["sample_annotation"]
        .drop("attribute_tokens")
        .join(key(t["instance"], "instance", F.col("category_token")), "instance_token")
        .join(key(t["category"], "category", F.col("name").alias("category")), "category_token")
        .join(key(t["visibility"], "visibility", F.col("level").alias("visibility")), "visibility_token", "left")
        .join(names, "token", "left")
    )


def media_records(t: dict[str, DataFrame], priority: Sequence[str]) -> DataFrame:
    """One sensor record per sample, the first channel in the given order, with its pose."""
    from trackloom.operators.selection import best_in_group

    channel = t["calibrated_sensor"].select(F.col("token").alias("calibrated_sensor_token"), "sensor_token").join(
        t["sensor"].select(F.col("token").alias("sensor_token"), "channel"), "sensor_token"
    )
    pose = t["ego_pose"].select(F.col("token").alias("ego_pose_token"), "translation", "rotation")
    joined = t["sample_data"].join(channel, "calibrated_sensor_token").join(pose, "ego_pose_token")
    rank = F.lit(len(priority))
    for i, name in reversed(list(enumerate(priority))):
        rank = F.when(F.col("channel") == name, i).otherwise(rank)
    return best_in_group(joined, ["sample_token"], [rank, F.col("token")], 1).drop("rank_in_group")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Human segments, one row each; the file name stands in for a missing video id."""
    raw = spark.read.schema(ANNOTATION).json(path, multiLine=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return raw.select(
        F.coalesce(F.col("video.id"), name).alias("video_id"),
        F.col("video.frame_count").alias("num_frames"),
        F.posexplode("segments").alias("segment_index", "s"),
    ).select("video_id", "num_frames", "segment_index", "s.start_frame", "s.end_frame", "s.label")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predicted segments from files that hold segments or frame labels, under one schema."""
    from trackloom.operators.ordered import runs

    raw = spark.read.schema(PREDICTION).json(path, multiLine=True)
    listed = raw.filter("segments is not null").select("video_id", F.explode("segments").alias("s")).select(
        "video_id",
        F.coalesce("s.start_frame", "s.start").alias("start_frame"),
        F.coalesce("s.end_frame", "s.end").alias("end_frame"),
        F.coalesce("s.label", "s.event").alias("label"),
    )
    frames = raw.filter("segments is null and frame_labels is not null").select("video_id", F.explode("frame_labels").alias("f"))
    built = runs(frames.select("video_id", "f.frame_index", "f.label"), ["video_id"], "frame_index", "label", contiguous=True)
    return listed.unionByName(built.select("video_id", "start_frame", "end_frame", "label"))


def flatten_frames(frames: DataFrame, repaired: Column | None = None) -> DataFrame:
    """One row per object from frames with parallel arrays; of two rows of a track in a frame the repaired one stays."""
    from trackloom.operators.selection import best_in_group

    zipped = F.arrays_zip("boxes", "scores", "labels", "track_ids", "positions_3d")
    rows = frames.select("video_id", "frame_index", F.posexplode(zipped).alias("object_index", "o")).select(
        "video_id",
        "frame_index",
        "object_index",
        F.col("o.track_ids").alias("track_id"),
        F.col("o.labels").alias("label"),
        F.col("o.scores").alias("score"),
        F.col("o.boxes").alias("box"),
        F.col("o.positions_3d").alias("position"),
    )
    order = ([repaired.desc()] if repaired is not None else []) + [F.col("object_index")]
    return best_in_group(rows, ["video_id", "frame_index", "track_id"], order, 1).drop("rank_in_group")


def in_manifest_order(videos: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Videos listed in a manifest (video_id, position) and the listed ones that are missing."""
    present = videos.join(manifest, "video_id")
    return present, manifest.join(videos.select("video_id"), "video_id", "left_anti")
