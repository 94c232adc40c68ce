"""Summaries of objects in segments, of classes and of stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trackloom.functions import bands
from trackloom.operators.ordered import by_step, previous


def segment_objects(motion: DataFrame, segment: Sequence[str], length: int) -> DataFrame:
    """One row per object in a segment: visibility, distances, speed, states, consistency and distance rank."""
    keys = [*segment, "track_id"]
    moved = by_step(keys, "frame_index", 4096).scan(motion, before=previous(F.col("frame_index")))
    hop = F.col("frame_index") - F.col("before")
    agg = moved.groupBy(*keys).agg(
        F.count("*").alias("seen"),
        F.avg("z").alias("mean_z"),
        F.min("z").alias("min_z"),
        F.max("z").alias("max_z"),
        F.avg("rel_speed").alias("mean_speed"),
        F.avg("score").alias("mean_score"),
        F.avg((hop == 1).cast("double")).alias("consecutive"),
    )
    visible = F.col("seen") / F.lit(float(length))
    # the objects of one segment are a bounded group
    nearest = W.partitionBy(*segment).orderBy(F.round("min_z", 9), "track_id")
    return (
        agg.withColumn("visibility", visible)
        .withColumn("distance_state", bands.distance_state(F.col("mean_z")))
        .withColumn("speed_state", bands.speed_state(F.col("mean_speed"), F.lit(True)))
        .withColumn("consistency", F.when(F.col("seen") == 1, visible).otherwise((visible + F.col("consecutive")) / 2))
        .withColumn("distance_rank", F.row_number().over(nearest))
    )


def majority(df: DataFrame, keys: Sequence[str], label: str, order: str) -> DataFrame:
    """Most frequent label of each group, the first seen one on a tie; counted per label before the choice."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(
        F.max_by(label, F.struct("n", -F.col("first"))).alias("majority"), F.max("n").alias("votes")
    )


def distinct_counts(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Rows and distinct values of several columns per key, each counted over its own distinct pairs."""
    out = df.groupBy(key).agg(F.count("*").alias("rows"))
    for name, column in columns.items():
        pairs = df.select(key, column.alias("__v")).distinct()
        out = out.join(pairs.groupBy(key).agg(F.count("__v").alias(name)), key)
    return out


def stage_funnel(stages: dict[str, DataFrame], key: str, names: Sequence[str]) -> DataFrame:
    """Counts per class at every stage, one column each."""
    parts = [df.groupBy(key).agg(F.count("*").alias("n")).withColumn("stage", F.lit(s)) for s, df in stages.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).pivot("stage", list(names)).agg(F.sum("n")).na.fill(0)
