"""Joins on frames, segments, time and pairs, each on keys that keep a long video spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import norm
from trackloom.operators.ordered import Ordered, carried, upcoming

BLOCK = 512


def frames_to_segments(frames: DataFrame, segments: DataFrame, keys: Sequence[str], frame: str, block: int = BLOCK) -> DataFrame:
    """Rows with the segment [start_frame, end_frame] that encloses their frame.

    Segments are listed under every block of frames they touch, so rows meet on (key, block) and a long video
    is many join keys.
    """
    keys = list(keys)
    at = lambda c: F.floor(F.col(c) / F.lit(block))
    listed = segments.withColumn("__block", F.explode(F.sequence(at("start_frame"), at("end_frame"))))
    return (
        frames.withColumn("__block", at(frame))
        .join(listed, [*keys, "__block"])
        .filter(F.col(frame).between(F.col("start_frame"), F.col("end_frame")))
        .drop("__block")
    )


def overlapping_segments(a: DataFrame, b: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Pairs of segments of two tables that share frames, with the shared frames and temporal IoU.

    ``a`` has (a_start, a_end), ``b`` has (b_start, b_end).  A pair is reported once, in the block of its overlap's
    first frame.
    """
    keys = list(keys)
    listed = lambda df, p: df.withColumn(
        "__block", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / block), F.floor(F.col(f"{p}_end") / block)))
    )
    first = F.greatest("a_start", "b_start")
    shared = F.least("a_end", "b_end") - first + 1
    both = listed(a, "a").join(listed(b, "b"), [*keys, "__block"])
    lengths = (F.col("a_end") - F.col("a_start") + 1) + (F.col("b_end") - F.col("b_start") + 1)
    return (
        both.filter((shared > 0) & (F.floor(first / F.lit(block)) == F.col("__block")))
        .withColumn("shared", shared)
        .withColumn("iou", F.col("shared") / (lengths - F.col("shared")))
        .drop("__block")
    )


def nearest_in_time(probes: DataFrame, rows: DataFrame, keys: Sequence[str], time: str, value: str, chunk: int) -> DataFrame:
    """Each probe with the value of the nearest row in time (the earlier one on a tie).

    Probes and rows are one ordered sequence; the neighbours come from carried values, not from a range join.
    """
    keys = list(keys)
    tagged = probes.select(*keys, time, F.lit(1).alias("probe"), F.lit(None).cast(rows.schema[value].dataType).alias(value))
    tagged = tagged.unionByName(rows.select(*keys, time, F.lit(0).alias("probe"), value))
    seen = F.when(F.col("probe") == 0, F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    order = Ordered(keys, [time, "probe"], F.floor(F.col(time) / F.lit(chunk)))
    placed = order.scan(tagged, back=carried(seen), ahead=upcoming(seen)).filter("probe = 1")
    to_back, to_ahead = F.col(time) - F.col("back.t"), F.col("ahead.t") - F.col(time)
    use_back = F.col("ahead.t").isNull() | (to_back <= to_ahead)
    return placed.select(
        *keys,
        time,
        F.when(use_back, F.col("back.t")).otherwise(F.col("ahead.t")).alias("source_time"),
        F.when(use_back, F.col("back.v")).otherwise(F.col("ahead.v")).alias(value),
    )


def interpolated(probes: DataFrame, rows: DataFrame, keys: Sequence[str], frame: str, values: Sequence[str], max_gap: int, span: int = 8192) -> DataFrame:
    """Values at probe frames blended linearly between the rows around them, when those are close enough."""
    keys = list(keys)
    types = {v: rows.schema[v].dataType for v in values}
    tagged = probes.select(*keys, frame, F.lit(1).alias("probe"), *[F.lit(None).cast(t).alias(v) for v, t in types.items()])
    tagged = tagged.unionByName(rows.select(*keys, frame, F.lit(0).alias("probe"), *values))
    seen = F.when(F.col("probe") == 0, F.struct(F.col(frame).alias("t"), *values))
    # an observation of the probe's own frame comes before it in the order, so it is carried
    order = Ordered(keys, [frame, "probe"], F.floor(F.col(frame) / F.lit(span)))
    placed = order.scan(tagged, back=carried(seen), ahead=upcoming(seen)).filter("probe = 1")
    width = F.col("ahead.t") - F.col("back.t")
    share = (F.col(frame) - F.col("back.t")) / width
    exact = F.col("back.t") == F.col(frame)
    blend = lambda v: F.when(exact, F.col(f"back.{v}")).when(
        width <= max_gap, F.col(f"back.{v}") + (F.col(f"ahead.{v}") - F.col(f"back.{v}")) * share
    )
    return placed.select(*keys, frame, *[blend(v).alias(v) for v in values])


def frame_pairs(objects: DataFrame, frame_keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pairs (a_, b_) of objects seen in the same frame, the smaller track id first; both sides come from the same
    frame, so the work is bounded by the objects one frame can hold."""
    keys = list(frame_keys)
    side = lambda p: objects.select(*keys, F.col("track_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return side("a").join(side("b"), keys).filter("a_id < b_id")


def pair_statistics(pairs: DataFrame, near_limit: float) -> DataFrame:
    """Distance, proximity and velocity correlation of object pairs, and how often a near pair moves apart."""
    dx, dz = F.col("b_x") - F.col("a_x"), F.col("b_z") - F.col("a_z")
    distance = norm(dx, dz)
    speed = norm(F.col("a_vx"), F.col("a_vz"))
    away = (F.col("a_vx") * dx + F.col("a_vz") * dz) / (speed * distance)
    is_near = distance < near_limit
    return pairs.groupBy("video_id", "a_id", "b_id").agg(
        F.count("*").alias("frames"),
        F.avg(distance).alias("mean_distance"),
        F.avg(is_near.cast("double")).alias("proximity"),
        F.when(F.count("*") >= 3, F.corr("a_vx", "b_vx")).alias("corr_x"),
        F.when(F.count("*") >= 3, F.corr("a_vz", "b_vz")).alias("corr_z"),
        F.count_if(is_near).alias("near_frames"),
        F.count_if(is_near & (speed > 0) & (distance > 0) & (away < -0.3)).alias("avoiding_frames"),
    )


def track_overlaps(boxes: DataFrame, frame_keys: Sequence[str], iou: Column, sizes: DataFrame) -> DataFrame:
    """Shared frames, mean and largest IoU and the overlap score of two tracks."""
    per_pair = boxes.groupBy("video_id", "a_id", "b_id").agg(
        F.count("*").alias("shared"), F.avg(iou).alias("mean_iou"), F.max(iou).alias("max_iou")
    )
    size = lambda p: sizes.select("video_id", F.col("track_id").alias(f"{p}_id"), F.col("n").alias(f"{p}_n"))
    share = F.col("shared") / F.greatest(F.lit(1), F.least("a_n", "b_n"))
    return (
        per_pair.join(size("a"), ["video_id", "a_id"])
        .join(size("b"), ["video_id", "b_id"])
        .withColumn("shared_ratio", share)
        .withColumn("overlap_score", F.col("mean_iou") * share)
    )


def full_timeline(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with where each row came from."""
    l, r = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    both = l.join(r, list(keys), "full_outer")
    origin = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both")
    return both.withColumn("origin", origin).drop("__l", "__r")


def first_matching_rule(rows: DataFrame, conditions: Sequence[tuple[str, Column]], default: str) -> DataFrame:
    """Name of the first condition that holds; the rules are a fixed ordered list, so no join is needed."""
    name = F.lit(default)
    for label, condition in reversed(list(conditions)):
        name = F.when(F.coalesce(condition, F.lit(False)), label).otherwise(name)
    return rows.withColumn("cohort", name)


OPERATORS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a.isin(list(b)),
}


def compile_conditions(rules: Sequence[dict], allowed: Sequence[str]) -> list[tuple[str, Column]]:
    """Cohort rules given as documents to named conditions; unknown attributes and operators are refused."""
    out = []
    for rule in rules:
        condition = F.lit(True)
        for c in rule["conditions"]:
            if c["attribute"] not in allowed or c["operator"] not in OPERATORS:
                raise ValueError(f"cohort rule {rule['name']} uses an unknown attribute or operator")
            condition = condition & OPERATORS[c["operator"]](F.col(c["attribute"]), c["value"])
        out.append((rule["name"], condition))
    return out
