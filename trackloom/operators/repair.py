"""Repair of tracks: safe gap filling, smoothing and selection under budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import geometry
from trackloom.operators.lineage import checkpointed
from trackloom.operators.ordered import by_step, near, row_number

TRACK = ["video_id", "track_id"]
BOX = ["x1", "y1", "x2", "y2"]

# Fixed values
GAP_RULES = {
    "max_gap_frames": 2,
    "min_endpoint_score": 0.2,
    "max_center_step_fraction_of_diag": 0.55,
    "max_center_step_px": 120.0,
    "max_size_ratio": 1.45,
    "max_velocity_delta_fraction_of_diag": 0.45,
    "max_velocity_delta_px": 90.0,
    "conflict_iou_threshold": 0.25,
}
FILLED_SCORE = 0.95


def gap_decisions(boxes: DataFrame, rules: dict | None = None) -> DataFrame:
    """Every gap of every track with the first reason not to fill it, empty when it may be filled.

    ``boxes``: video_id, track_id, frame_index, label, score, x1, y1, x2, y2.  Overlaps are judged later.
    """
    g = {**GAP_RULES, **(rules or {})}
    cols = ["frame_index", "label", "score", *BOX]
    dense = by_step(TRACK, "frame_index", 8192).scan(boxes, __at=row_number())
    seen = near(
        dense,
        TRACK,
        "__at",
        2,
        next=lambda w: F.lead(F.struct(*cols)).over(w),
        before=lambda w: F.lag(F.struct(*cols)).over(w),
        after=lambda w: F.lead(F.struct(*cols), 2).over(w),
    )
    here = F.struct(*cols)
    gaps = seen.withColumn("here", here).filter(F.col("next.frame_index") - F.col("frame_index") > 1)
    part = lambda s: [F.col(f"{s}.{c}") for c in BOX]
    centre = lambda s: geometry.center(part(s))
    hop = lambda a, b: F.greatest(F.lit(1), F.col(f"{b}.frame_index") - F.col(f"{a}.frame_index"))
    speed = lambda a, b: [(q - p) / hop(a, b) for p, q in zip(centre(a), centre(b))]
    change = lambda u, v: geometry.norm(u[0] - v[0], u[1] - v[1])
    ratio = lambda f: F.greatest(f(part("here")), f(part("next"))) / F.greatest(F.lit(1e-6), F.least(f(part("here")), f(part("next"))))
    diagonal = F.greatest(F.lit(1.0), (geometry.diagonal(part("here")) + geometry.diagonal(part("next"))) / 2)
    limit = lambda px, share: F.least(F.lit(g[px]), g[share] * diagonal)
    size = F.col("next.frame_index") - F.col("frame_index") - 1
    through = speed("here", "next")
    rough = limit("max_velocity_delta_px", "max_velocity_delta_fraction_of_diag")
    tests = [
        ("gap_length", size > g["max_gap_frames"]),
        ("label_mismatch", F.col("label") != F.col("next.label")),
        ("low_endpoint_score", F.least("score", "next.score") < g["min_endpoint_score"]),
        ("box_scale_change", (ratio(geometry.width) > g["max_size_ratio"]) | (ratio(geometry.height) > g["max_size_ratio"])),
        ("center_motion_too_large", geometry.norm(*through) > limit("max_center_step_px", "max_center_step_fraction_of_diag")),
        ("incoming_motion_not_smooth", (F.col("before.label") == F.col("label")) & (change(speed("before", "here"), through) > rough)),
        ("outgoing_motion_not_smooth", (F.col("after.label") == F.col("next.label")) & (change(through, speed("next", "after")) > rough)),
    ]
    reason = F.lit("")
    for name, fails in reversed(tests):
        reason = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(reason)
    return gaps.select(*TRACK, F.col("frame_index").alias("gap_start"), "here", "next", size.alias("gap_size"), reason.alias("reason"))


def _proposed(gaps: DataFrame) -> DataFrame:
    inner = F.sequence(F.col("gap_start") + 1, F.col("next.frame_index") - 1)
    share = (F.col("f") - F.col("gap_start")) / (F.col("gap_size") + 1)
    blend = lambda c: F.col(f"here.{c}") + (F.col(f"next.{c}") - F.col(f"here.{c}")) * share
    rows = gaps.withColumn("f", F.explode(inner))
    return rows.select(
        *TRACK,
        "gap_start",
        F.col("f").cast("int").alias("frame_index"),
        F.col("here.label").alias("label"),
        (F.least("here.score", "next.score") * FILLED_SCORE).alias("score"),
        *[blend(c).alias(c) for c in BOX],
    )


def fill_gaps(boxes: DataFrame, rules: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows filled into short safe gaps, and every gap with its decision.

    A fill must not overlap a box of its frame, nor a fill accepted for an earlier track.  Fills that collide are
    settled in track order: a gap is decided once no earlier undecided gap collides with it, so few rounds suffice
    and each works on the colliding gaps only.
    """
    limit = {**GAP_RULES, **(rules or {})}["conflict_iou_threshold"]
    decided = checkpointed(gap_decisions(boxes, rules))
    fills = checkpointed(_proposed(decided.filter("reason = ''")))
    key = [*TRACK, "gap_start"]
    theirs = boxes.select("video_id", "frame_index", *[F.col(c).alias(f"o_{c}") for c in BOX])
    overlap = geometry.iou(geometry.box(), geometry.box("o_")) >= limit
    blocked = fills.join(theirs, ["video_id", "frame_index"]).filter(overlap).select(*key).distinct()
    free = fills.join(blocked, key, "left_anti")
    earlier = free.select("video_id", "frame_index", F.col("track_id").alias("o_track"), F.col("gap_start").alias("o_start"), *[F.col(c).alias(f"o_{c}") for c in BOX])
    edges = checkpointed(
        free.join(earlier, ["video_id", "frame_index"])
        .filter((F.col("o_track") < F.col("track_id")) & overlap)
        .select(*key, "o_track", "o_start")
        .distinct()
    )
    rejected = blocked
    as_other = lambda df: df.select("video_id", F.col("track_id").alias("o_track"), F.col("gap_start").alias("o_start"))
    open_edges = edges
    while not open_edges.isEmpty():
        waiting = open_edges.select(*key).distinct()
        # an edge whose earlier gap waits for nobody is settled: that gap is accepted, the later one falls
        settled = open_edges.join(as_other(waiting), ["video_id", "o_track", "o_start"], "left_anti")
        fallen = checkpointed(settled.select(*key).distinct())
        rejected = rejected.unionByName(fallen)
        open_edges = checkpointed(
            open_edges.join(fallen, key, "left_anti").join(as_other(fallen), ["video_id", "o_track", "o_start"], "left_anti")
        )
    rejected = rejected.distinct()
    report = decided.join(rejected.withColumn("hit", F.lit(True)), key, "left").select(
        *key, "gap_size", F.when(F.col("hit"), "overlap_conflict").otherwise(F.col("reason")).alias("reason")
    )
    return fills.join(rejected, key, "left_anti"), report


def two_way_smoothing(df: DataFrame, keys: Sequence[str], position: str, value: str, alpha: float, tolerance: float = 1e-12) -> DataFrame:
    """Mean of a forward exponential pass and of a backward pass over its result.

    Weights fall by (1 - alpha) per step, so a value further away than ``reach`` adds less than the tolerance of its
    size; both passes are bounded windows, and the first and last value carry the rest of the weight.
    """
    import math

    reach = max(1, math.ceil(math.log(tolerance) / math.log(1.0 - alpha))) if alpha < 1 else 1

    def fold(values: Column) -> Column:
        return F.aggregate(
            F.slice(values, 2, reach + 1), F.element_at(values, 1), lambda acc, v: F.lit(alpha) * v + F.lit(1 - alpha) * acc
        )

    forward = near(df, keys, position, reach, fw=lambda w: fold(F.collect_list(value).over(w.rowsBetween(-reach, 0))))
    both = near(
        forward, keys, position, reach, bw=lambda w: fold(F.reverse(F.collect_list("fw").over(w.rowsBetween(0, reach))))
    )
    return both.withColumn("smoothed", (F.col("fw") + F.col("bw")) / 2).drop("fw", "bw")


def budgeted_objects(objects: DataFrame, segment: Sequence[str], most: int, per_class: int, per_prior: int, least: float) -> DataFrame:
    """Objects of a segment taken by score under a total, a class and a prior budget, with the reason of a refusal.

    ``objects``: object_id, cls, prior, score.  The budgets depend on what was taken before, so the objects of one
    segment (a bounded group) are folded in order inside a row.
    """
    order = F.struct((-F.col("score")).alias("k"), "object_id", "cls", "prior", "score")
    lists = objects.groupBy(*segment).agg(F.array_sort(F.collect_list(order)).alias("rows"))
    id_type = objects.schema["object_id"].dataType.simpleString()
    kind = f"array<struct<object_id:{id_type},cls:string,prior:string,score:double,reason:string>>"

    def take(done: Column, row: Column) -> Column:
        taken = F.filter(done, lambda d: d["reason"] == "")
        same = lambda field: F.size(F.filter(taken, lambda d: d[field] == row[field]))
        reason = (
            F.when(row["score"] < least, "below_candidate_selection_score")
            .when(F.size(taken) >= most, "segment_candidate_budget_exceeded")
            .when(same("cls") >= per_class, "class_candidate_budget_exceeded")
            .when(same("prior") >= per_prior, "prior_candidate_budget_exceeded")
            .otherwise("")
        )
        entry = F.struct(row["object_id"].alias("object_id"), row["cls"].alias("cls"), row["prior"].alias("prior"), row["score"].alias("score"), reason.alias("reason"))
        return F.concat(done, F.array(entry).cast(kind))

    chosen = lists.select(*segment, F.explode(F.aggregate("rows", F.array().cast(kind), take)).alias("r"))
    return chosen.select(*segment, "r.*")
