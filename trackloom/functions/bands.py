"""Values to named states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
NEAR_LIMIT, MEDIUM_LIMIT = 15.0, 30.0
SIDE_LIMIT = 2.0
VX_LIMIT, VZ_LIMIT, SPEED_LIMIT = 0.2, 0.2, 0.3
SCORE_HIGH, SCORE_MEDIUM = 0.67, 0.34
QUALITY_RANKS = {
    "accepted_high_confidence": 0,
    "nms_relaxed_candidate": 1,
    "borderline_confidence": 2,
    "low_confidence": 3,
    "discarded_detector_output": 4,
    "candidate": 5,
}
UNKNOWN_QUALITY_RANK = 9


def three_way(value: Column, limit, low: str, middle: str, high: str) -> Column:
    """Strictly below -limit, strictly above limit, or in between."""
    return F.when(value < -limit, low).when(value > limit, high).otherwise(middle)


def distance_state(z: Column, near: float = NEAR_LIMIT, medium: float = MEDIUM_LIMIT) -> Column:
    return F.when(z <= near, "near").when(z <= medium, "medium").otherwise("far")


def position_x_state(x: Column, limit: float = SIDE_LIMIT) -> Column:
    return three_way(x, limit, "left_of_ego", "centered", "right_of_ego")


def vz_state(v: Column, known: Column) -> Column:
    return F.when(~known, "vz_unknown").otherwise(three_way(v, VZ_LIMIT, "vz_approaching", "vz_stable", "vz_awaying"))


def vx_state(v: Column, known: Column) -> Column:
    return F.when(~known, "vx_unknown").otherwise(
        three_way(v, VX_LIMIT, "vx_turning_left", "vx_stable", "vx_turning_right")
    )


def speed_state(v: Column, known: Column) -> Column:
    return F.when(~known, "speed_unknown").when(v > SPEED_LIMIT, "rel_moving").otherwise("rel_static")


def score_state(v: Column, high: float = SCORE_HIGH, medium: float = SCORE_MEDIUM) -> Column:
    return F.when(v >= high, "high").when(v >= medium, "medium").otherwise("low")


def visibility_state(ratio: Column, persistent: float, present: float) -> Column:
    return F.when(ratio >= persistent, "persistent").when(ratio >= present, "intermittent").otherwise("brief")


def severity(normalized: Column, hard: Column, conflict_limit: float, hard_limit: float) -> Column:
    return (
        F.when(normalized.isNull(), "info")
        .when(hard & (normalized >= hard_limit), "hard_violation")
        .when(normalized >= conflict_limit, "violation")
        .when(normalized >= 1.0, "warning")
        .otherwise("info")
    )


def quality_bucket(accepted: Column, candidate_source: Column) -> Column:
    return F.when(accepted, "accepted_high_confidence").otherwise(F.coalesce(candidate_source, F.lit("candidate")))


def quality_rank(bucket: Column) -> Column:
    out = F.lit(UNKNOWN_QUALITY_RANK)
    for name, rank in QUALITY_RANKS.items():
        out = F.when(bucket == name, rank).otherwise(out)
    return out


def driving_mode(stopped: Column, turning: Column) -> Column:
    return F.when(stopped, 1).when(turning, 2).otherwise(0)


def relabel_confidence(run_length: Column, offset: Column, long_length: int) -> Column:
    """One at the edges of a relabelled run, lowest in its middle, deeper for longer runs."""
    length = F.greatest(F.lit(1), run_length)
    at = F.least(F.greatest(F.lit(0), offset), length - 1)
    depth = F.least(F.lit(1.0), length / F.lit(max(1, long_length)))
    to_edge = F.least(at, length - 1 - at)
    middle = F.greatest(F.lit(1), F.floor((length - 1) / 2))
    shape = F.when(length <= 2, 1.0).otherwise(F.least(F.lit(1.0), to_edge / middle))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - depth * shape))
