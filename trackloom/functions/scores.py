"""Weighted scores of detections, objects and tracks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.numbers import settled

# Fixed values
SELECTION_WEIGHTS = {
    "calibrated_score": 0.30,
    "raw_score": 0.15,
    "track_quality": 0.20,
    "temporal_consistency": 0.15,
    "prior_relevance": 0.10,
    "semantic_relevance": 0.10,
}
TRACK_WEIGHTS = {"visual": 0.35, "prior": 0.2, "temporal": 0.2, "spatial": 0.2, "duplicate": 0.25}
GATE_WEIGHTS = {"visual": 0.45, "prior": 0.25, "priority": 0.15, "spatial": 0.1, "suppression": 0.35}
RELEVANCE_WEIGHTS = {"visibility": 0.3, "center": 0.2, "size_or_distance": 0.25, "front_center": 0.25}
RELEVANCE_HIGH, RELEVANCE_MEDIUM = 0.67, 0.4


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def weighted(weights: dict[str, float], **parts: Column) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * parts[name]
    return total


def selection_score(**parts: Column) -> Column:
    return weighted(SELECTION_WEIGHTS, **parts)


def gate_score(visual, prior, priority, plausible, suppression) -> Column:
    w = GATE_WEIGHTS
    return (
        w["visual"] * visual
        + w["prior"] * prior
        + w["priority"] * priority
        + w["spatial"] * F.when(plausible, 1.0).otherwise(0.0)
        - w["suppression"] * suppression
    )


def track_score(visual, prior, temporal, spatial, duplicate, cap: float = 1.0) -> Column:
    w = TRACK_WEIGHTS
    return (
        w["visual"] * visual
        + w["prior"] * prior
        + w["temporal"] * temporal
        + w["spatial"] * spatial
        - w["duplicate"] * F.least(duplicate, F.lit(cap))
    )


def control_relevance(
    visibility, mean_x, mean_z, mean_area, frame_center, center_limit: float = 3.0, far_limit: float = 40.0
) -> dict[str, Column]:
    """Relevance of a traffic-control object; the frame-centre score replaces the metric one when known."""
    center_score = 1.0 - clamp01(F.abs(mean_x) / center_limit)
    ahead = mean_z > 0
    distance_score = F.when(ahead, 1.0 - clamp01(mean_z / far_limit)).otherwise(0.0)
    area_score = F.when(mean_area > 0, clamp01(F.sqrt(mean_area) / 120.0)).otherwise(0.0)
    middle = F.greatest(center_score, F.coalesce(frame_center, center_score))
    size = F.greatest(area_score, distance_score)
    front = F.when(ahead, middle).otherwise(0.0)
    total = weighted(
        RELEVANCE_WEIGHTS, visibility=clamp01(visibility), center=middle, size_or_distance=size, front_center=front
    )
    score = clamp01(total / sum(RELEVANCE_WEIGHTS.values()))
    graded = settled(score, 9)
    label = F.when(graded >= RELEVANCE_HIGH, "high").when(graded >= RELEVANCE_MEDIUM, "medium").otherwise("low")
    return {"score": score, "label": label, "front_center": front >= 0.5}


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def observation_uncertainty(repaired, merged, has_motion, score) -> Column:
    return F.least(
        F.lit(1.0),
        F.when(repaired, 0.35).otherwise(0.0)
        + F.when(merged, 0.2).otherwise(0.0)
        + F.when(has_motion, 0.0).otherwise(0.25)
        + F.when(score > 0, 0.2 * F.greatest(F.lit(0.0), 1 - score)).otherwise(0.0),
    )
