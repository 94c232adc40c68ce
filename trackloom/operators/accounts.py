"""Counts, episodes and splits that account for what a run holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.bands import severity
from trackloom.operators.ordered import by_step, following, row_number, runs, total
from trackloom.operators.splits import hash_ranked

c = F.col


def violation_steps(rows: DataFrame, keys: Sequence[str], position: str, value: str, body: Column, head: Column) -> DataFrame:
    """Steps with a next observation: whether the body holds and whether the head (which may read ``next``) fails."""
    steps = by_step(keys, position, 8192).scan(rows, next=following(c(value))).filter(c("next").isNotNull())
    return steps.withColumn("applies", F.coalesce(body, F.lit(False))).withColumn("violates", c("applies") & ~F.coalesce(head, F.lit(False)))


def violation_episodes(steps: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Maximal runs of violating steps; a step without a next observation neither ends nor extends one."""
    return runs(steps, keys, position, "violates").filter("violates").select(
        *keys, c("start_frame"), c("end_frame"), (c("end_frame") - c("start_frame") + 1).alias("duration")
    )


def coherence_state(profile: DataFrame) -> DataFrame:
    """State of the sampling of a track and its confidence from n, max_gap, mean_gap, fit_coherence and evidence.

    The two weights and the gap limits are fixed values.
    """
    gaps = 1 / (1 + F.greatest(F.lit(0.0), c("mean_gap") - 1))
    support = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c("n") - 1) / 4.0))
    state = (
        F.when(c("n") < 2, "limited_samples").when(c("max_gap") <= 1, "continuous_samples")
        .when(c("max_gap") <= 3, "intermittent_samples").otherwise("fragmented_samples")
    )
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("evidence") * support * (0.55 * gaps + 0.45 * c("fit_coherence"))))
    return profile.withColumns({"state": state, "gap_coherence": gaps, "confidence": confidence})


def train_validation(examples: DataFrame, group: str, place: str, item: str, share: float, seed: int) -> DataFrame:
    """Whole groups go to validation, in hash order; a single group is divided by the place of its examples instead.

    A single example is its own training and validation set, as one row ``both``.
    """
    groups = examples.select(group).distinct()
    size = groups.count()
    if size > 1:
        held = min(size - 1, max(1, int(size * share + 0.5)))
        ranked = hash_ranked(groups, group, f"validation:{seed}:").select(group, F.when(c("place") <= held, "validation").otherwise("train").alias("split"))
        return examples.select(group, item).join(ranked, group)
    order = by_step([], place, 4096, item).scan(examples.select(group, place, item), k=row_number(), n=total(1))
    held = F.least(c("n") - 1, F.greatest(F.lit(1), F.floor(c("n") * share + 0.5)))
    split = F.when(c("n") == 1, "both").when(c("k") > c("n") - held, "validation").otherwise("train")
    return order.select(group, item, split.alias("split"))


def reprojection_residuals(points: DataFrame, focal: float, centre: tuple[float, float], sigma: float, conflict: float) -> DataFrame:
    """Pixel distance of a camera point (x, y, z) from its observed pixel (u, v), in sigmas, with severity.

    A point at or behind the camera can't be projected: it stays with null residuals and severity info.
    """
    shown = c("z") > 1e-6
    u, v = centre[0] + focal * c("x") / c("z"), centre[1] + focal * c("y") / c("z")
    error = F.when(shown, F.sqrt(F.pow(u - c("u"), 2) + F.pow(v - c("v"), 2)))
    out = points.withColumn("raw", error).withColumn("normalized", error / sigma)
    return out.withColumn("evaluable", shown).withColumn("severity", severity(c("normalized"), F.lit(False), conflict, conflict))


def scene_summary(observations: DataFrame, keys: Sequence[str], track: str, frame: str) -> DataFrame:
    """Frames, objects, mean objects per frame, mean and longest life of a track, per scene."""
    lives = observations.groupBy(*keys, track).agg(F.count("*").alias("life"))
    of_tracks = lives.groupBy(*keys).agg(F.count("*").alias("objects"), F.sum("life").alias("observations"), F.max("life").alias("longest"))
    frames = observations.select(*keys, frame).distinct().groupBy(*keys).agg(F.count("*").alias("frames"))
    return of_tracks.join(frames, list(keys)).select(
        *keys, "frames", "objects", "observations", "longest",
        (c("observations") / c("frames")).alias("objects_per_frame"), (c("observations") / c("objects")).alias("mean_life"),
    )
