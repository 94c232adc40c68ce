"""Consistency residuals of world tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import bands
from trackloom.functions.geometry import norm
from trackloom.operators.ordered import by_step, carried, previous, total
from trackloom.operators.quantiles import median_of, quantiles

TRACK = ["video_id", "track_id"]


def physics_bounds(
    states: DataFrame, acceleration_scale: float, speed_limit: float, frames_per_second: float, conflict: float, hard: float
) -> DataFrame:
    """Acceleration and speed of consecutive states against plausibility scales, one row per residual."""
    seen = by_step(TRACK, "frame_index", 8192).scan(
        states, pvx=previous(F.col("vx")), pvz=previous(F.col("vz")), pf=previous(F.col("frame_index"))
    )
    dt = (F.col("frame_index") - F.col("pf")) / frames_per_second
    accel = norm(F.col("vx") - F.col("pvx"), F.col("vz") - F.col("pvz")) / dt
    residual = lambda name, raw, scale: F.struct(
        F.lit(name).alias("constraint"), raw.alias("raw"), (raw / scale).alias("normalized")
    )
    both = F.array(
        F.when(dt > 0, residual("acceleration_bound", accel, acceleration_scale)),
        residual("speed_bound", norm(F.col("vx"), F.col("vz")), speed_limit),
    )
    rows = seen.select(*TRACK, "frame_index", F.explode(F.array_compact(both)).alias("r")).select(*TRACK, "frame_index", "r.*")
    return rows.filter("normalized is not null").withColumn(
        "severity", bands.severity(F.col("normalized"), F.lit(True), conflict, hard)
    )


def identity_gaps(observations: DataFrame, max_gap: int) -> DataFrame:
    """Largest hole of each track that has one, normalised by the longest gap a prediction may bridge."""
    seen = by_step(TRACK, "frame_index", 8192).scan(observations, pf=previous(F.col("frame_index")))
    gap = F.col("frame_index") - F.col("pf") - 1
    return (
        seen.groupBy(*TRACK)
        .agg(F.max(gap).alias("largest_gap"), F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"))
        .filter("largest_gap > 0")
        .withColumn("normalized", F.col("largest_gap") / F.lit(float(max(1, max_gap))))
    )


def motion_classes(
    observations: DataFrame, least: int, sigma: float, static_limit: float, moving_limit: float, noise: Column, whole: bool = False
) -> DataFrame:
    """Static, moving, ambiguous or unobservable from displacement and spread against the position noise; ``whole`` tracks fit in a row."""
    c = F.col
    moved = F.greatest(norm(c("b_x") - c("a_x"), c("b_z") - c("a_z")), 2 * c("mid_radius"))
    state = (
        F.when(c("n") < least, "unobservable")
        .when(c("motion") + c("slack") <= static_limit, "static")
        .when(F.greatest(F.lit(0.0), c("motion") - c("slack")) >= moving_limit, "moving")
        .otherwise("ambiguous")
    )
    places = _places_of_rows(observations, noise) if whole else _places(observations, noise)
    return places.withColumn("motion", moved).withColumn("slack", sigma * c("mid_noise")).withColumn("state", state).select(*TRACK, "n", "motion", "state")


def _places_of_rows(observations: DataFrame, noise: Column) -> DataFrame:
    """n, the ends (a_x, a_z, b_x, b_z), mid_radius and mid_noise of each track."""
    place = F.struct("frame_index", "x", "z", noise.alias("noise"))
    lists = observations.groupBy(*TRACK).agg(F.sort_array(F.collect_list(place)).alias("rows"))
    middle = lambda of: median_of(F.sort_array(F.transform("rows", of)))
    centred = lists.withColumns({"cx": middle(lambda r: r["x"]), "cz": middle(lambda r: r["z"]), "mid_noise": middle(lambda r: r["noise"])})
    radius = middle(lambda r: norm(r["x"] - F.col("cx"), r["z"] - F.col("cz")))
    ends = {f"{p}_{c}": F.element_at("rows", at)[c] for c in ("x", "z") for p, at in (("a", 1), ("b", -1))}
    return centred.select(*TRACK, F.size("rows").cast("long").alias("n"), "mid_noise", radius.alias("mid_radius"), *[v.alias(k) for k, v in ends.items()])


def _places(observations: DataFrame, noise: Column) -> DataFrame:
    centre = quantiles(observations, TRACK, "x", cx=0.5).join(quantiles(observations, TRACK, "z", cz=0.5), TRACK)
    off = observations.join(centre, TRACK).withColumn("radius", norm(F.col("x") - F.col("cx"), F.col("z") - F.col("cz")))
    spread = quantiles(off, TRACK, "radius", mid_radius=0.5)
    noisy = quantiles(observations.withColumn("noise", noise), TRACK, "noise", mid_noise=0.5)
    ends = observations.groupBy(*TRACK).agg(
        F.count("*").alias("n"),
        *[f(F.col(c), "frame_index").alias(f"{p}_{c}") for c in ("x", "z") for p, f in (("a", F.min_by), ("b", F.max_by))],
    )
    return ends.join(spread, TRACK).join(noisy, TRACK)


def smooth_scope(
    observations: DataFrame, keys: Sequence[str], start: int, end: int, strength: float, max_sigma: float, least_std: float, value: str, std: Column
) -> DataFrame:
    """Pull the inner rows of a frame range towards the line between its ends, limited by their noise."""
    keys = list(keys)
    inside = observations.filter(F.col("frame_index").between(start, end)).withColumn("std", F.greatest(std, F.lit(least_std)))
    scope = inside.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("frame_index").alias("f0"),
        F.max("frame_index").alias("f1"),
        F.min_by(value, "frame_index").alias("v0"),
        F.max_by(value, "frame_index").alias("v1"),
    )
    c = F.col
    share = (c("frame_index") - c("f0")) / F.greatest(F.lit(1e-12), c("f1") - c("f0"))
    target = (1 - share) * c("v0") + share * c("v1")
    limit = max_sigma * c("std")
    shift = F.greatest(-limit, F.least(limit, strength * (target - c(value))))
    inner = (c("n") >= 3) & (c("frame_index") > c("f0")) & (c("frame_index") < c("f1"))
    return (
        inside.join(scope, keys)
        .filter(inner)
        .withColumn("updated", c(value) + shift)
        .withColumn("standardized", F.abs(shift) / c("std"))
        .select(*keys, "frame_index", value, "updated", "standardized")
    )


def family_packets(residuals: DataFrame, conflict: float) -> DataFrame:
    """Counts, peak and conflicts of residuals per family."""
    return residuals.groupBy("video_id", "constraint").agg(
        F.count("*").alias("n"),
        F.max("normalized").alias("peak"),
        F.count_if(F.col("normalized") >= conflict).alias("conflicts"),
        F.avg(F.col("normalized") * F.col("normalized")).alias("mean_square"),
    )


def objective(packets: DataFrame, weights: dict[str, float]) -> DataFrame:
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("constraint") == name, F.lit(w)).otherwise(weight)
    return packets.groupBy("video_id").agg(F.sum(weight * F.col("mean_square")).alias("objective"))


def evidence_accounts(rows: DataFrame, disposition: Column, names: Sequence[str]) -> DataFrame:
    """Rows of each frame and modality by what became of them; the parts add up to the input."""
    return (
        rows.withColumn("__d", disposition)
        .groupBy("frame_index", "modality")
        .agg(F.count("*").alias("input"), *[F.count_if(F.col("__d") == n).alias(n) for n in names])
    )
