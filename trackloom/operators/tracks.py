"""Object tracks: motion, profiles, uncertainty, trends, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import norm
from trackloom.operators.ordered import Ordered, by_step, overall_max, previous, row_number, running_sum

TRACK = ["video_id", "track_id"]
FRAME = "frame_index"
SPAN = 8192


def steps(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = TRACK, order: str = FRAME, span: int | None = SPAN, **more) -> DataFrame:
    """Each row with the given columns of the row before it as ``p_<column>``."""
    specs = {f"p_{c}": previous(F.col(c)) for c in [order, *columns]}
    return by_step(keys, order, span).scan(df, **specs, **more)


def gap() -> Column:
    return F.greatest(F.lit(1), F.col(FRAME) - F.col(f"p_{FRAME}"))


def relative_motion(observations: DataFrame, ego: DataFrame | None, span: int | None = SPAN) -> DataFrame:
    """Backward-difference velocity over the frame gap and motion relative to the ego of the same frame.

    ``ego`` has (video_id, frame_index, ego_vx, ego_vz); a missing ego frame counts as standing still.  Without ``ego`` the
    observations have it.  Without a span tracks are whole, and the observations stay as they are spread.
    """
    moved = steps(observations, ["x", "z"], span=span)
    known = F.col(f"p_{FRAME}").isNotNull()
    velocity = lambda c: F.when(known, (F.col(c) - F.col(f"p_{c}")) / gap()).otherwise(0.0)
    moved = moved.withColumn("obj_vx", velocity("x")).withColumn("obj_vz", velocity("z")).withColumn("has_rel_motion", known)
    joined = (moved if ego is None else moved.join(ego, ["video_id", FRAME], "left")).na.fill(0.0, ["ego_vx", "ego_vz"])
    rel = lambda c: F.when(F.col("has_rel_motion"), F.col(f"obj_{c}") - F.col(f"ego_{c}")).otherwise(0.0)
    return (
        joined.withColumn("rel_vx", rel("vx"))
        .withColumn("rel_vz", rel("vz"))
        .withColumn("rel_speed", norm(F.col("rel_vx"), F.col("rel_vz")))
        .drop("p_x", "p_z", f"p_{FRAME}")
    )


def numeric_profile(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Count, range, moments, first, last, change and step sizes of an ordered value."""
    moved = by_step(keys, order, SPAN).scan(df.filter(F.col(value).isNotNull()), before=previous(F.col(value)))
    v = F.col(value)
    step = F.abs(v - F.col("before"))
    out = moved.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min_by(v, order).alias("first"),
        F.max_by(v, order).alias("last"),
        F.coalesce(F.avg(step), F.lit(0.0)).alias("mean_abs_step"),
        F.coalesce(F.max(step), F.lit(0.0)).alias("max_abs_step"),
    )
    return out.withColumn("delta", F.col("last") - F.col("first")).withColumn("abs_delta", F.abs("delta"))


def track_profile(observations: DataFrame) -> DataFrame:
    """Span, coverage, gaps, path and displacement of each track; needs x, y, z and a source column."""
    moved = steps(observations, ["x", "y", "z"])
    d = {c: F.col(c) - F.col(f"p_{c}") for c in "xyz"}
    hop = F.col(FRAME) - F.col(f"p_{FRAME}")
    share = lambda kind: F.avg(F.when(F.col("source") == kind, 1.0).otherwise(0.0))
    ends = {f"{e}_{c}": f(F.col(c), FRAME) for c in "xyz" for e, f in (("a", F.min_by), ("b", F.max_by))}
    agg = moved.groupBy(*TRACK).agg(
        F.count("*").alias("observations"),
        F.min(FRAME).alias("start_frame"),
        F.max(FRAME).alias("end_frame"),
        F.count_if(hop > 1).alias("gaps"),
        F.coalesce(F.max(hop), F.lit(0)).alias("max_gap"),
        F.coalesce(F.avg(hop), F.lit(0.0)).alias("mean_gap"),
        F.coalesce(F.sum(norm(d["x"], d["y"], d["z"])), F.lit(0.0)).alias("path_3d"),
        F.coalesce(F.sum(norm(d["x"], d["z"])), F.lit(0.0)).alias("path_xz"),
        share("repaired").alias("repaired_ratio"),
        share("merged").alias("merged_ratio"),
        share("observed").alias("observed_ratio"),
        F.avg(F.when(hop.isNotNull(), 1.0).otherwise(0.0)).alias("motion_ratio"),
        F.avg("score").alias("mean_score"),
        *[c.alias(n) for n, c in ends.items()],
    )
    moved_by = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"]
    return (
        agg.withColumn("frame_span", F.col("end_frame") - F.col("start_frame") + 1)
        .withColumn("coverage", F.col("observations") / F.col("frame_span"))
        .withColumn("displacement_3d", norm(*moved_by))
        .withColumn("displacement_xz", norm(moved_by[0], moved_by[2]))
        .drop(*ends)
    )


def track_uncertainty(profile: DataFrame, source_uncertainty: Column) -> Column:
    """Weighted blend of repair, missing motion, gaps, weak scores and source uncertainty."""
    c = F.col
    return F.least(
        F.lit(1.0),
        0.25 * c("repaired_ratio")
        + 0.15 * c("merged_ratio")
        + 0.25 * (1 - c("motion_ratio"))
        + 0.15 * F.least(F.lit(1.0), c("gaps") / F.greatest(F.lit(1.0), c("observations")))
        + 0.1 * F.greatest(F.lit(0.0), 1 - c("mean_score"))
        + 0.1 * source_uncertainty,
    )


def linear_trend(df: DataFrame, keys: Sequence[str], order: str, value: str, evidence: float = 1.0) -> DataFrame:
    """Least-squares trend of an ordered value with fit coherence and agreement of step signs."""
    v, f = F.col(value), F.col(order)
    moved = by_step(keys, order, SPAN).scan(
        df.filter(v.isNotNull()), pv=previous(v), pf=previous(f), peak=overall_max(F.abs(v))
    )
    eps = F.greatest(F.lit(1e-6), 1e-3 * F.greatest(F.lit(1.0), F.col("peak")))
    step = (v - F.col("pv")) / F.greatest(F.lit(1), f - F.col("pf"))
    fd = f.cast("double")
    agg = moved.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.min_by(v, f).alias("start"),
        F.max_by(v, f).alias("end"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        (F.max(v) - F.min(v)).alias("range"),
        F.coalesce(F.regr_slope(v, fd), F.lit(0.0)).alias("slope"),
        F.coalesce(F.stddev_pop(fd), F.lit(0.0)).alias("frame_std"),
        F.max(eps).alias("eps"),
        F.count(step).alias("steps"),
        F.count_if(step > eps).alias("up"),
        F.count_if(step < -eps).alias("down"),
        F.count_if(v > eps).alias("above"),
        F.count_if(v < -eps).alias("below"),
    )
    c = F.col
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    delta = c("end") - c("start")
    left_over = F.sqrt(F.greatest(F.lit(0.0), c("std") * c("std") - F.pow(c("slope") * c("frame_std"), F.lit(2))))
    coherence = unit(1 - left_over / F.greatest(F.lit(1e-6), c("range"), F.abs(delta), c("std")))
    flat = (F.abs(delta) <= c("eps")) & (F.abs(c("slope")) <= c("eps"))
    moving = c("up") + c("down")
    agreeing = F.when(c("slope") >= 0, c("up")).otherwise(c("down"))
    consistency = (
        F.when(flat & (moving == 0), 1.0)
        .when(flat, unit(1 - moving / F.greatest(F.lit(1), c("steps"))))
        .when(moving > 0, agreeing / moving)
        .otherwise(0.0)
    )
    return (
        agg.withColumn("delta", delta)
        .withColumn("coherence", coherence)
        .withColumn("consistency", consistency)
        .withColumn(
            "trend",
            F.when(flat, "stable")
            .when(c("consistency") >= 0.6, F.when(c("slope") >= 0, "increasing").otherwise("decreasing"))
            .otherwise("mixed"),
        )
        .withColumn(
            "level",
            F.when((c("above") == 0) & (c("below") == 0), "near_zero")
            .when(c("above") / c("n") >= 0.7, "positive")
            .when(c("below") / c("n") >= 0.7, "negative")
            .otherwise("mixed"),
        )
        .withColumn(
            "confidence",
            unit(
                evidence
                * F.least(F.lit(1.0), (c("n") - 1) / 4.0)
                * (0.55 * c("coherence") + 0.45 * c("consistency"))
            ),
        )
        .select(
            *keys, "n", "start", "end", "delta", "slope", "mean", "std", "trend", "level", "coherence", "consistency", "confidence"
        )
    )


def step_metrics(motion: DataFrame) -> DataFrame:
    """Largest and mean steps of a track in depth, plane and velocity, and direction reversals.

    ``motion`` is the output of ``relative_motion``.
    """
    cols = ["x", "z", "rel_vx", "rel_vz", "rel_speed", "has_rel_motion"]
    moved = steps(motion, cols)
    c, p = F.col, lambda n: F.col(f"p_{n}")
    dz = (c("z") - p("z")) / gap()
    depth = F.abs(dz)
    minus, plus = F.abs(dz - c("ego_vz")), F.abs(dz + c("ego_vz"))
    both = c("has_rel_motion") & p("has_rel_motion")
    jump = F.when(both, norm(c("rel_vx") - p("rel_vx"), c("rel_vz") - p("rel_vz")))
    dot = c("rel_vx") * p("rel_vx") + c("rel_vz") * p("rel_vz")
    reversal = both & (c("rel_speed") > 0.3) & (p("rel_speed") > 0.3) & (dot < 0)
    compensated = F.when(depth.isNotNull(), F.least(depth, minus, plus))
    return moved.groupBy(*TRACK).agg(
        F.max(depth).alias("max_depth_step"),
        F.max(compensated).alias("max_compensated_depth_step"),
        F.max(norm(c("x") - p("x"), c("z") - p("z")) / gap()).alias("max_plane_step"),
        F.avg(jump).alias("mean_velocity_change"),
        F.max(jump).alias("max_velocity_change"),
        F.max(F.when(both, F.abs(c("rel_speed") - p("rel_speed")))).alias("max_speed_change"),
        F.count_if(reversal).alias("reversals"),
    )


def temporal_consistency(df: DataFrame, keys: Sequence[str], order: str, frames_in_segment: Column) -> DataFrame:
    """Mean of visibility and of the share of consecutive frames; visibility alone for one frame."""
    moved = by_step(keys, order, SPAN).scan(df.withColumn("__len", frames_in_segment), before=previous(F.col(order)))
    agg = moved.groupBy(*keys).agg(
        F.count("*").alias("seen"),
        F.max("__len").alias("length"),
        F.coalesce(F.avg(F.when(F.col("before").isNotNull(), (F.col(order) - F.col("before") == 1).cast("double"))), F.lit(0.0)).alias("consecutive"),
    )
    visible = F.col("seen") / F.greatest(F.lit(1), F.col("length"))
    return agg.withColumn("visibility", visible).withColumn(
        "consistency", F.when(F.col("seen") == 1, visible).otherwise((visible + F.col("consecutive")) / 2)
    )


def split_at_gaps(observations: DataFrame, max_gap_frames: int) -> DataFrame:
    """Later parts of a track interrupted by more than the allowed missing frames get new ids.

    New ids follow the largest id of the video in order of (old id, part).
    """
    moved = steps(observations, [])
    cut = F.col(FRAME) - F.col(f"p_{FRAME}") - 1 > max_gap_frames
    parts = by_step(TRACK, FRAME, SPAN).scan(
        moved.withColumn("cut", F.coalesce(cut.cast("int"), F.lit(0))), part=running_sum(F.col("cut"))
    )
    tops = observations.groupBy("video_id").agg(F.max("track_id").alias("top"))
    later = parts.filter("part > 0").select(*TRACK, "part").distinct()
    numbered = Ordered(["video_id"], ["track_id", "part"], F.floor(F.col("track_id") / 64)).scan(later, n=row_number())
    ids = numbered.join(tops, "video_id").select(*TRACK, "part", (F.col("top") + F.col("n")).alias("new_id"))
    return (
        parts.join(ids, [*TRACK, "part"], "left")
        .withColumn("new_id", F.coalesce("new_id", "track_id"))
        .drop("cut", f"p_{FRAME}")
    )
