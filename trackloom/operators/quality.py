"""Track quality: reality checks, cues, cohorts, reference votes, thresholds and repair choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import norm
from trackloom.operators.quantiles import median_of, quantiles
from trackloom.operators.selection import best_in_group

TRACK = ["video_id", "track_id"]

# Fixed values
VALIDATION_THRESHOLDS = {
    "max_valid_frame_gap": 3,
    "max_uncertain_frame_gap": 1,
    "max_invalid_center_step_diag_ratio": 2.0,
    "max_uncertain_center_step_diag_ratio": 1.0,
    "max_invalid_bbox_size_ratio": 3.0,
    "max_uncertain_bbox_size_ratio": 2.0,
    "max_invalid_depth_step_per_frame": 8.0,
    "max_uncertain_depth_step_per_frame": 4.0,
    "max_invalid_rel_velocity_delta": 10.0,
    "max_uncertain_rel_velocity_delta": 5.0,
    "max_invalid_rel_speed": 25.0,
    "max_uncertain_rel_speed": 12.0,
    "min_motion_ratio": 0.5,
}
HARD_REASONS = ["physical_invalidity", "id_switch", "trajectory_discontinuity", "motion_direction_abrupt_change"]
CALIBRATABLE = {
    "max_invalid_depth_step_per_frame": ("depth_jump", "max_depth_step"),
    "max_invalid_rel_velocity_delta": ("speed_abnormal_change", "max_velocity_change"),
    "max_invalid_rel_speed": ("speed_abnormal_change", "max_speed"),
}


def track_facts(motion: DataFrame, span: int | None = 8192) -> DataFrame:
    """Everything the reality checks read, one row per track; ``motion`` is the output of ``relative_motion`` with the same span."""
    from trackloom.operators.ordered import by_step, previous
    from trackloom.operators.tracks import gap

    cols = ["frame_index", "x", "z", "rel_vx", "rel_vz", "obj_vx", "obj_vz", "ego_vx", "ego_vz", "has_rel_motion"]
    moved = by_step(TRACK, "frame_index", span).scan(motion, **{f"p_{c}": previous(F.col(c)) for c in cols})
    c, p = F.col, lambda n: F.col(f"p_{n}")
    both = c("has_rel_motion") & p("has_rel_motion")
    dz = (c("z") - p("z")) / gap()
    plus = lambda f, a: f(f"obj_{a}") + f(f"ego_{a}")
    dot = c("rel_vx") * p("rel_vx") + c("rel_vz") * p("rel_vz")
    quick = (norm(c("rel_vx"), c("rel_vz")) > 0.3) & (norm(p("rel_vx"), p("rel_vz")) > 0.3)
    facts = moved.groupBy(*TRACK).agg(
        F.count("*").alias("n"),
        (F.count_distinct("label") + F.max(c("label").isNull().cast("long"))).alias("labels"),
        F.coalesce(F.max(c("frame_index") - p("frame_index")), F.lit(0)).alias("max_gap"),
        F.avg(c("has_rel_motion").cast("double")).alias("motion_ratio"),
        F.count_if(c("z") < 0).alias("behind"),
        F.coalesce(F.max(F.when(dz.isNotNull(), F.least(F.abs(dz), F.abs(dz - c("ego_vz")), F.abs(dz + c("ego_vz"))))), F.lit(0.0)).alias("max_depth_step"),
        F.coalesce(F.max(F.when(both, norm(c("rel_vx") - p("rel_vx"), c("rel_vz") - p("rel_vz")))), F.lit(0.0)).alias("minus_change"),
        F.coalesce(F.max(F.when(both, norm(plus(c, "vx") - plus(p, "vx"), plus(c, "vz") - plus(p, "vz")))), F.lit(0.0)).alias("plus_change"),
        F.coalesce(F.max(F.when(c("has_rel_motion"), norm(c("rel_vx"), c("rel_vz")))), F.lit(0.0)).alias("minus_speed"),
        F.coalesce(F.max(F.when(c("has_rel_motion"), norm(plus(c, "vx"), plus(c, "vz")))), F.lit(0.0)).alias("plus_speed"),
        F.count_if(both & quick & (dot < 0)).alias("reversals"),
        F.count_if(c("source") == "repaired").alias("repaired"),
        F.count_if(c("source") == "merged").alias("merged"),
    )
    # the ego sign convention with the lower residual, speed first
    option = lambda n: F.struct(c(f"{n}_speed").alias("speed"), c(f"{n}_change").alias("change"), F.lit(n).alias("name"))
    best = F.least(option("minus"), option("plus"))
    return (
        facts.withColumn("best", best)
        .withColumn("max_speed", c("best.speed"))
        .withColumn("max_velocity_change", c("best.change"))
        .withColumn("profile", c("best.name"))
        .drop("best")
    )


def _two_limits(value: Column, kind: str, invalid: float, uncertain: float) -> Column:
    issue = lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(s).alias("severity"))
    return F.when(value > invalid, issue("invalid")).when(value > uncertain, issue("uncertain"))


def reality_checks(facts: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Issues of each track and its status: invalid, uncertain, repaired or valid.

    Drift and jumps of the box are judged where ``facts`` has max_center_ratio and max_size_ratio.
    """
    t = {**VALIDATION_THRESHOLDS, **(thresholds or {})}
    c = F.col
    issue = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    speed = F.when(
        (c("max_velocity_change") > t["max_invalid_rel_velocity_delta"]) | (c("max_speed") > t["max_invalid_rel_speed"]),
        F.struct(F.lit("speed_abnormal_change").alias("kind"), F.lit("invalid").alias("severity")),
    ).when(
        (c("max_velocity_change") > t["max_uncertain_rel_velocity_delta"]) | (c("max_speed") > t["max_uncertain_rel_speed"]),
        F.struct(F.lit("speed_abnormal_change").alias("kind"), F.lit("uncertain").alias("severity")),
    )
    boxes = [
        _two_limits(c(metric), kind, t[f"max_invalid_{limit}"], t[f"max_uncertain_{limit}"])
        for metric, kind, limit in [("max_center_ratio", "track_drift", "center_step_diag_ratio"), ("max_size_ratio", "bbox_jump", "bbox_size_ratio")]
        if metric in facts.columns
    ]
    issues = F.array_compact(
        F.array(
            issue(c("behind") > 0, "physical_invalidity", "invalid"),
            issue(c("n") < 2, "trajectory_too_short", "uncertain"),
            issue(c("labels") > 1, "id_switch", "invalid"),
            _two_limits(c("max_gap"), "trajectory_discontinuity", t["max_valid_frame_gap"], t["max_uncertain_frame_gap"]),
            issue(c("motion_ratio") < t["min_motion_ratio"], "insufficient_motion_evidence", "uncertain"),
            *boxes,
            _two_limits(c("max_depth_step"), "depth_jump", t["max_invalid_depth_step_per_frame"], t["max_uncertain_depth_step_per_frame"]),
            speed,
            _two_limits(c("reversals"), "motion_direction_abrupt_change", 1, 0),
        )
    )
    has = lambda s: F.exists("issues", lambda i: i["severity"] == s)
    names = lambda s: F.transform(F.filter("issues", lambda i: i["severity"] == s), lambda i: i["kind"])
    return (
        facts.withColumn("issues", issues)
        .withColumn(
            "status",
            F.when(has("invalid"), "invalid")
            .when(has("uncertain"), "uncertain")
            .when(c("repaired") + c("merged") > 0, "repaired")
            .otherwise("valid"),
        )
        .withColumn("rejections", names("invalid"))
        .withColumn("doubts", names("uncertain"))
        .drop("issues")
    )


def calibrate_thresholds(conflicts: DataFrame, current: dict[str, float], least: int, quantile: float, most_change: float) -> DataFrame:
    """New limits from the measurements of protected tracks that were rejected.

    The target quantile is bounded by the change allowed per epoch and by twice the default; tracks with a hard
    reason do not count.  One row per threshold.
    """
    soft = conflicts.filter(~F.arrays_overlap("rejections", F.array(*map(F.lit, HARD_REASONS))))
    rows = F.explode(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.array_contains("rejections", kind) & (F.col(metric) > 0),
                        F.struct(F.lit(name).alias("threshold"), F.col(metric).cast("double").alias("value")),
                    )
                    for name, (kind, metric) in CALIBRATABLE.items()
                ]
            )
        )
    )
    values = soft.select(rows.alias("r")).select("r.*")
    target = quantiles(values, ["threshold"], "value", observed=quantile)
    counted = values.groupBy("threshold").agg(F.count("*").alias("samples")).join(target, "threshold")
    now = F.lit(None).cast("double")
    cap = F.lit(None).cast("double")
    for name, value in current.items():
        now = F.when(F.col("threshold") == name, F.lit(float(value))).otherwise(now)
        cap = F.when(F.col("threshold") == name, F.lit(2.0 * VALIDATION_THRESHOLDS[name])).otherwise(cap)
    proposed = F.least(F.col("observed"), F.col("current") * (1 + most_change), F.col("cap"))
    changes = (F.col("samples") >= least) & (F.col("proposed") > F.col("current") + F.greatest(F.lit(1e-9), F.abs("current") * 1e-6))
    return (
        counted.withColumn("current", now)
        .withColumn("cap", cap)
        .withColumn("proposed", proposed)
        .withColumn("accepted", F.when(changes, F.col("proposed")).otherwise(F.col("current")))
        .select("threshold", "samples", "observed", "current", "accepted")
    )


def promotion_report(before: DataFrame, after: DataFrame, protected: Column) -> DataFrame:
    """Status flips between two validations of the same tracks, split by protection."""
    a = before.select(*TRACK, F.col("status").alias("old"), F.col("rejections").alias("old_rejections"), protected.alias("protected"))
    b = after.select(*TRACK, F.col("status").alias("new"), F.col("rejections").alias("new_rejections"))
    hard = lambda c: F.arrays_overlap(c, F.array(*map(F.lit, HARD_REASONS)))
    joined = a.join(b, TRACK)
    bad = lambda c: F.col(c) == "invalid"
    return joined.groupBy("protected").agg(
        F.count("*").alias("tracks"),
        F.count_if(bad("old")).alias("invalid_before"),
        F.count_if(bad("new")).alias("invalid_after"),
        F.count_if(bad("old") & ~bad("new")).alias("released"),
        F.count_if(hard("old_rejections") != hard("new_rejections")).alias("hard_changes"),
    )


def motion_cues(motion: DataFrame, confidence: float, whole: bool = False) -> DataFrame:
    """Static, moving or uncertain score of a track from its speeds and a band of its own spread; ``whole`` tracks fit in a row."""
    seen = motion.filter("has_rel_motion").select(*TRACK, "rel_speed")
    agg = _speeds_of_rows(seen, confidence) if whole else _speeds(seen, confidence)
    c = F.col
    above = 1 - c("within")
    reliable = F.lit(confidence >= 0.35) & (c("n") >= 3)
    support = F.least(F.lit(1.0), c("n") / 5.0)
    still = reliable & (c("mid") <= c("band")) & (c("within") >= 0.7)
    moving = reliable & (c("mid") > c("band")) & (above >= 0.7)
    doubt = F.greatest(F.lit(0.25), F.lit(1 - confidence), (1 - F.abs(c("within") - above)) * support)
    return agg.select(
        *TRACK,
        F.when(still, confidence * support * c("within")).otherwise(0.0).alias("static"),
        F.when(moving, confidence * support * above).otherwise(0.0).alias("moving"),
        F.when(still | moving, 0.0).otherwise(F.least(F.lit(1.0), doubt)).alias("uncertain"),
    )


def _band(confidence: float) -> Column:
    return 0.3 + F.least(F.lit(0.7), 2.5 * F.col("mad")) + 0.3 * (1.0 - confidence)


def _speeds_of_rows(seen: DataFrame, confidence: float) -> DataFrame:
    lists = seen.groupBy(*TRACK).agg(F.sort_array(F.collect_list("rel_speed")).alias("speeds")).withColumn("mid", median_of(F.col("speeds")))
    off = F.sort_array(F.transform("speeds", lambda v: F.abs(v - F.col("mid"))))
    bands = lists.withColumn("off", off).withColumn("mad", median_of(F.col("off"))).withColumn("band", _band(confidence))
    within = F.size(F.filter("speeds", lambda v: v <= F.col("band"))) / F.size("speeds")
    return bands.select(*TRACK, "mid", "band", F.size("speeds").alias("n"), within.alias("within"))


def _speeds(seen: DataFrame, confidence: float) -> DataFrame:
    mid = quantiles(seen, TRACK, "rel_speed", mid=0.5)
    off = seen.join(mid, TRACK).withColumn("off", F.abs(F.col("rel_speed") - F.col("mid")))
    bands = mid.join(quantiles(off, TRACK, "off", mad=0.5), TRACK).withColumn("band", _band(confidence))
    return (
        seen.join(bands, TRACK)
        .groupBy(*TRACK, "mid", "band")
        .agg(F.count("*").alias("n"), F.avg((F.col("rel_speed") <= F.col("band")).cast("double")).alias("within"))
    )


def ego_votes(motion: DataFrame, weight: Column) -> DataFrame:
    """What the motion of reference objects says about the ego velocity, in the sign convention closer to the ego."""
    c = F.col
    same = norm(c("obj_vx") - c("ego_vx"), c("obj_vz") - c("ego_vz"))
    opposite = norm(c("obj_vx") + c("ego_vx"), c("obj_vz") + c("ego_vz"))
    flip = F.when((norm(c("ego_vx"), c("ego_vz")) > 0.3) & (opposite < same), -1.0).otherwise(1.0)
    return motion.filter("has_rel_motion").select(
        "video_id", "frame_index", "track_id", "ego_vz", (flip * c("obj_vz")).alias("vote"), weight.alias("weight")
    )


def bucket_limits(tracks: DataFrame, value: str) -> DataFrame:
    """Tercile limits of a value over the training tracks, one row."""
    return quantiles(tracks, [], value, low=1 / 3, high=2 / 3)


def bucketed(tracks: DataFrame, value: str, limits: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    """Bucket names by limits fitted elsewhere; the limits are a single row."""
    joined = tracks.withColumn("__one", F.lit(1)).join(F.broadcast(limits.withColumn("__one", F.lit(1))), "__one")
    v = F.col(value)
    name = F.when(v <= F.col("low"), names[0]).when(v <= F.col("high"), names[1]).otherwise(names[2])
    return joined.withColumn(out, name).drop("__one", "low", "high")


def cohort_profile(tracks: DataFrame, cohort: str, value: str) -> DataFrame:
    """Size, videos, invalid rate and quantiles of each cohort."""
    videos = tracks.select(cohort, "video_id").distinct().groupBy(cohort).agg(F.count("*").alias("videos"))
    base = tracks.groupBy(cohort).agg(
        F.count("*").alias("tracks"),
        F.avg((F.col("status") == "invalid").cast("double")).alias("invalid_rate"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )
    return base.join(videos, cohort).join(quantiles(tracks, [cohort], value, q05=0.05, q50=0.5, q95=0.95), cohort)


def cohort_anomalies(tracks: DataFrame, cohort: str, systematic: float) -> DataFrame:
    """How often each rejection reason occurs in a cohort, and whether it is systematic."""
    sizes = tracks.groupBy(cohort).agg(F.count("*").alias("tracks"))
    found = tracks.select(cohort, F.explode("rejections").alias("reason")).groupBy(cohort, "reason").agg(F.count("*").alias("n"))
    rate = F.col("n") / F.col("tracks")
    return found.join(sizes, cohort).withColumn("rate", rate).withColumn("systematic", rate >= systematic)


def pattern_residuals(motion: DataFrame) -> DataFrame:
    """Spread, change and continuity measures of a track that motion patterns are scored with."""
    from trackloom.operators.ordered import by_step, previous

    scan = by_step(TRACK, "frame_index", 8192)
    cols = ["frame_index", "z", "rel_speed"]
    one = scan.scan(motion, **{f"p_{c}": previous(F.col(c)) for c in cols})
    two = scan.scan(one.withColumn("dz", F.col("z") - F.col("p_z")), p_dz=previous(F.col("dz")))
    c = F.col
    angle = F.when(c("has_rel_motion"), F.atan2("obj_vz", "obj_vx"))
    return two.groupBy(*TRACK).agg(
        F.stddev_pop("rel_speed").alias("speed"),
        F.coalesce(F.avg(F.abs(c("rel_speed") - c("p_rel_speed"))), F.lit(0.0)).alias("acceleration"),
        F.coalesce(1 - norm(F.avg(F.sin(angle)), F.avg(F.cos(angle))), F.lit(0.0)).alias("direction"),
        F.min(F.abs("x")).alias("path_intersection"),
        F.coalesce(F.avg(c("frame_index") - c("p_frame_index") - 1), F.lit(0.0)).alias("continuity"),
        F.coalesce(F.avg(F.abs(c("dz") - c("p_dz"))), F.lit(0.0)).alias("depth_consistency"),
        (F.max_by("x", "frame_index") - F.min_by("x", "frame_index")).alias("dx_total"),
        (F.max_by("z", "frame_index") - F.min_by("z", "frame_index")).alias("dz_total"),
        F.avg("rel_speed").alias("mean_speed"),
    )


def pattern_penalties(residuals: DataFrame) -> DataFrame:
    """Penalty of each track against the motion patterns and the best pattern, listed inside the row."""
    c = F.col
    dx, dz, ds = F.abs("dx_total"), c("dz_total"), c("direction")
    zero = F.lit(0.0)
    penalties = {
        "stationary": c("mean_speed") + dx + F.abs(dz),
        "same_direction": ds + F.greatest(zero, -dz),
        "opposite_direction": ds + F.greatest(zero, dz),
        "crossing": F.abs(dz) / F.greatest(F.lit(1e-6), dx + F.abs(dz)),
        "turning": F.greatest(zero, 0.5 - ds),
        "overtaking": F.greatest(zero, F.abs(dz) - dx),
    }
    listed = F.array(*[F.struct(F.round(p, 9).alias("penalty"), F.lit(n).alias("pattern")) for n, p in penalties.items()])
    return residuals.withColumn("best", F.array_min(listed)).select(
        *TRACK, F.col("best.pattern").alias("pattern"), F.col("best.penalty").alias("penalty")
    )


def rank_repairs(candidates: DataFrame, statistics: DataFrame) -> DataFrame:
    """Best passing repair of each track by improvement, learned success rate, sample size and prior."""
    joined = candidates.filter("verdict = 'pass'").join(statistics, ["object_class", "pattern"], "left")
    c = F.col
    known = F.coalesce(c("success_rate"), F.lit(0.5))
    trust = F.least(F.lit(1.0), F.log1p(F.coalesce(c("samples"), F.lit(0))) / F.log(F.lit(21.0)))
    gain = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("improvement")))
    score = 0.40 * gain + 0.25 * known + 0.20 * trust + 0.15 * c("prior")
    scored = joined.withColumn("score", score)
    return best_in_group(scored, TRACK, [F.round("score", 9).desc(), F.col("pattern")], 1).drop("rank_in_group")


def decision_signature(columns: dict[str, Column]) -> Column:
    """Hash of bucketed facts; equal tracks share one decision."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in sorted(columns.items())]), 256)
