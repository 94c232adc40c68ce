"""Conflict windows gathered to clusters, and what each cluster says about its cause."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.components import connected_components
from trackloom.operators.lineage import checkpointed
from trackloom.operators.ordered import START, Ordered, Spec, carried

SPAN = 4096


def largest_before(value: Column) -> Spec:
    """The largest value of all rows before the row."""
    return Spec(
        lambda w: [F.max(value).over(w.rowsBetween(START, -1))],
        lambda o: F.max(value),
        lambda w, s: F.max(s).over(w.rowsBetween(START, -1)),
        lambda l, c: F.greatest(l[0], c),
    )


def conflict_clusters(windows: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """The windows with ``cluster_id``, the smallest window_id of all windows that are linked with it.

    ``windows`` has the keys of a video, window_id (unique over all), start_frame, end_frame and subjects (array).  Windows
    of one subject link if the next one starts at most ``gap`` frames after the end of those before it; a window with several
    subjects links their windows.  Windows without subjects link with each other.  A sweep per subject carries the last
    end over chunks of frames, so a subject with most of the windows is many tasks.
    """
    keys = list(keys)
    named = F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit(None).cast("string")))
    rows = windows.select(*keys, "window_id", "start_frame", "end_frame", F.explode(named).alias("__subject"))
    sweep = Ordered([*keys, "__subject"], ["start_frame", "end_frame", "window_id"], F.floor(F.col("start_frame") / F.lit(SPAN)))
    seen = sweep.scan(rows, __end=largest_before(F.col("end_frame")))
    starts = F.col("__end").isNull() | (F.col("start_frame") > F.col("__end") + gap + 1)
    heads = sweep.scan(seen.withColumn("__head", F.when(starts, F.col("window_id"))), __first=carried(F.col("__head")))
    linked = checkpointed(heads.select("window_id", "__first").distinct())
    several = linked.groupBy("window_id").agg(F.count("*").alias("n")).filter("n > 1").select("window_id")
    # only windows with several subjects join what the sweeps found
    edges = linked.join(several, "window_id").select(F.col("window_id").alias("__w"), F.col("__first").alias("__f"))
    first_of_all = edges.groupBy("__w").agg(F.min("__f").alias("a")).join(edges, "__w").select("a", F.col("__f").alias("b"))
    merged = connected_components(first_of_all).select(F.col("node").alias("__first"), "component")
    of_window = linked.groupBy("window_id").agg(F.min("__first").alias("__first")).join(merged, "__first", "left")
    grouped = of_window.select("window_id", F.coalesce("component", "__first").alias("__group"))
    smallest = grouped.groupBy("__group").agg(F.min("window_id").alias("cluster_id"))
    return windows.join(grouped, "window_id").join(smallest, "__group").drop("__group")


# The rules in order of precedence, and the names users know.
def diagnosis(c: dict[str, Column]) -> tuple[Column, Column]:
    """Cause and repair of a cluster, from its boolean columns (by name) and ``flow_direction``, its largest direction error."""
    visual = c["object_flow"] | c["reprojection"]
    rules = [
        (c["background"], "pose_drift", "refit_local_dynamics"),
        (c["gap"] & (c["association_alternative"] | c["gap_support"]), "identity_error", "relink_track"),
        (c["gap"], "unobservable_evidence", "mark_occluded"),
        (c["mask_alternative"] & c["depth"] & visual, "mask_error", "switch_mask_candidate"),
        (c["depth"] & c["several_tracks"] & c["scale_alternative"], "scale_ambiguity", "switch_scale_candidate"),
        (c["physics"] & c["object_flow"] & c["checked"], "true_acute_maneuver", "adjust_process_noise"),
        (c["physics"], "dynamics_mismatch", "refit_local_dynamics"),
        (c["object_flow"] & (c["flow_direction"] >= 60.0) & c["association_alternative"], "identity_error", "relink_track"),
        (c["object_flow"] & (c["flow_direction"] >= 60.0), "identity_error", "split_track"),
        (visual, "dynamics_mismatch", "refit_local_dynamics"),
        (c["depth"], "depth_jump", "invalidate_or_downweight_cue"),
        (c["semantic"], "semantic_prior_mismatch", "leave_unresolved"),
    ]
    cause, repair = F.lit("unresolved_conflict"), F.lit("leave_unresolved")
    for condition, name, operator in reversed(rules):
        cause, repair = F.when(condition, name).otherwise(cause), F.when(condition, operator).otherwise(repair)
    return cause, repair


#: Which constraints speak for which flag.
FLAGS = {
    "background": ["heldout_background_backward_flow"],
    "object_flow": ["heldout_object_backward_flow"],
    "depth": ["heldout_object_depth"],
    "reprojection": ["object_reprojection"],
    "gap": ["trajectory_temporal_gap"],
    "physics": ["ego_acceleration_bound", "ego_speed_bound", "object_acceleration_bound", "object_speed_bound"],
    "semantic": ["semantic_static_motion"],
}
ALTERNATIVES = ("association_alternative", "gap_support", "mask_alternative", "scale_alternative")


def diagnosed_clusters(clustered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cluster: span, windows, cause, repair and confidence.

    ``clustered`` has, besides the columns of ``conflict_clusters``, constraint, family, hard and checked (booleans),
    flow_direction, and the booleans of ``ALTERNATIVES``: whether evidence for that repair is archived.  Nulls count as false.
    """
    yes = lambda column: F.coalesce(F.max(column), F.lit(False))
    per = clustered.groupBy(*keys, "cluster_id").agg(
        F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.count("*").alias("windows"),
        *[yes(F.col("constraint").isin(names)).alias(flag) for flag, names in FLAGS.items()],
        *[yes(F.col(a)).alias(a) for a in ALTERNATIVES],
        yes(F.col("checked")).alias("checked"), yes(F.col("hard")).alias("hard"), yes(F.size("subjects") > 0).alias("has_subject"),
        (F.coalesce(F.min(F.array_min("subjects")) < F.max(F.array_max("subjects")), F.lit(False))).alias("several_tracks"),
        (F.coalesce(F.min("family") < F.max("family"), F.lit(False))).alias("several_families"),
        F.coalesce(F.max("flow_direction"), F.lit(0.0)).alias("flow_direction"),
    )
    names = [*FLAGS, *ALTERNATIVES, "checked", "several_tracks", "flow_direction"]
    cause, repair = diagnosis({n: F.col(n) for n in names})
    part = lambda name, weight: F.when(F.col(name), weight).otherwise(0.0)
    sure = 0.50 + part("checked", 0.15) + part("several_families", 0.10) + part("hard", 0.10) + part("has_subject", 0.05)
    return per.select(*keys, "cluster_id", "start_frame", "end_frame", "windows", cause.alias("cause"), repair.alias("repair"), F.least(F.lit(0.95), sure).alias("confidence"))
