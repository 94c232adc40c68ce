"""Change points of a signal, fragments linked to chains, boxes associated by cues, conflict clusters and their diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import change_points as cp
from trackloom.operators import conflicts, linking
from trackloom.operators.ordered import by_step, carried, previous, running_sum
from trackloom.plans.catalog import query, rounded
from trackloom.plans.views import Inputs, shared

C = F.col
MAX_GAP = 6


def walk(t: Inputs):
    """The summed signal of each video; every seventeenth frame or so is missing."""
    summed = by_step(["video_id"], "frame_index", 8192).scan(t.signal(), walk=running_sum(C("vz")))
    return summed.select("video_id", "frame_index", C("walk").alias("vz"), ((C("video_id") * 31 + C("frame_index")) % 17 != 0).alias("available"))


@query()
def change_points(t: Inputs):
    out = cp.change_points(walk(t), ["video_id"], "frame_index", "vz", C("available"))
    return rounded(out, "video_id", "start_frame", "end_frame", "duration_frames", "state", "robust_level", "residual_variance", "confidence")


def fragments(t: Inputs, obs: DataFrame | None = None, whole: bool = False):
    """Tracks cut where three months or more are missing; boxes are 20 wide and 2 high.  ``whole`` tracks are spread by video and stay there."""
    obs = t.track_obs() if obs is None else obs
    starts = C("before").isNull() | (C("frame_index") - C("before") > 3)
    head = F.when(starts, C("frame_index"))
    if whole:
        # the frames of one track
        in_track = Window.partitionBy("video_id", "track_id").orderBy("frame_index")
        seen = obs.withColumn("before", F.lag("frame_index").over(in_track))
        cut = seen.withColumn("first_frame", F.max(head).over(in_track.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        in_steps = by_step(["video_id", "track_id"], "frame_index", 256)
        seen = in_steps.scan(obs, before=previous(C("frame_index")))
        cut = in_steps.scan(seen.withColumn("head", head), first_frame=carried(C("head")))
    box = lambda p, pick: [
        (pick("x") - 10).alias(f"{p}_x1"), (pick("y") - 1).alias(f"{p}_y1"), (pick("x") + 10).alias(f"{p}_x2"), (pick("y") + 1).alias(f"{p}_y2"),
    ]
    first, last = (lambda c: F.min_by(c, "frame_index")), (lambda c: F.max_by(c, "frame_index"))
    out = cut.groupBy("video_id", "track_id", "first_frame").agg(
        F.max("frame_index").alias("last_frame"), first("label").alias("label"), F.lit("no_prior").alias("prior"), *box("s", first), *box("e", last)
    )
    return out.withColumn("fragment_id", (C("video_id") * 50 + C("track_id")) * 100000 + C("first_frame"))


@query()
def linked_fragments(t: Inputs):
    def linked(obs: DataFrame, whole: bool) -> DataFrame:
        cut = fragments(t, obs, whole)
        return linking.linked_fragments(cut if whole else shared(cut), ["video_id"], MAX_GAP, 0.2, 0.1, 50.0, 7.0, whole)

    out = t.by_length(linked)
    return rounded(out, "video_id", "fragment_id", "chain_id", "linked_to", "merge_score")


RADIUS = 4.0


@query(f"""
with recursive ob as (select video_id, frame_index, (video_id * 50 + track_id) * 100000 + frame_index as item, label, x, y, dense_rank() over (partition by video_id order by frame_index) as n from v_track_obs),
me as (select c.item, p.item as other, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) as far from ob c join ob p on p.video_id = c.video_id and p.label = c.label and p.n = c.n - 1),
li as (select item, other as linked_to from (select *, row_number() over (partition by item order by far, other) as k from me where far < {RADIUS}) where k = 1),
hd as (select video_id, item, row_number() over (partition by video_id order by frame_index, item) - 1 as object_number from ob where item not in (select item from li)),
ch as (select item, item as first_item from hd union all select li.item, ch.first_item from li join ch on li.linked_to = ch.item)
select ob.video_id, ob.frame_index, ob.item, li.linked_to, ch.first_item, hd.object_number from ob join ch using (item) left join li using (item) join hd on hd.item = ch.first_item""")
def previous_frame_links(t: Inputs):
    objects = t.track_obs().withColumn("item", (C("video_id") * 50 + C("track_id")) * 100000 + C("frame_index"))
    return linking.previous_frame_links(objects, ["video_id"], RADIUS)


def cue_pairs(t: Inputs):
    """Every stored box of a frame with every detected one, with the score of their cues; every third box has no depth."""
    # the boxes of one frame
    in_frame = Window.partitionBy("frame_index").orderBy("det_index", *linking.BOX, "score", "label", "source")
    boxes = t.once("numbered_boxes", lambda: t.boxes().withColumn("number", F.row_number().over(in_frame)))
    sided = lambda p, source: boxes.filter(C("source") == source).select(
        "frame_index", C("number").alias(f"{p}_index"), C("label").alias(f"{p}label"), F.when(C("det_index") % 3 != 0, C("x1") + C("y1")).alias(f"{p}depth"), *[C(b).alias(f"{p}{b}") for b in linking.BOX]
    )
    score = linking.cue_score({
        "box_iou": (linking.box_iou("a", "b"), 0.4), "class_consistency": (linking.class_cue(C("alabel"), C("blabel")), 0.2),
        "depth_consistency": (linking.depth_cue(C("adepth"), C("bdepth")), 0.4),
    })
    return sided("a", "gt").join(sided("b", "det"), "frame_index").select("frame_index", C("a_index").alias("proposal"), C("b_index").alias("detection"), score.alias("score"))


@query()
def associated_boxes(t: Inputs):
    out = linking.associated(cue_pairs(t), ["frame_index"], "proposal", "detection", "score", 0.35)
    return rounded(out, "frame_index", "proposal", "detection", "score", "outcome")


CONSTRAINTS = ["heldout_background_backward_flow", "heldout_object_backward_flow", "heldout_object_depth", "object_reprojection", "trajectory_temporal_gap", "object_speed_bound", "semantic_static_motion"]


def conflict_table(t: Inputs):
    """A window per strong deviation of the signal; its subject is the kind of event."""
    kind = F.abs("vx").cast("int")
    return t.signal().filter("vz > 60 or vz < -80").select(
        "video_id", (C("video_id") * 100000 + C("frame_index")).alias("window_id"), C("frame_index").alias("start_frame"),
        (C("frame_index") + kind % 4).alias("end_frame"), F.array("label").alias("subjects"),
        F.element_at(F.array(*[F.lit(c) for c in CONSTRAINTS]), kind % 7 + 1).alias("constraint"),
        F.when(kind % 7 < 2, "flow").when(kind % 7 < 4, "appearance").otherwise("dynamics").alias("family"),
        (C("vz") > 120).alias("hard"), (C("frame_index") % 3 == 0).alias("checked"), (kind * 5).cast("double").alias("flow_direction"),
        (kind % 5 == 0).alias("association_alternative"), (kind % 6 == 0).alias("gap_support"),
        (kind % 3 == 0).alias("mask_alternative"), (kind % 2 == 0).alias("scale_alternative"),
    )


CLUSTERED = """
kinds as (select video_id, frame_index, label, vz, cast(abs(vx) as int) as k from v_signal where vz > 60 or vz < -80),
windows as (select *, frame_index + k % 4 as end_frame, max(frame_index + k % 4) over (partition by video_id, label order by frame_index rows between unbounded preceding and 1 preceding) as before from kinds),
numbered as (select *, sum(case when before is null or frame_index > before + 3 then 1 else 0 end) over (partition by video_id, label order by frame_index) as island from windows),
clustered as (select *, video_id * 100000 + min(frame_index) over (partition by video_id, label, island) as cluster_id from numbered)"""


@query(f"""
with {CLUSTERED} select video_id, video_id * 100000 + frame_index as window_id, cluster_id from clustered""")
def conflict_clusters(t: Inputs):
    return conflicts.conflict_clusters(conflict_table(t), ["video_id"], 2).select("video_id", "window_id", "cluster_id")


@query(f"""
with {CLUSTERED},
per as (
    select video_id, cluster_id, min(frame_index) as start_frame, max(end_frame) as end_frame, count(*) as windows, bool_or(k % 7 = 0) as background, bool_or(k % 7 = 1) as flow,
        bool_or(k % 7 = 2) as depth, bool_or(k % 7 = 3) as reprojection, bool_or(k % 7 = 4) as gap, bool_or(k % 7 = 5) as physics, bool_or(k % 7 = 6) as semantic,
        bool_or(k % 5 = 0) as association, bool_or(k % 6 = 0) as support, bool_or(k % 3 = 0) as mask, bool_or(frame_index % 3 = 0) as checked, bool_or(vz > 120) as hard,
        max(k * 5) as direction, count(distinct case when k % 7 < 2 then 1 when k % 7 < 4 then 2 else 3 end) as families
    from clustered group by video_id, cluster_id
)
select video_id, cluster_id, start_frame, end_frame, windows,
    case when background then 'pose_drift' when gap and (association or support) then 'identity_error' when gap then 'unobservable_evidence'
        when mask and depth and (flow or reprojection) then 'mask_error' when physics and flow and checked then 'true_acute_maneuver' when physics then 'dynamics_mismatch'
        when flow and direction >= 60 then 'identity_error' when flow or reprojection then 'dynamics_mismatch' when depth then 'depth_jump'
        when semantic then 'semantic_prior_mismatch' else 'unresolved_conflict' end as cause,
    case when background then 'refit_local_dynamics' when gap and (association or support) then 'relink_track' when gap then 'mark_occluded'
        when mask and depth and (flow or reprojection) then 'switch_mask_candidate' when physics and flow and checked then 'adjust_process_noise' when physics then 'refit_local_dynamics'
        when flow and direction >= 60 and association then 'relink_track' when flow and direction >= 60 then 'split_track' when flow or reprojection then 'refit_local_dynamics'
        when depth then 'invalidate_or_downweight_cue' else 'leave_unresolved' end as repair,
    round(least(0.95, 0.55 + case when checked then 0.15 else 0 end + case when families > 1 then 0.1 else 0 end + case when hard then 0.1 else 0 end), 6) as confidence
from per""")
def diagnosed_conflicts(t: Inputs):
    clustered = conflicts.conflict_clusters(conflict_table(t), ["video_id"], 2)
    return rounded(conflicts.diagnosed_clusters(clustered, ["video_id"]), "video_id", "cluster_id", "start_frame", "end_frame", "windows", "cause", "repair", "confidence")
