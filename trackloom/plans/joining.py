"""Joins and matching over frames, segments and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import geometry
from trackloom.functions.numbers import settled
from trackloom.operators import joins, tracks
from trackloom.operators.ordered import runs
from trackloom.plans.catalog import query, rounded
from trackloom.plans.sequences import MOTION, ego
from trackloom.plans.views import Inputs, shared

C = F.col


@query("""
select s.video_id, s.frame_index, r.start_frame, r.end_frame, r.label from v_signal s join v_runs r on r.video_id = s.video_id and s.frame_index between r.start_frame and r.end_frame""")
def frames_in_segments(t: Inputs):
    seg = t.truth_runs().select("video_id", "start_frame", "end_frame", "label")
    return joins.frames_to_segments(t.signal().select("video_id", "frame_index"), seg, ["video_id"], "frame_index", 64)


@query("""
select a.video_id, a.start_frame as a_start, a.end_frame as a_end, b.start_frame as b_start, b.end_frame as b_end, a.label = b.label as same_label,
 round((least(a.end_frame, b.end_frame) - greatest(a.start_frame, b.start_frame) + 1) * 1.0 / (greatest(a.end_frame, b.end_frame) - least(a.start_frame, b.start_frame) + 1), 6) as iou
from v_runs a join v_pred_runs b on b.video_id = a.video_id and least(a.end_frame, b.end_frame) >= greatest(a.start_frame, b.start_frame)""")
def temporal_iou(t: Inputs):
    a = t.truth_runs().select("video_id", C("start_frame").alias("a_start"), C("end_frame").alias("a_end"), C("label").alias("a_label"))
    b = t.truth_runs("pred_label").select("video_id", C("start_frame").alias("b_start"), C("end_frame").alias("b_end"), C("label").alias("b_label"))
    out = joins.overlapping_segments(a, b, ["video_id"], 64).withColumn("same_label", C("a_label") == C("b_label"))
    return rounded(out, "video_id", "a_start", "a_end", "b_start", "b_end", "same_label", "iou")


@query("""
with p as (select distinct user_id as video_id, cast(floor(epoch_us(ts) / 60e6) * 60000000 as bigint) as us from events where event_type = 'click'),
r as (select user_id as video_id, epoch_us(ts) as us, event_id from events where event_type <> 'click'),
j as (select p.video_id, p.us, r.us as source_time, r.event_id, row_number() over (partition by p.video_id, p.us order by abs(r.us - p.us), r.us) as k from p join r on r.video_id = p.video_id)
select video_id, us, source_time, event_id from j where k = 1""")
def nearest_in_time(t: Inputs):
    us = F.unix_micros(C("ts").cast("timestamp"))
    events = t.table("events").select(C("user_id").alias("video_id"), us.alias("us"), "event_id", "event_type")
    probes = events.filter("event_type = 'click'").select("video_id", (F.floor(C("us") / 60000000) * 60000000).alias("us")).distinct()
    rows = events.filter("event_type <> 'click'").select("video_id", "us", "event_id")
    return joins.nearest_in_time(probes, rows, ["video_id"], "us", "event_id", 3600 * 1000000)


@query("""
with fr as (select video_id, track_id, cast(unnest(range(mn, mx + 1)) as int) as frame_index from (select video_id, track_id, min(frame_index) as mn, max(frame_index) as mx from v_track_obs group by 1, 2) a),
nb as (select f.*, (select max(o.frame_index) from v_track_obs o where o.video_id = f.video_id and o.track_id = f.track_id and o.frame_index <= f.frame_index) as pf,
  (select min(o.frame_index) from v_track_obs o where o.video_id = f.video_id and o.track_id = f.track_id and o.frame_index >= f.frame_index) as nf from fr f)
select nb.video_id, nb.track_id, nb.frame_index, round(case when pf = nb.frame_index then a.x when nf - pf <= 6 then a.x + (b.x - a.x) * (nb.frame_index - pf) / (nf - pf) end, 6) as x,
  round(case when pf = nb.frame_index then a.z when nf - pf <= 6 then a.z + (b.z - a.z) * (nb.frame_index - pf) / (nf - pf) end, 6) as z
from nb join v_track_obs a on a.video_id = nb.video_id and a.track_id = nb.track_id and a.frame_index = pf join v_track_obs b on b.video_id = nb.video_id and b.track_id = nb.track_id and b.frame_index = nf""")
def interpolated_observations(t: Inputs):
    obs = shared(t.track_obs().select("video_id", "track_id", "frame_index", "x", "z"))
    span = obs.groupBy("video_id", "track_id").agg(F.min("frame_index").alias("a"), F.max("frame_index").alias("b"))
    probes = span.select("video_id", "track_id", F.explode(F.sequence("a", "b")).alias("frame_index"))
    return rounded(joins.interpolated(probes, obs, tracks.TRACK, "frame_index", ["x", "z"], 6), "video_id", "track_id", "frame_index", "x", "z")


@query(f"""
with {MOTION}, p as (select a.video_id, a.track_id as a_id, b.track_id as b_id, sqrt(pow(b.x-a.x,2)+pow(b.z-a.z,2)) as d, a.obj_vx as avx, b.obj_vx as bvx, a.obj_vz as avz, b.obj_vz as bvz, b.x - a.x as dx, b.z - a.z as dz
  from motion a join motion b on a.video_id = b.video_id and a.frame_index = b.frame_index and a.track_id < b.track_id)
select video_id, a_id, b_id, count(*) as frames, round(avg(d), 6) as mean_distance, round(avg(case when d < 15 then 1.0 else 0 end), 6) as proximity, count_if(d < 15) as near_frames,
  count_if(d < 15 and d > 0 and avx*avx+avz*avz > 0 and (avx*dx + avz*dz) / (sqrt(avx*avx+avz*avz) * d) < -0.3) as avoiding_frames from p group by 1, 2, 3""")
def object_pairs(t: Inputs):
    m = tracks.relative_motion(t.track_obs(), ego(t)).select("video_id", "frame_index", "track_id", "x", "z", C("obj_vx").alias("vx"), C("obj_vz").alias("vz"))
    out = joins.pair_statistics(joins.frame_pairs(shared(m), ["video_id", "frame_index"], ["x", "z", "vx", "vz"]), 15.0)
    return rounded(out, "video_id", "a_id", "b_id", "frames", "mean_distance", "proximity", "near_frames", "avoiding_frames")


BOX = "select video_id, track_id, frame_index, x as x1, y as y1, x + 10 as x2, y + 4 as y2 from v_track_obs"


@query(f"""
with b as ({BOX}), n as (select video_id, track_id, count(*) as n from b group by 1, 2),
p as (select a.video_id, a.track_id as a_id, b.track_id as b_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i from b a join b on a.video_id = b.video_id and a.frame_index = b.frame_index and a.track_id < b.track_id),
g as (select video_id, a_id, b_id, count(*) as shared, avg(i / (80 - i)) as mean_iou, max(i / (80 - i)) as max_iou from p group by 1, 2, 3)
select g.video_id, a_id, b_id, shared, round(mean_iou, 6) as mean_iou, round(max_iou, 6) as max_iou, round(shared / least(x.n, y.n), 6) as shared_ratio, round(mean_iou * shared / least(x.n, y.n), 6) as overlap_score
from g join n x on x.video_id = g.video_id and x.track_id = a_id join n y on y.video_id = g.video_id and y.track_id = b_id""")
def track_overlaps(t: Inputs):
    b = shared(t.track_obs().select("video_id", "track_id", "frame_index", C("x").alias("x1"), C("y").alias("y1"), (C("x") + 10).alias("x2"), (C("y") + 4).alias("y2")))
    pairs = joins.frame_pairs(b, ["video_id", "frame_index"], ["x1", "y1", "x2", "y2"])
    sizes = b.groupBy("video_id", "track_id").agg(F.count("*").alias("n"))
    out = joins.track_overlaps(pairs, ["video_id", "frame_index"], geometry.iou(geometry.box("a_"), geometry.box("b_")), sizes)
    return rounded(out, "video_id", "a_id", "b_id", "shared", "mean_iou", "max_iou", "shared_ratio", "overlap_score")


@query("""
with g as (select distinct frame_index from v_boxes where source = 'gt'), d as (select distinct frame_index from v_boxes where source = 'det')
select coalesce(g.frame_index, d.frame_index) as frame_index, case when d.frame_index is null then 'left_only' when g.frame_index is null then 'right_only' else 'both' end as origin from g full join d on g.frame_index = d.frame_index""")
def full_frame_union(t: Inputs):
    side = lambda s: t.boxes().filter(C("source") == s).select("frame_index").distinct()
    return joins.full_timeline(side("gt"), side("det"), ["frame_index"])


@query("""
with b as (select *, row_number() over (partition by frame_index, source, label order by det_index, x1, x2, y2) as rn from v_boxes), p as (select g.frame_index, g.label, g.det_index as gt_index, g.rn as gt_rn, d.det_index, d.rn,
  greatest(0, least(g.x2, d.x2) - greatest(g.x1, d.x1)) * greatest(0, least(g.y2, d.y2) - greatest(g.y1, d.y1)) as i, (g.x2-g.x1)*(g.y2-g.y1) as ga, (d.x2-d.x1)*(d.y2-d.y1) as da
  from b g join b d on d.frame_index = g.frame_index and d.label = g.label and g.source = 'gt' and d.source = 'det'),
q as (select *, i / (ga + da - i) as iou from p), k as (select *, row_number() over (partition by frame_index, label, gt_rn order by round(iou, 9) desc, rn) as k from q where iou >= 0.3)
select frame_index, label, gt_index, det_index, round(iou, 6) as iou from k where k = 1""")
def best_candidate_boxes(t: Inputs):
    from pyspark.sql.window import Window as W

    # the boxes of one frame are a bounded group
    order = W.partitionBy("frame_index", "source", "label").orderBy("det_index", "x1", "x2", "y2")
    b = t.boxes().withColumn("rn", F.row_number().over(order))
    side = lambda s, p: b.filter(C("source") == s).select("frame_index", "label", *[C(c).alias(f"{p}_{c}") for c in ("det_index", "rn", "x1", "y1", "x2", "y2")])
    pairs = side("gt", "g").join(side("det", "d"), ["frame_index", "label"])
    scored = pairs.withColumn("iou", geometry.iou(geometry.box("g_"), geometry.box("d_"))).filter("iou >= 0.3")
    best = scored.groupBy("frame_index", "label", "g_rn").agg(
        F.max_by(F.struct(C("g_det_index").alias("gt_index"), C("d_det_index").alias("det_index"), "iou"), F.struct(F.round("iou", 9), -C("d_rn"))).alias("m")
    )
    return best.select("frame_index", "label", "m.gt_index", "m.det_index", settled(C("m.iou")).alias("iou"))


@query("""
select video_id, segment_index, track_id, distance_state, x_state, case when distance_state = 'near' and x_state = 'centered' then 'ahead' when distance_state in ('near', 'medium') then 'around' when x_state <> 'centered' then 'aside' else 'rest' end as cohort from v_objects""")
def first_matching_cohorts(t: Inputs):
    documents = [
        {"name": "ahead", "conditions": [{"attribute": "distance_state", "operator": "==", "value": "near"}, {"attribute": "x_state", "operator": "==", "value": "centered"}]},
        {"name": "around", "conditions": [{"attribute": "distance_state", "operator": "in", "value": ["near", "medium"]}]},
        {"name": "aside", "conditions": [{"attribute": "x_state", "operator": "!=", "value": "centered"}]},
    ]
    rules = joins.compile_conditions(documents, ["distance_state", "x_state"])
    out = joins.first_matching_rule(t.objects(), rules, "rest")
    return out.select("video_id", "segment_index", "track_id", "distance_state", "x_state", "cohort")


@query("""
with pr as (select * from (values ('brake', 'economy'), ('brake', 'promo'), ('turn', 'standard'), ('turn', 'large')) p(prior_id, cls)), ob as (select distinct example_id, o, lower(val) as cls from v_atoms where pred = 'object_class'),
ex as (select distinct example_id from ob), m as (select ob.example_id, prior_id, count(distinct o) as matched_objects, count(distinct ob.cls) as matched_classes from ob join pr on pr.cls = ob.cls group by 1, 2), n as (select prior_id, count(*) as classes from pr group by 1)
select m.example_id, m.prior_id, matched_objects, n.classes - matched_classes as missing_classes from m join n on n.prior_id = m.prior_id""")
def prior_facts(t: Inputs):
    priors = t.spark.createDataFrame([("brake", ["economy", "promo"]), ("turn", ["standard", "large"])], "prior_id string, classes array<string>")
    listed = priors.select("prior_id", F.size("classes").alias("classes"), F.explode("classes").alias("cls"))
    seen = t.atoms().filter("pred = 'object_class'").select("example_id", "o", F.lower("val").alias("cls")).distinct()
    # a fixed prior table of a few rows
    hits = seen.join(F.broadcast(listed), "cls")
    per_class = hits.groupBy("example_id", "prior_id", "classes", "cls").agg(F.count("*").alias("n"))
    objects = hits.select("example_id", "prior_id", "o").distinct().groupBy("example_id", "prior_id").agg(F.count("*").alias("matched_objects"))
    classes = per_class.groupBy("example_id", "prior_id", "classes").agg(F.count("*").alias("k"))
    return objects.join(classes, ["example_id", "prior_id"]).select(
        "example_id", "prior_id", "matched_objects", (C("classes") - C("k")).alias("missing_classes")
    )


@query("""
with o as (select video_id, segment_index, track_id, object_class, distance_state, x_state, row_number() over (partition by video_id, segment_index order by case distance_state when 'near' then 0 when 'medium' then 1 else 2 end, object_class, track_id, x_state, source) as k from v_objects)
select video_id, segment_index, track_id, object_class, distance_state, cast(k as int) as focus_rank from o where k <= 2""")
def focus_objects(t: Inputs):
    from trackloom.operators.selection import best_in_group

    rank = F.when(C("distance_state") == "near", 0).when(C("distance_state") == "medium", 1).otherwise(2)
    out = best_in_group(t.objects(), ["video_id", "segment_index"], [rank, C("object_class"), C("track_id"), C("x_state"), C("source")], 2)
    return out.select("video_id", "segment_index", "track_id", "object_class", "distance_state", C("rank_in_group").alias("focus_rank"))


@query(f"""
with {MOTION}, r as (select video_id, track_id, frame_index, z, rel_vz, rel_vx, rel_speed, score, frame_index // 12 as seg from motion),
g as (select *, frame_index - lag(frame_index) over (partition by video_id, track_id, seg order by frame_index) as hop from r),
a as (select video_id, seg, track_id, count(*) as seen, avg(z) as mean_z, min(z) as min_z, max(z) as max_z, avg(rel_speed) as mean_speed, avg(score) as mean_score, avg(case when hop = 1 then 1.0 when hop is not null then 0 end) as cons from g group by 1, 2, 3)
select video_id, seg, track_id, seen, round(seen / 12.0, 6) as visibility, round(mean_z, 6) as mean_z, round(min_z, 6) as min_z, round(max_z, 6) as max_z, round(mean_speed, 6) as mean_speed, round(mean_score, 6) as mean_score,
  case when mean_z <= 15 then 'near' when mean_z <= 30 then 'medium' else 'far' end as distance_state, case when mean_speed > 0.3 then 'rel_moving' else 'rel_static' end as speed_state,
  round(case when seen = 1 then seen / 12.0 else (seen / 12.0 + cons) / 2 end, 6) as consistency, row_number() over (partition by video_id, seg order by round(min_z, 9), track_id) as distance_rank from a""")
def segment_object_summaries(t: Inputs):
    from trackloom.operators.summaries import segment_objects

    m = tracks.relative_motion(t.track_obs(), ego(t)).withColumn("seg", F.floor(C("frame_index") / 12).cast("int"))
    out = segment_objects(m, ["video_id", "seg"], 12).withColumn("distance_rank", C("distance_rank").cast("bigint"))
    return rounded(out, "video_id", "seg", "track_id", "seen", "visibility", "mean_z", "min_z", "max_z", "mean_speed", "mean_score", "distance_state", "speed_state", "consistency", "distance_rank")
