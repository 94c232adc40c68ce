"""Scores, splits, residuals and evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.numbers import settled
from trackloom.operators import metrics, residuals, splits, summaries, tracks
from trackloom.plans.catalog import query, rounded
from trackloom.plans.sequences import MOTION, ego
from trackloom.plans.views import Inputs, shared

C = F.col


@query("""
with s as (select * from v_scores), p as (select video_id, label, score, rank() over (partition by video_id order by score) + (count(*) over (partition by video_id, score) - 1) / 2.0 as rk from s),
g as (select video_id, sum(case when label = 1 then rk else 0 end) as rs, count_if(label = 1) as p, count_if(label = 0) as n from p group by 1)
select video_id, round(case when p > 0 and n > 0 then (rs - p * (p + 1) / 2.0) / (p * n) end, 6) as auc from g""")
def roc_auc(t: Inputs):
    return rounded(metrics.roc_auc(t.scores(), ["video_id"]), "video_id", "auc")


@query("""
with o as (select video_id, label, sum(label) over w as tp, row_number() over w as k from v_scores window w as (partition by video_id order by score desc, example_id rows unbounded preceding))
select video_id, round(sum(tp / k) / count(*), 6) as average_precision from o where label = 1 group by 1""")
def average_precision(t: Inputs):
    return rounded(metrics.average_precision(shared(t.scores()), ["video_id"]), "video_id", "average_precision")


@query("""
with th as (select distinct video_id, score as threshold from v_scores union select video_id, least(1.0::double, score + 1e-8::double) from v_scores union select video_id, greatest(0.0::double, score - 1e-8::double) from v_scores union select distinct video_id, th.t from v_scores, (values (0.0::double), (0.5::double), (1.0::double)) th(t)),
c as (select h.video_id, threshold, count_if(label = 1 and score >= threshold) as tp, count_if(label = 0 and score >= threshold) as fp, count_if(label = 1 and score < threshold) as fn, count_if(label = 0 and score < threshold) as tn from th h join v_scores s on s.video_id = h.video_id group by 1, 2),
m as (select *, tp / greatest(1, tp + fp) as precision, tp / greatest(1, tp + fn) as recall, 2.0 * tp / greatest(1, 2 * tp + fp + fn) as f1 from c),
k as (select *, row_number() over (partition by video_id order by round(f1, 9) desc, round(precision, 9) desc, round(recall, 9) desc, round(abs(threshold - 0.5), 9), threshold) as k from m)
select video_id, round(threshold, 9) as threshold, tp, fp, fn, tn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from k where k = 1""")
def best_threshold(t: Inputs):
    out = metrics.best_threshold(shared(t.scores()), ["video_id"]).withColumn("threshold", settled(C("threshold"), 9))
    return out.select("video_id", "threshold", "tp", "fp", "fn", "tn", *[settled(C(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("""
with c as (select gt_label, pred_label, count(*) as frames from v_settled_timeline group by 1, 2) select * from c""")
def frame_confusion(t: Inputs):
    return t.settled_timeline().groupBy("gt_label", "pred_label").agg(F.count("*").alias("frames"))


@query("""
with k as (select * from (values ('forward'), ('backward'), ('left'), ('right'), ('static')) k(cls)), c as (select gt_label, pred_label, count(*) as n from v_settled_timeline group by 1, 2),
m as (select cls, coalesce(sum(n) filter (where gt_label = cls and pred_label = cls), 0) as tp, coalesce(sum(n) filter (where gt_label <> cls and pred_label = cls), 0) as fp, coalesce(sum(n) filter (where gt_label = cls), 0) as support from k, c group by 1)
select cls, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(support as bigint) as support, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when support > 0 then tp / support else 0 end, 6) as recall, round(case when tp > 0 then 2.0 * tp / (tp + fp + support) else 0 end, 6) as f1 from m""")
def frame_class_metrics(t: Inputs):
    from trackloom.operators.segment_eval import class_metrics

    counts = t.settled_timeline().groupBy(C("gt_label").alias("truth"), C("pred_label").alias("prediction")).agg(F.count("*").alias("n"))
    return rounded(class_metrics(counts), "cls", "tp", "fp", "support", "precision", "recall", "f1")


@query("""
with h as (select c_custkey, row_number() over (order by sha256(cast(c_custkey as varchar)), c_custkey) as k, count(*) over () as n from (select distinct c_custkey from customer) a)
select c_custkey, case when k <= greatest(1, least(n - 1, round_even(n * 0.2, 0))) then 'eval' else 'train' end as split from h""")
def hash_split(t: Inputs):
    return splits.hash_split(t.table("customer"), "c_custkey", 0.2, "", "eval", "train")


@query("""
with a as (select c_custkey, c_mktsegment = 'BUILDING' as ann from customer), n as (select count(*) as n from a),
q as (select part, rank, n * share // 100 as base, n * share % 100 as lost, n from n, (values ('train', 1, 70), ('eval', 2, 15), ('test', 3, 15)) v(part, rank, share)),
z as (select part, base + case when row_number() over (order by lost desc, rank) <= n - sum(base) over () then 1 else 0 end as size from q),
ts as (select c_custkey from (select c_custkey, row_number() over (order by sha256('annotated_test:7:' || c_custkey), c_custkey::varchar) as k from a where ann) x where k <= (select size from z where part = 'test')),
r as (select c_custkey, row_number() over (order by sha256('train_eval_split:7:' || c_custkey), c_custkey::varchar) as k from a where c_custkey not in (select c_custkey from ts))
select c_custkey, 'test' as split from ts union all select c_custkey, case when k <= (select size from z where part = 'eval') then 'eval' else 'train' end from r""")
def three_way_split(t: Inputs):
    customers = t.table("customer")
    return splits.three_way_split(customers, customers.filter("c_mktsegment = 'BUILDING'"), "c_custkey", 7)


@query("""
select c_custkey, case when row_number() over (order by c_custkey) > count(*) over () - ceil(count(*) over () * 0.2) then 'eval' else 'train' end as split from customer""")
def tail_split(t: Inputs):
    return splits.tail_split(t.table("customer"), "c_custkey", 0.2)


@query(f"""
with {MOTION}, s as (select video_id, track_id, frame_index, obj_vx as vx, obj_vz as vz from motion), d as (select *, lag(vx) over w as pvx, lag(vz) over w as pvz, (frame_index - lag(frame_index) over w) / 2.0 as dt from s window w as (partition by video_id, track_id order by frame_index)),
r as (select video_id, track_id, frame_index, 'acceleration_bound' as "constraint", sqrt(pow(vx-pvx,2)+pow(vz-pvz,2)) / dt as raw, sqrt(pow(vx-pvx,2)+pow(vz-pvz,2)) / dt / 20.0 as z from d where dt > 0 union all select video_id, track_id, frame_index, 'speed_bound', sqrt(vx*vx+vz*vz), sqrt(vx*vx+vz*vz) / 15.0 from d)
select video_id, track_id, frame_index, "constraint", round(raw, 6) as raw, round(z, 6) as normalized, case when z >= 3 then 'hard_violation' when z >= 2 then 'violation' when z >= 1 then 'warning' else 'info' end as severity from r""")
def physics_residuals(t: Inputs):
    return rounded(physics(t), "video_id", "track_id", "frame_index", "constraint", "raw", "normalized", "severity")


def physics(t: Inputs):
    m = tracks.relative_motion(t.track_obs(), ego(t)).select("video_id", "track_id", "frame_index", C("obj_vx").alias("vx"), C("obj_vz").alias("vz"))
    return residuals.physics_bounds(m, 20.0, 15.0, 2.0, 2.0, 3.0)


@query(f"""
with {MOTION}, s as (select video_id, track_id, frame_index, obj_vx as vx, obj_vz as vz from motion), d as (select *, lag(vx) over w as pvx, lag(vz) over w as pvz, (frame_index - lag(frame_index) over w) / 2.0 as dt from s window w as (partition by video_id, track_id order by frame_index)),
r as (select video_id, 'acceleration_bound' as "constraint", sqrt(pow(vx-pvx,2)+pow(vz-pvz,2)) / dt / 20.0 as z from d where dt > 0 union all select video_id, 'speed_bound', sqrt(vx*vx+vz*vz) / 15.0 from d),
p as (select video_id, "constraint", count(*) as n, max(z) as peak, count_if(z >= 2) as conflicts, avg(z*z) as ms from r group by 1, 2)
select video_id, "constraint", n, round(peak, 6) as peak, conflicts, round(ms, 6) as mean_square, round(sum(case "constraint" when 'speed_bound' then 0.25 else 0.75 end * ms) over (partition by video_id), 6) as objective from p""")
def residual_packets(t: Inputs):
    packets = shared(residuals.family_packets(physics(t), 2.0))
    total = residuals.objective(packets, {"speed_bound": 0.25, "acceleration_bound": 0.75})
    return rounded(packets.join(total, "video_id"), "video_id", "constraint", "n", "peak", "conflicts", "mean_square", "objective")


@query("""
with d as (select *, frame_index - lag(frame_index) over (partition by video_id, track_id order by frame_index) - 1 as g from v_track_obs)
select video_id, track_id, max(g) as largest_gap, min(frame_index) as start_frame, max(frame_index) as end_frame, round(max(g) / 5.0, 6) as normalized from d group by 1, 2 having max(g) > 0""")
def identity_gaps(t: Inputs):
    return rounded(residuals.identity_gaps(t.track_obs().select("video_id", "track_id", "frame_index"), 5), "video_id", "track_id", "largest_gap", "start_frame", "end_frame", "normalized")


@query("""
with c as (select video_id, track_id, median(x) as cx, median(z) as cz from v_track_obs group by 1, 2),
g as (select o.video_id, o.track_id, count(*) as n, median(sqrt(pow(x-cx,2)+pow(z-cz,2))) as mr, median(2 * score) as mn, sqrt(pow(arg_max(x, frame_index)-arg_min(x, frame_index),2)+pow(arg_max(z, frame_index)-arg_min(z, frame_index),2)) as disp from v_track_obs o join c on c.video_id = o.video_id and c.track_id = o.track_id group by 1, 2),
m as (select *, greatest(disp, 2 * mr) as motion, 1.5 * mn as u from g)
select video_id, track_id, n, round(motion, 6) as motion, case when n < 8 then 'unobservable' when motion + u <= 25 then 'static' when greatest(0, motion - u) >= 40 then 'moving' else 'ambiguous' end as state from m""")
def motion_classes(t: Inputs):
    classes = lambda rows, whole: residuals.motion_classes(rows if whole else shared(rows), 8, 1.5, 25.0, 40.0, 2 * C("score"), whole)
    return rounded(t.by_length(classes), "video_id", "track_id", "n", "motion", "state")


@query("""
with i as (select *, greatest(2 * score, 0.5) as std from v_track_obs where frame_index between 23960 and 23990), s as (select video_id, track_id, count(*) as n, min(frame_index) as f0, max(frame_index) as f1, arg_min(z, frame_index) as v0, arg_max(z, frame_index) as v1 from i group by 1, 2),
j as (select i.*, n, f0, f1, greatest(-2 * std, least(2 * std, 0.5 * ((1 - (frame_index - f0) / (f1 - f0)) * v0 + (frame_index - f0) / (f1 - f0) * v1 - z))) as sh from i join s on s.video_id = i.video_id and s.track_id = i.track_id where n >= 3 and frame_index > f0 and frame_index < f1)
select video_id, track_id, frame_index, round(z + sh, 6) as updated, round(abs(sh) / std, 6) as standardized from j""")
def scoped_smoothing(t: Inputs):
    out = residuals.smooth_scope(t.track_obs(), tracks.TRACK, 23960, 23990, 0.5, 2.0, 0.5, "z", 2 * C("score"))
    return rounded(out, "video_id", "track_id", "frame_index", "updated", "standardized")


@query("""
select frame_index, source as modality, count(*) as input, count_if(score >= 0.9) as selected, count_if(score < 0.9 and score >= 0.7) as unselected, count_if(score < 0.7) as invalid from v_boxes group by 1, 2""")
def evidence_accounts(t: Inputs):
    d = F.when(C("score") >= 0.9, "selected").when(C("score") >= 0.7, "unselected").otherwise("invalid")
    return residuals.evidence_accounts(t.boxes().withColumn("modality", C("source")), d, ["selected", "unselected", "invalid"])


@query("""
with c as (select video_id, label, count(*) as n, min(frame_index) as f from v_signal group by 1, 2), k as (select *, row_number() over (partition by video_id order by n desc, f) as k from c)
select video_id, label as majority, n as votes from k where k = 1""")
def majority_labels(t: Inputs):
    return summaries.majority(t.signal(), ["video_id"], "label", "frame_index")


@query("""
select label, count(*) as "rows", count(distinct video_id) as videos, count(distinct video_id * 1000 + track_id) as tracks, count(distinct frame_index) as frames from v_track_obs group by 1""")
def class_coverage(t: Inputs):
    return summaries.distinct_counts(
        shared(t.track_obs()), "label",
        {"videos": C("video_id"), "tracks": C("video_id") * 1000 + C("track_id"), "frames": C("frame_index")},
    )


@query("""
with s as (select lower(object_class) as cls, 'objects' as stage, count(*) as n from v_objects group by 1 union all select lower(val), 'atoms', count(*) from v_atoms where pred = 'object_class' group by 1
  union all select lower(o.object_class), 'labelled', count(*) from v_objects o join v_examples e on e.video_id = o.video_id and e.segment_index = o.segment_index where e.label group by 1)
select cls, coalesce(cast(sum(n) filter (where stage = 'objects') as bigint), 0) as objects, coalesce(cast(sum(n) filter (where stage = 'atoms') as bigint), 0) as atoms, coalesce(cast(sum(n) filter (where stage = 'labelled') as bigint), 0) as labelled from s group by 1""")
def coverage_funnel(t: Inputs):
    objects = shared(t.objects()).withColumn("cls", F.lower("object_class"))
    positive = t.examples().filter("label").select("video_id", "segment_index")
    atoms = t.atoms().filter("pred = 'object_class'").select(F.lower("val").alias("cls"))
    stages = {"objects": objects.select("cls"), "atoms": atoms, "labelled": objects.join(positive, ["video_id", "segment_index"]).select("cls")}
    return summaries.stage_funnel(stages, "cls", ["objects", "atoms", "labelled"])


@query("""
with c as (select video_id, frame_index, k.id, case when vz > k.th then 'left' when vz < -k.th then 'static' else 'forward' end as state, k.conf from v_settled_signal, (values (0, 10.0, 0.5), (1, 40.0, 0.3), (2, 160.0, 0.2)) k(id, th, conf))
select video_id, frame_index, round(coalesce(sum(conf) filter (where state = 'static'), 0), 6) as static, round(coalesce(sum(conf) filter (where state = 'forward'), 0), 6) as forward, round(coalesce(sum(conf) filter (where state = 'left'), 0), 6) as "left" from c group by 1, 2""")
def frame_votes(t: Inputs):
    # the candidates of a frame are an array in its row: votes are summed without multiplying or shuffling rows
    candidates = [(10.0, 0.5), (40.0, 0.3), (160.0, 0.2)]
    vz = C("vz")
    vote = lambda test: sum((F.when(test(th), conf).otherwise(0.0) for th, conf in candidates), F.lit(0.0))
    return t.settled_signal().select(
        "video_id", "frame_index",
        settled(vote(lambda th: vz < -th)).alias("static"),
        settled(vote(lambda th: (vz >= -th) & (vz <= th))).alias("forward"),
        settled(vote(lambda th: vz > th)).alias("left"),
    )


@query("""
with v as (select distinct event_type, user_id, cast(ts as date) as d, value > 100 as good from events), g as (select event_type, user_id, count_if(good) as pos, count_if(not good) as neg from v group by 1, 2)
select event_type, user_id, pos, neg, case when pos > 0 and pos >= neg then 'positive' when neg > 0 and neg > pos then 'negative' else 'neutral' end as pseudo_label from g""")
def pseudo_labels(t: Inputs):
    votes = t.table("events").select("event_type", "user_id", F.to_date("ts").alias("d"), (C("value") > 100).alias("good")).distinct()
    agg = votes.groupBy("event_type", "user_id").agg(F.count_if(C("good")).alias("pos"), F.count_if(~C("good")).alias("neg"))
    label = F.when((C("pos") > 0) & (C("pos") >= C("neg")), "positive").when((C("neg") > 0) & (C("neg") > C("pos")), "negative").otherwise("neutral")
    return agg.withColumn("pseudo_label", label)


@query("""
select case when grouping(label) = 0 then 'class' when grouping(source) = 0 then 'source' else 'index' end as kind, coalesce(label, source, cast(det_index as varchar)) as value, round(avg(score - 0.8), 6) as bonus, count(*) as n from v_boxes group by grouping sets ((label), (source), (det_index))""")
def mean_bonuses(t: Inputs):
    kind = F.when(F.grouping("label") == 0, "class").when(F.grouping("source") == 0, "source").otherwise("index")
    value = F.coalesce("label", "source", C("det_index").cast("string"))
    sets = t.boxes().groupingSets([[C("label")], [C("source")], [C("det_index")]], "label", "source", "det_index")
    out = sets.agg(kind.alias("kind"), value.alias("value"), F.avg(C("score") - 0.8).alias("bonus"), F.count("*").alias("n"))
    return rounded(out, "kind", "value", "bonus", "n")


@query("""
with w as (select video_id, segment_index, track_id, x_state as state, case distance_state when 'near' then 3.0 when 'medium' then 2.0 else 1.0 end as w from v_objects), g as (select video_id, segment_index, state, sum(w) as w from w group by 1, 2, 3),
k as (select *, sum(w) over (partition by video_id, segment_index) as tot, row_number() over (partition by video_id, segment_index order by w desc, state) as k from g) select video_id, segment_index, state, round(w / tot, 6) as share from k where k = 1""")
def weighted_state_votes(t: Inputs):
    w = F.when(C("distance_state") == "near", 3.0).when(C("distance_state") == "medium", 2.0).otherwise(1.0)
    g = t.objects().groupBy("video_id", "segment_index", C("x_state").alias("state")).agg(F.sum(w).alias("w"))
    # three states per segment: a bounded group; ties go to the first name
    ranked = F.array_sort(F.collect_list(F.struct((-C("w")).alias("k"), "state")))
    best = g.groupBy("video_id", "segment_index").agg(ranked[0].alias("m"), F.sum("w").alias("total"))
    return best.select("video_id", "segment_index", C("m.state").alias("state"), settled(-C("m.k") / C("total")).alias("share"))


@query("""
with l as (select video_id, track_id, count(*) as n from v_track_obs group by 1, 2) select case when n < 5 then '1-4' when n < 10 then '5-9' when n < 20 then '10-19' else '20+' end as length_range, count(*) as tracks, min(n) as shortest, max(n) as longest from l group by 1""")
def track_length_ranges(t: Inputs):
    n = C("n")
    band = F.when(n < 5, "1-4").when(n < 10, "5-9").when(n < 20, "10-19").otherwise("20+")
    lengths = t.track_obs().groupBy("video_id", "track_id").agg(F.count("*").alias("n"))
    return lengths.groupBy(band.alias("length_range")).agg(F.count("*").alias("tracks"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


@query("""
with b as (select video_id, track_id, frame_index, x > -20 as big from v_track_obs) select video_id, track_id, frame_index from (select *, count(*) over (partition by video_id, track_id) as n from b where big) a where n >= 10""")
def usable_observations(t: Inputs):
    big = t.track_obs().filter("x > -20").select("video_id", "track_id", "frame_index")
    enough = big.groupBy("video_id", "track_id").agg(F.count("*").alias("n")).filter("n >= 10")
    return big.join(enough, ["video_id", "track_id"], "left_semi")


@query("""
with a as (select c_custkey as id from customer where c_acctbal > 0), p as (select distinct o_custkey as id from orders where o_orderstatus = 'F'), q as (select distinct o_custkey as id from orders where o_totalprice > 400000)
select coalesce(a.id, p.id) as id, case when p.id is null then 'missing' when q.id is not null then 'invalid' when a.id is null then 'unannotated' else 'matched' end as status from a full join p on p.id = a.id left join q on q.id = coalesce(a.id, p.id)""")
def eligibility(t: Inputs):
    annotated = t.table("customer").filter("c_acctbal > 0").select(C("c_custkey").alias("id")).withColumn("a", F.lit(True))
    orders = t.table("orders")
    predicted = orders.filter("o_orderstatus = 'F'").select(C("o_custkey").alias("id")).distinct().withColumn("p", F.lit(True))
    invalid = orders.filter("o_totalprice > 400000").select(C("o_custkey").alias("id")).distinct().withColumn("q", F.lit(True))
    status = F.when(C("p").isNull(), "missing").when(C("q"), "invalid").when(C("a").isNull(), "unannotated").otherwise("matched")
    return annotated.join(predicted, "id", "full_outer").join(invalid, "id", "left").select("id", status.alias("status"))


@query("""
select frame_index, det_index, label, x1, case when source = 'gt' then 'accepted' when x2 - x1 < 22 then 'too_narrow' when y2 > 34 then 'too_low' when score < 0.7 then 'low_score' else 'candidate' end as branch from v_boxes""")
def branch_decisions(t: Inputs):
    branch = (
        F.when(C("source") == "gt", "accepted").when(C("x2") - C("x1") < 22, "too_narrow").when(C("y2") > 34, "too_low")
        .when(C("score") < 0.7, "low_score").otherwise("candidate")
    )
    return t.boxes().select("frame_index", "det_index", "label", "x1", branch.alias("branch"))


@query("""
with s as (select video_id, start_frame, end_frame, label from v_runs), p as (select *, lag(end_frame) over (partition by video_id order by start_frame, end_frame) as pe from (select video_id, start_frame + start_frame % 4 as start_frame, end_frame, label from s) a)
select video_id, 'gap' as problem, count(*) as n from p where start_frame > pe + 1 group by 1 union all select video_id, 'inverted', count(*) from p where end_frame < start_frame group by 1
 union all select video_id, 'unknown_label', count(*) from p where label not in ('forward', 'static') group by 1 union all select video_id, 'overlap', count(*) from p where start_frame <= pe group by 1""")
def annotation_problems(t: Inputs):
    from trackloom.operators.quality_checks import segment_problems

    shifted = t.truth_runs().withColumn("start_frame", C("start_frame") + C("start_frame") % 4)
    return segment_problems(shifted.select("video_id", "start_frame", "end_frame", "label"), ["video_id"], ["forward", "static"])


@query("""
with p as (select o_custkey as id, case when o_orderdate < timestamp '1998-01-01' then 'train' else 'eval' end as part from orders), d as (select id, string_agg(distinct part, ',' order by part) as parts from p group by 1 having count(distinct part) > 1)
select parts, count(*) as shared from d group by 1""")
def split_separation(t: Inputs):
    part = F.when(C("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "train").otherwise("eval")
    return splits.shared_ids(t.table("orders").select(C("o_custkey").alias("id"), part.alias("part")), "id", "part")


@query("""
with h as (select video_id, segment_index, forward_label, lag(forward_label, 2) over w as a, lag(forward_label, 1) over w as b from v_segments window w as (partition by video_id order by segment_index))
select video_id, segment_index, coalesce(a, '-') || '|' || coalesce(b, '-') || '|' || forward_label as history, case when a is not null then 2 when b is not null then 1 else 0 end as available from h""")
def history_windows(t: Inputs):
    from trackloom.operators.signals import history

    s = t.segments().select("video_id", "segment_index", "forward_label")
    out = history(s, ["video_id"], "segment_index", "forward_label", 2, "-")
    return out.select("video_id", "segment_index", F.array_join("history", "|").alias("history"), "available")


@query("""
with h as (select video_id, track_id, avg(score) as score, count(*) as n from v_track_obs group by 1, 2), k as (select *, row_number() over (partition by video_id order by round(score, 9) desc, n desc, track_id) as k from h)
select video_id, track_id, round(score, 6) as score, cast(k as int) as place from k where k <= 3""")
def best_hypotheses(t: Inputs):
    from trackloom.operators.selection import best_in_group

    h = t.track_obs().groupBy("video_id", "track_id").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    out = best_in_group(h, ["video_id"], [F.round("score", 9).desc(), F.desc("n"), C("track_id")], 3)
    return rounded(out.withColumn("place", C("rank_in_group")), "video_id", "track_id", "score", "place")


#: A detection farther from an object than this doesn't find it.
MATCH_RADIUS = 12.0


@query(f"""
with recursive c as (select frame_index, det_index, source, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from v_boxes),
o as (select d.frame_index, d.det_index as d, list(struct_pack(far := sqrt(pow(d.cx - g.cx, 2) + pow(d.cy - g.cy, 2)), g := g.det_index) order by sqrt(pow(d.cx - g.cx, 2) + pow(d.cy - g.cy, 2)), g.det_index) as options
  from c d join c g on g.frame_index = d.frame_index and d.source = 'det' and g.source = 'gt' and sqrt(pow(d.cx - g.cx, 2) + pow(d.cy - g.cy, 2)) <= {MATCH_RADIUS} group by 1, 2),
k as (select *, row_number() over (partition by frame_index order by d) as k from o),
walk as (select distinct frame_index, 0::bigint as k, []::bigint[] as used, 0.0::double as far from k
  union all select frame_index, k, case when pick is null then used else list_append(used, pick.g::bigint) end, far + coalesce(pick.far, 0.0) from (
    select w.frame_index, k.k, w.used, w.far, list_filter(k.options, lambda x: not list_contains(w.used, x.g::bigint))[1] as pick from walk w join k on k.frame_index = w.frame_index and k.k = w.k + 1) s),
m as (select coalesce(sum(len(used)), 0)::bigint as hits, coalesce(sum(far), 0) as far from (select *, max(k) over (partition by frame_index) as last from walk) x where k = last),
n as (select count(*) filter (where source = 'gt') as truth, count(*) filter (where source = 'det') as found from v_boxes)
select hits, found - hits as false_alarms, truth - hits as misses, round(hits / found, 6) as precision, round(hits / truth, 6) as recall, round(2.0 * hits / (found + truth), 6) as f1, round(far / hits, 6) as mean_position_error from m, n""")
def pooled_detection_rates(t: Inputs):
    from trackloom.operators.matching import pooled_position_rates

    at = lambda a, b: (C(a) + C(b)) / 2
    boxes = t.boxes().select("frame_index", "det_index", "source", at("x1", "x2").alias("cx"), at("y1", "y2").alias("cy"))
    out = pooled_position_rates(boxes, ["frame_index"], "det_index", MATCH_RADIUS)
    return rounded(out, "hits", "false_alarms", "misses", "precision", "recall", "f1", "mean_position_error")

