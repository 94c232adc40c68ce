"""Counts per scene, episodes, rule accounts and evaluation totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.numbers import settled
from trackloom.operators import accounts, tracks
from trackloom.operators.ordered import by_step, previous
from trackloom.plans import rulebook
from trackloom.plans.catalog import query, rounded
from trackloom.plans.rulebook import MATCH, RULESET, SELECTED
from trackloom.plans.views import Inputs, shared

C = F.col
V = ["video_id"]

STEPS = """st as (select *, coalesce(vz < -40, false) as applies, coalesce(vz < -40, false) and not coalesce(nxt >= vz + 5, false) as violates
  from (select video_id, frame_index, vz, lead(vz) over (partition by video_id order by frame_index) as nxt from v_signal) s where nxt is not null)"""
# the same steps with values and rises to six decimals
SETTLED_STEPS = STEPS.replace("v_signal", "v_settled_signal").replace("nxt >= vz + 5", "round(nxt - vz, 6) >= 5")


@query("""
select e.video_id, a.pred, count(*) as atoms, count(distinct a.example_id) as examples from v_atoms a join v_examples e on e.example_id = a.example_id group by 1, 2""")
def predicate_counts(t: Inputs):
    per_example = t.atoms().groupBy("example_id", "pred").agg(F.count("*").alias("n"))
    found = per_example.join(t.examples().select("example_id", "video_id"), "example_id")
    return found.groupBy("video_id", "pred").agg(F.sum("n").alias("atoms"), F.count("*").alias("examples"))


def steps(t: Inputs):
    slow = t.signal().select("video_id", "frame_index", "vz")
    return accounts.violation_steps(slow, V, "frame_index", "vz", C("vz") < -40, C("next") >= C("vz") + 5)


@query(f"""
with {STEPS}, r as (select *, sum(c) over (partition by video_id order by frame_index) as run from (select *, case when violates = lag(violates) over (partition by video_id order by frame_index) then 0 else 1 end as c from st) a)
select video_id, min(frame_index) as start_frame, max(frame_index) as end_frame, max(frame_index) - min(frame_index) + 1 as duration from r where violates group by video_id, run""")
def violation_episodes(t: Inputs):
    return accounts.violation_episodes(steps(t), V, "frame_index")


@query(f"""
with {SETTLED_STEPS} select video_id, count(*) filter (where applies) as applications, count(*) filter (where violates) as violations, round(count(*) filter (where violates) / greatest(1, count(*) filter (where applies)), 6) as violation_rate from st group by 1""")
def violation_rates(t: Inputs):
    slow = t.settled_signal().select("video_id", "frame_index", "vz")
    settled_steps = accounts.violation_steps(slow, V, "frame_index", "vz", C("vz") < -40, settled(C("next") - C("vz")) >= 5)
    sums = settled_steps.groupBy("video_id").agg(F.count_if("applies").alias("applications"), F.count_if("violates").alias("violations"))
    rate = C("violations") / F.greatest(F.lit(1), C("applications"))
    return rounded(sums.withColumn("violation_rate", rate), "video_id", "applications", "violations", "violation_rate")


@query("""
with l as (select video_id, track_id, count(*) as life from v_track_obs group by 1, 2), o as (select video_id, count(*) as objects, cast(sum(life) as bigint) as observations, max(life) as longest from l group by 1),
f as (select video_id, count(distinct frame_index) as frames from v_track_obs group by 1)
select o.video_id, frames, objects, observations, longest, round(observations / frames, 6) as objects_per_frame, round(observations / objects, 6) as mean_life from o join f on f.video_id = o.video_id""")
def scene_summaries(t: Inputs):
    out = accounts.scene_summary(t.track_obs(), V, "track_id", "frame_index")
    return rounded(out, "video_id", "frames", "objects", "observations", "longest", "objects_per_frame", "mean_life")


@query("""
with s as (select video_id, track_id from v_track_obs group by 1, 2 having count(*) >= 12 and round(avg(score), 9) >= 0.78)
select o.video_id, o.frame_index, count(*) as selected_objects, string_agg(cast(o.track_id as varchar), ',' order by o.track_id) as tracks, round(max(o.score), 6) as best from v_track_obs o join s on s.video_id = o.video_id and s.track_id = o.track_id group by 1, 2""")
def selected_objects_by_frame(t: Inputs):
    obs = t.track_obs()
    chosen = obs.groupBy("video_id", "track_id").agg(F.count("*").alias("n"), settled(F.avg("score"), 9).alias("mean")).filter("n >= 12 and mean >= 0.78")
    met = obs.join(chosen.select("video_id", "track_id"), ["video_id", "track_id"])
    # at most the tracks of one frame
    names = F.array_join(F.transform(F.array_sort(F.collect_list("track_id")), lambda x: x.cast("string")), ",")
    out = met.groupBy("video_id", "frame_index").agg(F.count("*").alias("selected_objects"), names.alias("tracks"), F.max("score").alias("best"))
    return rounded(out, "video_id", "frame_index", "selected_objects", "tracks", "best")


@query("""
with a as (select label, case when score >= 0.9 then 'high' when score >= 0.7 then 'medium' else 'low' end as relevance, score, x1 between 15 and 35 as front from v_boxes)
select label, count(*) as objects, round(avg(score), 6) as mean_confidence, count(*) filter (where relevance in ('high', 'medium')) as relevant, count(*) filter (where front) as front_center from a group by 1""")
def attribute_state_counts(t: Inputs):
    relevant, front = C("score") >= 0.7, C("x1").between(15, 35)
    out = t.boxes().groupBy("label").agg(
        F.count("*").alias("objects"), F.avg("score").alias("mean_confidence"), F.count_if(relevant).alias("relevant"), F.count_if(front).alias("front_center")
    )
    return rounded(out, "label", "objects", "mean_confidence", "relevant", "front_center")


@query("""
select source, case when score >= 0.9 then 'high' when score >= 0.7 then 'medium' else 'low' end as relevance, case when score >= 0.8 then 'relevant' else 'irrelevant' end as bucket, count(*) as objects from v_boxes group by 1, 2, 3""")
def attribute_relevance_counts(t: Inputs):
    relevance = F.when(C("score") >= 0.9, "high").when(C("score") >= 0.7, "medium").otherwise("low")
    bucket = F.when(C("score") >= 0.8, "relevant").otherwise("irrelevant")
    return t.boxes().groupBy("source", relevance.alias("relevance"), bucket.alias("bucket")).agg(F.count("*").alias("objects"))


@query(f"""
with {RULESET}, b as (select rule_id, len, (case when t1 like 'object_%' then 1 else 0 end + case when t2 like 'object_%' then 1 else 0 end) as own from rs),
p as (select case when rule_id <= {SELECTED} then 'selected' else 'rest' end as subset, len, own from b)
select subset, count(*) as rules, count(*) filter (where own > 0) as with_object_atoms, cast(sum(own) as bigint) as object_atoms, round(avg(own / len), 6) as mean_share, round(sum(own) / count(*), 6) as mean_atoms from p group by 1""")
def rule_subset_summary(t: Inputs):
    own = F.size(F.filter("body", lambda a: a.startswith("object_")))
    rows = rulebook.rule_set(t).select(
        F.when(C("rule_id") <= SELECTED, "selected").otherwise("rest").alias("subset"), own.alias("own"), (own / F.size("body")).alias("share")
    )
    out = rows.groupBy("subset").agg(
        F.count("*").alias("rules"), F.count_if(C("own") > 0).alias("with_object_atoms"), F.sum("own").alias("object_atoms"),
        F.avg("share").alias("mean_share"), F.avg("own").alias("mean_atoms"),
    )
    return rounded(out, "subset", "rules", "with_object_atoms", "object_atoms", "mean_share", "mean_atoms")


@query(f"""
with {MATCH}, ky as (select rule_id, confidence, t1 as template from rs union all select rule_id, confidence, t2 from rs where t2 is not null),
fi2 as (select rule_id, count(*) as fired, count(*) filter (where label) as tp from ma group by 1)
select ky.template, count(*) as rules, cast(coalesce(sum(fired), 0) as bigint) as fired, cast(coalesce(sum(tp), 0) as bigint) as tp, cast(coalesce(sum(fired - tp), 0) as bigint) as fp, round(sum(confidence), 6) as weight from ky left join fi2 on fi2.rule_id = ky.rule_id group by 1""")
def rule_utility_by_template(t: Inputs):
    counts = rulebook.fired(t).groupBy("rule_id").agg(F.count("*").alias("fired"), F.count_if("label").alias("tp"))
    keyed = rulebook.rule_set(t).select("rule_id", "confidence", F.explode("body").alias("template")).join(counts, "rule_id", "left").na.fill(0, ["fired", "tp"])
    out = keyed.groupBy("template").agg(
        F.count("*").alias("rules"), F.sum("fired").alias("fired"), F.sum("tp").alias("tp"), F.sum(C("fired") - C("tp")).alias("fp"), F.sum("confidence").alias("weight")
    )
    return rounded(out, "template", "rules", "fired", "tp", "fp", "weight")


@query(f"""
with {RULESET} select len as round, clause, positive_support, negative_support, round(confidence, 6) as confidence from rs where positive_support >= 3 and confidence >= 0.3""")
def kept_rules_of_all_rounds(t: Inputs):
    kept = rulebook.rule_set(t).filter("positive_support >= 3 and confidence >= 0.3")
    return rounded(kept.withColumn("round", F.size("body")), "round", "clause", "positive_support", "negative_support", "confidence")


@query("""
select case when grouping(video_id) = 1 then 'all' else cast(video_id as varchar) end as scope, count(*) as frames, count(*) filter (where gt_label = pred_label) as agreed, round(count(*) filter (where gt_label = pred_label) / count(*), 6) as accuracy,
  round((2 * count(*) filter (where gt_label = 'forward' and pred_label = 'forward') / greatest(1, count(*) filter (where gt_label = 'forward') + count(*) filter (where pred_label = 'forward'))
   + 2 * count(*) filter (where gt_label = 'static' and pred_label = 'static') / greatest(1, count(*) filter (where gt_label = 'static') + count(*) filter (where pred_label = 'static'))
   + 2 * count(*) filter (where gt_label = 'left' and pred_label = 'left') / greatest(1, count(*) filter (where gt_label = 'left') + count(*) filter (where pred_label = 'left'))) / 3, 6) as macro_f1
from v_settled_timeline group by grouping sets ((video_id), ())""")
def video_evaluation(t: Inputs):
    def f1(label: str):
        g, p = C("gt_label") == label, C("pred_label") == label
        return 2 * F.count_if(g & p) / F.greatest(F.lit(1), F.count_if(g) + F.count_if(p))

    scope = F.when(F.grouping("video_id") == 1, "all").otherwise(C("video_id").cast("string"))
    agreed = F.count_if(C("gt_label") == C("pred_label"))
    out = t.settled_timeline().rollup("video_id").agg(
        scope.alias("scope"), F.count("*").alias("frames"), agreed.alias("agreed"), (agreed / F.count("*")).alias("accuracy"),
        ((f1("forward") + f1("static") + f1("left")) / 3).alias("macro_f1"),
    )
    return rounded(out, "scope", "frames", "agreed", "accuracy", "macro_f1")


@query("""
with v as (select distinct video_id from v_examples), n as (select count(*) as n from v), k as (select video_id, row_number() over (order by sha256('validation:7:' || video_id), video_id) as k from v)
select e.video_id, e.example_id, case when k <= least(n - 1, greatest(1, floor(n * 0.25 + 0.5))) then 'validation' else 'train' end as split from v_examples e join k on k.video_id = e.video_id, n""")
def train_validation_split(t: Inputs):
    return accounts.train_validation(shared(t.examples()), "video_id", "segment_index", "example_id", 0.25, 7)


@query("""
with p as (select video_id, track_id, frame_index, x, y, z - 10 as z, 320 + 20 * x + (frame_index % 7) as u, 240 + 15 * y as v from v_track_obs),
r as (select *, case when z > 1e-6 then sqrt(pow(320 + 400 * x / z - u, 2) + pow(240 + 400 * y / z - v, 2)) end as raw from p)
select video_id, track_id, frame_index, z > 1e-6 as evaluable, round(raw, 6) as raw, round(raw / 8, 6) as normalized, case when raw / 8 >= 3 then 'violation' when raw / 8 >= 1 then 'warning' else 'info' end as severity from r""")
def reprojection_residuals(t: Inputs):
    points = t.track_obs().select(
        "video_id", "track_id", "frame_index", "x", "y", (C("z") - 10).alias("z"), (320 + 20 * C("x") + C("frame_index") % 7).alias("u"), (240 + 15 * C("y")).alias("v")
    )
    out = accounts.reprojection_residuals(points, 400.0, (320.0, 240.0), 8.0, 3.0)
    return rounded(out, "video_id", "track_id", "frame_index", "evaluable", "raw", "normalized", "severity")


@query("""
with b as (select video_id, track_id, frame_index, z as v, score, frame_index - lag(frame_index) over (partition by video_id, track_id order by frame_index) as gap from v_track_obs),
g as (select video_id, track_id, count(*) as n, coalesce(max(gap), 0) as max_gap, coalesce(avg(gap), 0) as mean_gap, avg(score) as evidence, arg_min(v, frame_index) as st, arg_max(v, frame_index) as en, stddev_pop(v) as std, max(v) - min(v) as rng,
  coalesce(case when count(*) > 1 then regr_slope(v, frame_index) end, 0) as slope, stddev_pop(frame_index) as fs from b group by 1, 2),
h as (select *, greatest(0, least(1, 1 - sqrt(greatest(0, std*std - pow(slope*fs, 2))) / greatest(1e-6, rng, abs(en - st), std))) as coh, 1 / (1 + greatest(0, mean_gap - 1)) as gc from g)
select video_id, track_id, n, cast(max_gap as bigint) as max_gap, round(mean_gap, 6) as mean_gap, case when n < 2 then 'limited_samples' when max_gap <= 1 then 'continuous_samples' when max_gap <= 3 then 'intermittent_samples' else 'fragmented_samples' end as state,
  round(gc, 6) as gap_coherence, round(greatest(0, least(1, evidence * least(1, greatest(0, (n - 1) / 4.0)) * (0.55 * gc + 0.45 * coh))), 4) as confidence from h""")
def coherence_states(t: Inputs):
    obs = shared(t.track_obs().select(*tracks.TRACK, "frame_index", "z", "score"))
    gaps = by_step(tracks.TRACK, "frame_index", 4096).scan(obs, before=previous(C("frame_index"))).groupBy(*tracks.TRACK).agg(
        F.coalesce(F.max(C("frame_index") - C("before")), F.lit(0)).cast("bigint").alias("max_gap"),
        F.coalesce(F.avg(C("frame_index") - C("before")), F.lit(0.0)).alias("mean_gap"), F.avg("score").alias("evidence"),
    )
    fits = tracks.linear_trend(obs, tracks.TRACK, "frame_index", "z", 0.8).select(*tracks.TRACK, "n", C("coherence").alias("fit_coherence"))
    out = accounts.coherence_state(fits.join(gaps, tracks.TRACK))
    return out.select(
        *tracks.TRACK, "n", "max_gap", settled(C("mean_gap")).alias("mean_gap"), "state", settled(C("gap_coherence")).alias("gap_coherence"),
        settled(C("confidence"), 4).alias("confidence"),
    )
