"""Refinement of rule sets, learned weights, repair and diagnostic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.numbers import settled
from trackloom.operators import components, learning, masking, metrics, repair, reports, reselection, rules, selection, tracks
from trackloom.plans import rulebook
from trackloom.plans.catalog import query, rounded
from trackloom.plans.rulebook import MASK, MATCH, PREDICT, RULESET, UNARY, HEAD, CLAUSE1, SELECTED
from trackloom.plans.views import Inputs, shared

C = F.col
#: A calibration loop ends after so many rounds.
MOST_ITERATIONS = 6

SUMMARY = f"""{MASK}, su as (select rule_id, count(*) as triggers, count_if(flipped) as flips, count_if(influence = 'helpful_for_correct_prediction') as helpful, count_if(influence = 'harmful_causal_source') as harmful,
  count_if(influence = 'helpful_for_correct_prediction' and label) as ntp, count_if(influence = 'harmful_causal_source' and not label) as cfp, count_if(influence = 'non_decisive_contribution') as minor, count_if(influence = 'redundant_trigger') as redundant from mi group by 1)"""


def summary(t: Inputs):
    return masking.rule_summary(rulebook.masked(t))


@query(f"""
with {SUMMARY} select s.rule_id, case when helpful = 0 and harmful > 0 then 'harmful_false_positive_rule' when helpful > 0 and harmful > 0 then 'mixed_rule' when ntp > 0 and cfp > 0 then 'mixed_rule' when ntp > 0 and harmful = 0 then 'necessary_positive_rule'
   when flips = 0 or (redundant > helpful and redundant > harmful and redundant > minor) then 'redundant_rule' when helpful > 0 then 'necessary_positive_rule' else 'mixed_rule' end as causal_class,
  round(rs.confidence + helpful + 3 * ntp - 3 * harmful - 2 * cfp + 0.5, 6) as score,
  case when helpful = 0 and harmful > 0 and ntp = 0 then 'pure_harmful' when harmful > 0 and harmful >= 2 * greatest(1, helpful) and ntp = 0 then 'harmful_dominant' when helpful - harmful < 0 and ntp = 0 then 'net_harmful' else '' end as removal
from su s join rs on rs.rule_id = s.rule_id""")
def causal_classes(t: Inputs):
    joined = summary(t).join(rulebook.rule_set(t).select("rule_id", "confidence"), "rule_id")
    no = F.lit(False)
    return joined.select(
        C("rule_id").cast("bigint").alias("rule_id"),
        reselection.causal_class(no).alias("causal_class"),
        settled(reselection.reselection_score(C("confidence"), F.lit(True), no)).alias("score"),
        reselection.removal_reason("aggressive").alias("removal"),
    )


@query(f"""
with {RULESET}, sel as (select * from rs where rule_id <= {SELECTED}), rem as (select rule_id from rs where rule_id in (2, 5)), fr as (select rule_id, row_number() over (order by rule_id) as k from rs where rule_id > {SELECTED})
select rule_id, 'kept' as origin from sel where rule_id not in (select rule_id from rem) union all select rule_id, 'refill' from fr where k <= 2""")
def refilled_rules(t: Inputs):
    pool = rulebook.rule_set(t)
    out = reselection.refill(pool.filter(C("rule_id") <= SELECTED), pool, pool.filter("rule_id in (2, 5)"), [C("rule_id")], SELECTED)
    return out.select(C("rule_id").cast("bigint").alias("rule_id"), "origin")


@query(f"""
with {RULESET}, w as (select rule_id, ln((confidence + 0.01) / (1 - confidence + 0.01)) as weight from rs), m as (select rule_id, fa.example_id from rs join fa on fa.template = rs.t1 where t2 is null union select rule_id, pe.example_id from rs join pe on pe.t1 = rs.t1 and pe.t2 = rs.t2),
s as (select example_id, sum(weight) as a, sum(case when m.rule_id <= 5 then weight else 0 end) as b, sum(case when weight < 0 then weight else 0 end) as c from m join w on w.rule_id = m.rule_id group by 1)
select example_id, round(1 / (1 + exp(-(a - 0.1))), 6) as all_rules, round(1 / (1 + exp(-(b - 0.1))), 6) as top_five, round(1 / (1 + exp(-(c - 0.1))), 6) as negative_only from s""")
def weight_subset_scores(t: Inputs):
    # the weight of a rule follows from its confidence; a list of fired rules is one example's
    weight = lambda r: F.log((rulebook.confidence_of(r) + 0.01) / (1 - rulebook.confidence_of(r) + 0.01))
    subsets = {"all_rules": lambda w: F.lit(True), "top_five": lambda w: w["rule_id"] <= 5, "negative_only": lambda w: w["weight"] < 0}
    rows = rulebook.firings(t).filter(F.size("fired") > 0)
    rows = rows.withColumn("weighted", F.transform(F.array_sort("fired"), lambda r: F.struct(r.alias("rule_id"), weight(r).alias("weight"))))
    return rounded(learning.listed_subset_scores(rows, "weighted", -0.1, subsets), "example_id", *subsets)


@query("""
with f as (select example_id, 'predicate::' || pred as feature from v_atoms union all select example_id, 'state::' || pred || '::' || lower(val) from v_atoms), c as (select example_id, feature, count(*) as n from f group by 1, 2),
d as (select feature, count(*) as documents, cast(sum(n) as bigint) as total from c group by 1 having count(*) >= 100) select feature, documents, total, row_number() over (order by feature) - 1 as "index" from d""")
def bag_of_atoms(t: Inputs):
    counts = shared(learning.feature_counts(t.atoms(), F.lower("val")))
    total = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return learning.vocabulary(counts, 100).join(total, "feature").select("feature", "documents", "total", "index")


@query()
def rule_firing_vectors(t: Inputs):
    from pyspark.ml.functions import vector_to_array

    vectors = learning.listed_vectors(rulebook.bindings(t).withColumn("fired", F.array_distinct("fired")), rulebook.rule_set(t).count())
    return vectors.select("example_id", "label", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, v: a + v).alias("fired"))


@query()
def rule_weights(t: Inputs):
    # examples with the same label and rules are one weighted row
    vectors = shared(learning.listed_vectors(rulebook.alike_firings(t), rulebook.rule_set(t).count()))
    number = rulebook.alike(t).agg(F.sum("n")).first()[0]
    model = learning.fit_rule_weights(vectors, 1.0, number or 0, "n")
    out = learning.scored(model, vectors).select("n", C("target").cast("int").alias("label"), "score")
    return metrics.roc_auc(out.withColumn("model", F.lit("l1_rules")), ["model"], C("n")).select("model", "p", C("n"), settled(C("auc")).alias("auc"))


@query(f"""
with {UNARY}, vi as (select f.template, e.video_id, count(*) filter (where f.label) as pos, count(*) filter (where not f.label) as neg from fi f join v_examples e on e.example_id = f.example_id group by 1, 2)
select {CLAUSE1} as clause, count(*) as videos, cast(sum(pos) as bigint) as positive_support, cast(sum(neg) as bigint) as negative_support from vi group by template""")
def merged_video_rules(t: Inputs):
    f = rulebook.facts(t).join(t.examples().select("example_id", "video_id"), "example_id")
    first = f.select("example_id", "video_id", "label", "template").distinct()
    per_video = first.groupBy("template", "video_id").agg(F.count_if(C("label")).alias("pos"), F.count_if(~C("label")).alias("neg"))
    merged = per_video.groupBy("template").agg(F.count("*").alias("videos"), F.sum("pos").alias("positive_support"), F.sum("neg").alias("negative_support"))
    return rules.with_clause(merged.withColumn("body", F.array("template")), HEAD).select("clause", "videos", "positive_support", "negative_support")


@query("""
with o as (select video_id * 100000 + segment_index as example_id, 'object_class(S,O,' || lower(object_class) || ').' as template, case source when 'A' then 'accepted' when 'R' then 'candidate' else 'other' end as src from v_objects),
m as (select o.template, count(*) as firings, count_if(src = 'accepted') as accepted, count_if(src = 'candidate') as candidate, count_if(src = 'other') as other from o join v_examples e on e.example_id = o.example_id group by 1)
select template, firings, round(candidate / firings, 6) as candidate_ratio, case when accepted > 0 and candidate > 0 then 'mixed' when candidate > 0 then 'candidate_only' when accepted > 0 then 'accepted_only' else 'other' end as body_source_mix from m""")
def body_source_mix(t: Inputs):
    source = F.when(C("source") == "A", "accepted").when(C("source") == "R", "candidate").otherwise("other")
    o = t.objects().select((C("video_id") * 100000 + C("segment_index")).alias("example_id"), F.concat(F.lit("object_class(S,O,"), F.lower("object_class"), F.lit(").")).alias("template"), source.alias("src"))
    n = lambda s: F.count_if(C("src") == s).alias(s)
    agg = o.join(t.examples().select("example_id"), "example_id", "left_semi").groupBy("template").agg(F.count("*").alias("firings"), n("accepted"), n("candidate"), n("other"))
    mix = F.when((C("accepted") > 0) & (C("candidate") > 0), "mixed").when(C("candidate") > 0, "candidate_only").when(C("accepted") > 0, "accepted_only").otherwise("other")
    return agg.select("template", "firings", settled(C("candidate") / C("firings")).alias("candidate_ratio"), mix.alias("body_source_mix"))


@query(f"""
with {RULESET}, sg as (select *, case when confidence >= 0.41 then 'positive' else 'negative' end as sign, case when t2 is null then split_part(t1, '(', 1) else 'pair' end as family from al),
k as (select *, row_number() over (partition by sign, family order by round(confidence, 9) desc, clause) as k from sg)
select sign, family, count(*) as rules, round(sum(confidence - 0.41), 6) as weight, max(clause) filter (where k = 1) as top_rule from k group by 1, 2""")
def family_weights(t: Inputs):
    sign = F.when(C("confidence") >= 0.41, "positive").otherwise("negative")
    family = F.when(F.size("body") == 1, F.substring_index(C("body")[0], "(", 1)).otherwise("pair")
    pool = rulebook.all_rules(t).withColumn("sign", sign).withColumn("family", family)
    # the larger confidence wins, then the smaller clause: the smallest (-confidence, clause)
    top = F.min(F.struct((-F.round("confidence", 9)).alias("k"), "clause"))
    agg = pool.groupBy("sign", "family").agg(F.count("*").alias("rules"), F.sum(C("confidence") - 0.41).alias("weight"), top.alias("top"))
    return agg.select("sign", "family", "rules", settled(C("weight")).alias("weight"), C("top.clause").alias("top_rule"))


@query("""
with s as (select video_id, segment_index, forward_label, case when forward_label = 'forward_slowdown' then 1 else 0 end as h from v_segments),
f as (select *, max(h) over (w rows between 1 following and 1 following) as h1, max(h) over (w rows between 1 following and 3 following) as h3, count(*) over (w rows between 1 following and 3 following) as ahead from s window w as (partition by video_id order by segment_index)),
k as (select distinct o.video_id, o.segment_index, lower(o.object_class) as cls from v_objects o), b as (select avg(h1) as b1, avg(h3) as b3 from f where ahead > 0)
select cls, count(*) as seen, round(avg(h1), 6) as rate_1, round(avg(h3), 6) as rate_3, round(avg(h1) / max(b1), 6) as lift_1, count_if(h3 = 1 and h1 = 0) as delayed from k join f on f.video_id = k.video_id and f.segment_index = k.segment_index, b where ahead > 0 group by 1""")
def horizon_rates(t: Inputs):
    from trackloom.operators.ordered import near

    hit = (C("forward_label") == "forward_slowdown").cast("int")
    s = t.segments().select("video_id", "segment_index", "forward_label")
    made = near(
        s, ["video_id"], "segment_index", 3,
        h1=lambda w: F.max(hit).over(w.rowsBetween(1, 1)), h3=lambda w: F.max(hit).over(w.rowsBetween(1, 3)),
    ).filter("h3 is not null")
    flags = shared(made.select("video_id", "segment_index", "h1", "h3"))
    keys = t.objects().select("video_id", "segment_index", F.lower("object_class").alias("cls")).distinct()
    base = flags.agg(F.avg("h1").alias("b1")).withColumn("one", F.lit(1))
    agg = keys.join(flags, ["video_id", "segment_index"]).groupBy("cls").agg(
        F.count("*").alias("seen"), F.avg("h1").alias("rate_1"), F.avg("h3").alias("rate_3"), F.count_if((C("h3") == 1) & (C("h1") == 0)).alias("delayed")
    )
    # a single row with the base rate
    out = agg.withColumn("one", F.lit(1)).join(F.broadcast(base), "one").withColumn("lift_1", C("rate_1") / C("b1"))
    return rounded(out, "cls", "seen", "rate_1", "rate_3", "lift_1", "delayed")


@query(f"""
with {PREDICT}, ob as (select video_id, segment_index, count(*) as objects, bool_or(object_class = 'ECONOMY') as vehicle, bool_or(object_class = 'ECONOMY' and distance_state = 'near') as near_vehicle, bool_or(object_class = 'ECONOMY' and x_state = 'centered') as centered_vehicle from v_objects group by 1, 2),
e as (select pr.*, x.segment_index from pr join v_examples x on x.example_id = pr.example_id)
select e.example_id, e.label, predicted, coalesce(objects, 0) as objects, case when not e.label or predicted then 'not_missed' when objects is null then 'no_objects' when near_vehicle and centered_vehicle then 'vehicle_near_and_centered' when near_vehicle then 'vehicle_near' when vehicle then 'vehicle_far' else 'no_vehicle' end as miss_category,
  case when predicted and e.label then 'explained' when rules > 1 then 'several_rules' when objects is null then 'unexplainable' else 'weak' end as explainability
from e left join ob on ob.video_id = e.video_id and ob.segment_index = e.segment_index""")
def miss_categories(t: Inputs):
    is_vehicle = C("object_class") == "ECONOMY"
    context = t.objects().groupBy("video_id", "segment_index").agg(
        F.count("*").alias("objects"), F.bool_or(is_vehicle).alias("vehicle"),
        F.bool_or(is_vehicle & (C("distance_state") == "near")).alias("near_vehicle"),
        F.bool_or(is_vehicle & (C("x_state") == "centered")).alias("centered_vehicle"),
    )
    e = rulebook.predictions(t).join(context, ["video_id", "segment_index"], "left")
    missed = C("label") & ~C("predicted")
    category = (
        F.when(~missed, "not_missed").when(C("objects").isNull(), "no_objects").when(C("near_vehicle") & C("centered_vehicle"), "vehicle_near_and_centered")
        .when(C("near_vehicle"), "vehicle_near").when(C("vehicle"), "vehicle_far").otherwise("no_vehicle")
    )
    level = F.when(C("predicted") & C("label"), "explained").when(C("rules") > 1, "several_rules").when(C("objects").isNull(), "unexplainable").otherwise("weak")
    return e.select("example_id", "label", "predicted", F.coalesce("objects", F.lit(0)).alias("objects"), category.alias("miss_category"), level.alias("explainability"))


@query(f"""
with {PREDICT}, m as (select video_id, count_if(predicted and label) as tp, count_if(predicted and not label) as fp, count_if(not predicted and label) as fn, count_if(score >= 0.42 and label) as tp2, count_if(score >= 0.42 and not label) as fp2, count_if(score < 0.42 and label) as fn2 from pr group by 1),
f as (select video_id, 2.0 * tp / greatest(1, 2 * tp + fp + fn) as a, 2.0 * tp2 / greatest(1, 2 * tp2 + fp2 + fn2) as b from m)
select video_id, round(a, 6) as f1_before, round(b, 6) as f1_after, round(b - a, 6) as f1_delta, case when b + 0.01 < a then 'reject' else 'accept' end as gate from f""")
def metric_comparison(t: Inputs):
    p = shared(rulebook.predictions(t))
    before = metrics.binary_metrics(p, ["video_id"])
    after = metrics.binary_metrics(p.withColumn("predicted", C("score") >= 0.42), ["video_id"])
    out = reports.compare_metrics(before, after, ["video_id"], ["f1"])
    return rounded(out.withColumn("gate", reports.gate(F.lit(False), C("f1_before"), C("f1_after"), 0.01)), "video_id", "f1_before", "f1_after", "f1_delta", "gate")


@query(f"""
with i as (select user_id as loop, row_number() over (partition by user_id order by ts, event_id) as iteration, value / 500 as f1 from events), g as (select *, f1 - lag(f1) over (partition by loop order by iteration) as gain from i)
select loop, cast(iteration as bigint) as iteration, round(f1, 6) as f1, case when iteration >= {MOST_ITERATIONS} then 'stop_limit' when gain <= 0.01 then 'stop_no_gain' else 'continue' end as decision from g""")
def loop_decisions(t: Inputs):
    runs = t.numbered_events().select(C("user_id").alias("loop"), C("rn").alias("iteration"), (C("value") / 500).alias("f1"))
    return rounded(reports.loop_decisions(runs, "loop", 0.01, MOST_ITERATIONS), "loop", "iteration", "f1", "decision")


@query("""
with o as (select video_id, track_id, count(*) as n, max(frame_index) - min(frame_index) + 1 as span, avg(x) as mx, avg(score) as ms, max(case when label = 'R' then 1 else 0 end) as fixed from v_track_obs group by 1, 2)
select video_id, track_id, case when mx < -2 then 'left' when mx > 2 then 'right' else 'middle' end as region, case when n / span >= 0.3 then 'persistent' when n / span >= 0.15 then 'intermittent' else 'brief' end as persistence, case when fixed = 1 then 'repaired' else 'observed' end as source,
  (case when mx between -2 and 2 then 1 else 0 end + case when n / span >= 0.15 then 1 else 0 end + case when fixed = 0 then 1 else 0 end) = 3 as protected from o""")
def protected_tracks(t: Inputs):
    o = t.track_obs().groupBy("video_id", "track_id").agg(
        F.count("*").alias("n"), (F.max("frame_index") - F.min("frame_index") + 1).alias("span"), F.avg("x").alias("mx"), F.max(F.when(C("label") == "R", 1).otherwise(0)).alias("fixed")
    )
    share = C("n") / C("span")
    facts = o.select(
        "video_id", "track_id",
        F.when(C("mx") < -2, "left").when(C("mx") > 2, "right").otherwise("middle").alias("region"),
        F.when(share >= 0.3, "persistent").when(share >= 0.15, "intermittent").otherwise("brief").alias("persistence"),
        F.when(C("fixed") == 1, "repaired").otherwise("observed").alias("source"),
    )
    required = {"region": ["middle"], "persistence": ["persistent", "intermittent"], "source": ["observed"]}
    matched = sum((F.when(C(k).isin(v), 1).otherwise(0) for k, v in required.items()), F.lit(0))
    return facts.withColumn("protected", matched == len(required))


@query("""
with s as (select video_id, frame_index, greatest(0.0, least(1.0, 1 - abs(vz) / 200)) as still, greatest(0.0, least(1.0, vz / 200)) as fast, greatest(0.0, least(1.0, abs(vx) / 20)) as turn from v_signal),
r as (select video_id, frame_index, 'stopped' as h, still * (1 - turn) as sat, 1.0 as w from s union all select video_id, frame_index, 'stopped', still, 0.5 from s union all select video_id, frame_index, 'turning', turn, 1.0 from s union all select video_id, frame_index, 'driving', fast * (1 - turn), 1.0 from s),
g as (select video_id, frame_index, h, sum(sat * w) / sum(w) as score from r group by 1, 2, 3), k as (select *, row_number() over (partition by video_id, frame_index order by round(score, 9) desc, h) as k from g)
select video_id, frame_index, h as hypothesis, round(score, 6) as score from k where k = 1""")
def soft_rule_hypotheses(t: Inputs):
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    s = t.signal().select(
        "video_id", "frame_index", unit(1 - F.abs("vz") / 200).alias("still"), unit(C("vz") / 200).alias("fast"), unit(F.abs("vx") / 20).alias("turn")
    )
    # a fixed rule set: the product of its conditions per rule, the weighted mean per hypothesis, all inside the row
    rule_set = {"stopped": [([C("still"), 1 - C("turn")], 1.0), ([C("still")], 0.5)], "turning": [([C("turn")], 1.0)], "driving": [([C("fast"), 1 - C("turn")], 1.0)]}

    def product(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out * p
        return out

    mean = {h: sum((product(p) * w for p, w in rs), F.lit(0.0)) / sum(w for _, w in rs) for h, rs in rule_set.items()}
    listed = F.array(*[F.struct((-F.round(m, 9)).alias("k"), F.lit(h).alias("h"), m.alias("score")) for h, m in mean.items()])
    return s.withColumn("best", F.array_min(listed)).select("video_id", "frame_index", C("best.h").alias("hypothesis"), settled(C("best.score")).alias("score"))


@query()
def filled_gaps(t: Inputs):
    obs = t.track_obs().select("video_id", "track_id", "frame_index", "label", "score", (C("x") * 4).alias("x1"), C("y").alias("y1"), (C("x") * 4 + 100).alias("x2"), (C("y") + 60).alias("y2"))
    _, report = repair.fill_gaps(shared(obs), {"max_velocity_delta_fraction_of_diag": 2.0, "max_center_step_fraction_of_diag": 2.0})
    return report.groupBy("reason").agg(F.count("*").alias("gaps"))


@query()
def budgeted_objects(t: Inputs):
    o = t.objects().groupBy("video_id", "segment_index", C("track_id").alias("object_id")).agg(
        F.min("object_class").alias("cls"), F.min("source").alias("prior"), F.max(F.when(C("distance_state") == "near", 0.9).otherwise(0.4)).alias("score")
    )
    return rounded(repair.budgeted_objects(o, ["video_id", "segment_index"], 3, 2, 2, 0.3), "video_id", "segment_index", "object_id", "cls", "prior", "score", "reason")


@query()
def smoothed_tracks(t: Inputs):
    from trackloom.operators.ordered import by_step, row_number

    obs = by_step(tracks.TRACK, "frame_index", 8192).scan(t.track_obs().select("video_id", "track_id", "frame_index", "z"), at=row_number())
    return rounded(repair.two_way_smoothing(obs, tracks.TRACK, "at", "z", 0.55), "video_id", "track_id", "frame_index", "smoothed")


@query()
def pose_components(t: Inputs):
    edges = t.table("orders").join(t.table("customer").select("c_custkey", "c_nationkey"), C("o_custkey") == C("c_custkey"))
    pairs = edges.select(C("c_custkey").alias("a"), (C("c_custkey") - C("c_custkey") % 25 + C("c_nationkey")).alias("b")).distinct()
    found = components.connected_components(pairs)
    return found.groupBy("component").agg(F.count("*").alias("nodes"))
