"""Row-level projections: geometry, bands, labels, atoms, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import bands, geometry, scores, text
from trackloom.functions.numbers import settled
from trackloom.plans.catalog import query
from trackloom.plans.views import Inputs

C = F.col


r = settled


KEY = ["frame_index", "det_index", "source"]


@query("""
select frame_index, det_index, source, round((x1 + x2) * 0.5, 6) as cx, round((y1 + y2) * 0.5, 6) as cy,
       round(x2 - x1, 6) as w, round(y2 - y1, 6) as h, round(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)), 6) as diag,
       round((x2-x1)*(y2-y1), 6) as area, round((x2-x1) / greatest(y2-y1, 1e-6), 6) as aspect_ratio
from v_boxes""")
def box_features(t: Inputs):
    b = geometry.box()
    cx, cy = geometry.center(b)
    return t.boxes().select(
        *KEY,
        r(cx).alias("cx"),
        r(cy).alias("cy"),
        r(geometry.width(b)).alias("w"),
        r(geometry.height(b)).alias("h"),
        r(geometry.diagonal(b)).alias("diag"),
        r(geometry.area(b)).alias("area"),
        r(geometry.aspect_ratio(b)).alias("aspect_ratio"),
    )


@query("""
select frame_index, det_index, source, round(sqrt(pow(((x1+x2)/2 - 60.0)/120.0, 2) + pow(((y1+y2)/2 - 30.0)/80.0, 2)), 6) as ratio
from v_boxes""")
def center_distance_ratio(t: Inputs):
    reference = [F.lit(v) for v in (50.0, 20.0, 70.0, 40.0)]
    ratio = geometry.center_distance_ratio(geometry.box(), reference, F.lit(120.0), F.lit(80.0))
    return t.boxes().select(*KEY, r(ratio).alias("ratio"))


@query("""
select video_id, track_id, frame_index,
       case when z <= 15 then 'near' when z <= 30 then 'medium' else 'far' end as distance_state,
       case when x < -2 then 'left_of_ego' when x > 2 then 'right_of_ego' else 'centered' end as x_state,
       case when z > 0 then true else false end as in_front, sqrt(x*x + z*z) < 20 as is_close
from v_track_obs""")
def position_bands(t: Inputs):
    return t.track_obs().select(
        "video_id",
        "track_id",
        "frame_index",
        bands.distance_state(C("z")).alias("distance_state"),
        bands.position_x_state(C("x")).alias("x_state"),
        (C("z") > 0).alias("in_front"),
        (geometry.norm(C("x"), C("z")) < 20).alias("is_close"),
    )


@query("""
select video_id, frame_index,
       case when frame_index = 0 then 'vz_unknown' when vz/100 < -0.2 then 'vz_approaching' when vz/100 > 0.2 then 'vz_awaying' else 'vz_stable' end as vz_state,
       case when frame_index = 0 then 'vx_unknown' when vx/40 < -0.2 then 'vx_turning_left' when vx/40 > 0.2 then 'vx_turning_right' else 'vx_stable' end as vx_state,
       case when frame_index = 0 then 'speed_unknown' when sqrt(vx/40*(vx/40) + vz/100*(vz/100)) > 0.3 then 'rel_moving' else 'rel_static' end as speed_state
from v_signal""")
def instantaneous_states(t: Inputs):
    known, vx, vz = C("frame_index") > 0, C("vx") / 40, C("vz") / 100
    return t.signal().select(
        "video_id",
        "frame_index",
        bands.vz_state(vz, known).alias("vz_state"),
        bands.vx_state(vx, known).alias("vx_state"),
        bands.speed_state(geometry.norm(vx, vz), known).alias("speed_state"),
    )


@query("""
select video_id, track_id, frame_index, case label when 'R' then 'repaired' when 'A' then 'merged' else 'observed' end as source,
       round(least(1.0, case label when 'R' then 0.35 when 'A' then 0.2 else 0 end + case when y > 1 then 0 else 0.25 end
             + case when score > 0 then 0.2 * greatest(0.0, 1 - score) else 0 end), 6) as uncertainty
from v_track_obs""")
def observation_uncertainty(t: Inputs):
    label = C("label")
    return t.track_obs().select(
        "video_id",
        "track_id",
        "frame_index",
        F.when(label == "R", "repaired").when(label == "A", "merged").otherwise("observed").alias("source"),
        r(scores.observation_uncertainty(label == "R", label == "A", C("y") > 1, C("score"))).alias("uncertainty"),
    )


@query("""
select video_id, frame_index, round(case when label = 'click' then vz when label = 'view' and not isnan(vx) then vx + 1 else vx - 1 end, 6) as signal
from v_signal""")
def first_finite_signal(t: Inputs):
    refined = F.when(C("label") == "click", C("vz"))
    smoothed = F.when(C("label") == "view", C("vx") + 1).otherwise(F.lit(float("nan")))
    raw = C("vx") - 1
    finite = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return t.signal().select(
        "video_id", "frame_index", r(F.coalesce(finite(refined), finite(smoothed), finite(raw))).alias("signal")
    )


@query("""
select video_id, frame_index, case when vz < -20 then 'backward' when vz > 20 then 'forward' else 'static' end as forward_label,
       case when vx < -5 then 'right' when vx > 5 then 'left' else 'straight' end as lateral_label
from v_signal""")
def threshold_labels(t: Inputs):
    return t.signal().select(
        "video_id",
        "frame_index",
        bands.three_way(C("vz"), 20, "backward", "static", "forward").alias("forward_label"),
        bands.three_way(C("vx"), 5, "right", "straight", "left").alias("lateral_label"),
    )


@query("""
select video_id, segment_index, forward_label || '|' || lateral_label as combined, forward_label as forward_part,
       case when segment_index % 2 = 0 then lateral_label else 'straightforward' end as lateral_part
from v_segments""")
def combined_axis_labels(t: Inputs):
    combined = text.combined_label(C("forward_label"), C("lateral_label"))
    partial = F.when(C("segment_index") % 2 == 0, combined).otherwise(C("forward_label"))
    forward, lateral = text.split_label(partial)
    return t.segments().select(
        "video_id",
        "segment_index",
        combined.alias("combined"),
        forward.alias("forward_part"),
        lateral.alias("lateral_part"),
    )


@query("""
select video_id, segment_index,
       case when lateral_label in ('left','right') then lateral_label when forward_label = 'stopping' then 'static' else 'forward' end as motion
from v_segments""")
def canonical_motion_labels(t: Inputs):
    raw = F.concat_ws("|", F.upper("forward_label"), C("lateral_label"))
    return t.segments().select("video_id", "segment_index", text.canonical_motion(raw).alias("motion"))


@query(r"""
with s as (select p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_brand || ' ' || p_name)), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') as sym,
                  trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') as tok from part)
select p_partkey, sym as symbol, case when regexp_matches(cast(p_partkey as varchar) || sym, '^[0-9]') then 'n_' || cast(p_partkey as varchar) || '_' || sym else sym end as numbered,
       case tok when 'economy' then 'vehicle' when 'promo' then 'person' else tok end as class_name from s""")
def symbols(t: Inputs):
    name = F.concat_ws(" ", "p_brand", "p_name")
    return t.table("part").select(
        "p_partkey",
        text.symbol(name).alias("symbol"),
        text.symbol(F.concat_ws(" ", C("p_partkey").cast("string"), name)).alias("numbered"),
        text.class_token(C("p_type"), {"economy": "vehicle", "promo": "person"}).alias("class_name"),
    )


@query("""
select video_id, segment_index, track_id, source,
       'object_class(seg_' || segment_index || ',obj_' || track_id || ',' || lower(object_class) || ').' as atom,
       'object_class' as pred, 'obj_' || track_id as second_arg, 'object_class(S,O,' || lower(object_class) || ').' as template,
       'obj_' || track_id as bound_o, case when track_id = segment_index then 'agree' else 'differ' end as repeated
from v_objects""")
def atoms_and_bindings(t: Inputs):
    seg = F.concat(F.lit("seg_"), C("segment_index"))
    obj = F.concat(F.lit("obj_"), C("track_id"))
    cls = F.lower("object_class")
    atom = text.make_atom("object_class", seg, obj, cls)
    template = text.make_atom("object_class", F.lit("S"), F.lit("O"), cls)
    bound = text.template_bindings(C("template"), C("atom"))
    pair = text.make_atom("p", C("track_id").cast("string"), C("segment_index").cast("string"))
    return (
        t.objects()
        .withColumn("atom", atom)
        .withColumn("template", template)
        .select(
            "video_id",
            "segment_index",
            "track_id",
            "source",
            "atom",
            text.atom_predicate(C("atom")).alias("pred"),
            text.atom_args(C("atom"))[1].alias("second_arg"),
            text.abstract_atom(C("atom")).alias("template"),
            bound["O"].alias("bound_o"),
            F.when(text.template_bindings(F.lit("p(O,O)."), pair).isNull(), "differ").otherwise("agree").alias("repeated"),
        )
    )


@query("""
select p_partkey, 'brake_next(S) :- ' || case when lower(p_type) <= lower(p_brand) then 'b(S,' || lower(p_type) || '), b(S,' || lower(p_brand) || ')'
       else 'b(S,' || lower(p_brand) || '), b(S,' || lower(p_type) || ')' end || '.' as clause, 'brake_next(S)' as head, 2 as body_atoms
from part""")
def clauses(t: Inputs):
    atom = lambda c: text.make_atom("b", F.lit("S"), F.lower(c))
    rendered = text.clause(F.lit("brake_next"), F.array(atom("p_type"), atom("p_brand"), atom("p_type")))
    return t.table("part").select("p_partkey", rendered.alias("clause")).select(
        "p_partkey",
        "clause",
        text.clause_head(C("clause")).alias("head"),
        F.size(text.clause_body(C("clause"))).alias("body_atoms"),
    )


@query("""
select video_id, track_id, frame_index, case when score >= 0.67 then 'high' when score >= 0.34 then 'medium' else 'low' end as score_state,
       case when score >= 0.9 then 'persistent' when score >= 0.75 then 'intermittent' else 'brief' end as visibility
from v_track_obs""")
def summary_bands(t: Inputs):
    return t.track_obs().select(
        "video_id",
        "track_id",
        "frame_index",
        bands.score_state(C("score")).alias("score_state"),
        bands.visibility_state(C("score"), 0.9, 0.75).alias("visibility"),
    )


@query("""
select l_orderkey, l_linenumber, l_partkey,
  round(0.30 * (1 - l_discount) + 0.15 * (1 - 5 * l_tax) + 0.20 * greatest(1 - l_tax, 1 - l_discount, l_quantity / 50) + 0.15 * (l_quantity / 50) + 0.10 * l_discount
    + 0.10 * case when l_discount * 10 > 0.5 then l_discount * 10 when l_returnflag = 'A' then 0.6 when l_returnflag = 'N' then 0.8 else 0.3 end, 6) as score,
  round(0.45 * (1 - l_discount) + 0.25 * l_discount + 0.15 * l_tax + 0.1 * case when l_quantity > 10 then 1 else 0 end - 0.35 * l_tax, 6) as gate,
  round(0.35 * (1 - l_discount) + 0.2 * l_tax + 0.2 * l_quantity / 50 + 0.2 * l_discount - 0.25 * least(l_quantity / 40, 1.0), 6) as track
from lineitem""")
def detection_scores(t: Inputs):
    d, tax, q, flag = C("l_discount"), C("l_tax"), C("l_quantity"), C("l_returnflag")
    semantic = (
        F.when(d * 10 > 0.5, d * 10).when(flag == "A", 0.6).when(flag == "N", 0.8).otherwise(0.3)
    )
    selection = scores.selection_score(
        calibrated_score=1 - d,
        raw_score=1 - 5 * tax,
        track_quality=F.greatest(1 - tax, 1 - d, q / 50),
        temporal_consistency=q / 50,
        prior_relevance=d,
        semantic_relevance=semantic,
    )
    return t.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        r(selection).alias("score"),
        r(scores.gate_score(1 - d, d, tax, q > 10, tax)).alias("gate"),
        r(scores.track_score(1 - d, tax, q / 50, d, q / 40)).alias("track"),
    )


@query("""
with a as (select video_id, track_id, frame_index, score as vis, x, z - 10 as mz, 200.0 * y as area, case when label = 'R' then null else score end as fc from v_track_obs),
b as (select *, 1 - least(1, abs(x) / 3.0) as cs, case when mz > 0 then 1 - least(1, mz / 40.0) else 0 end as ds, least(1, sqrt(area) / 120.0) as ars from a),
c as (select *, greatest(cs, coalesce(fc, cs)) as mid from b),
d as (select *, greatest(0, least(1, 0.3 * vis + 0.2 * mid + 0.25 * greatest(ars, ds) + 0.25 * case when mz > 0 then mid else 0 end)) as s from c)
select video_id, track_id, frame_index, round(s, 12) as score, case when round(s,9) >= 0.67 then 'high' when round(s,9) >= 0.4 then 'medium' else 'low' end as label,
       case when mz > 0 then mid else 0 end >= 0.5 as front_center from d""")
def control_relevance(t: Inputs):
    frame_center = F.when(C("label") == "R", None).otherwise(C("score"))
    out = scores.control_relevance(C("score"), C("x"), C("z") - 10, 200.0 * C("y"), frame_center)
    return t.track_obs().select(
        "video_id",
        "track_id",
        "frame_index",
        r(out["score"], 12).alias("score"),
        out["label"].alias("label"),
        out["front_center"].alias("front_center"),
    )


@query("""
with q as (select video_id, track_id, frame_index, x, y, z, score / n as w, x / n as qx, y / n as qy, z / n as qz
           from (select *, sqrt(score*score + x*x + y*y + z*z) as n from v_track_obs) t)
select video_id, track_id, frame_index,
  round((1-2*(qy*qy+qz*qz))*1.0 + 2*(qx*qy+qz*w)*2.0 + 2*(qx*qz-qy*w)*3.0, 6) as ex,
  round(2*(qx*qy-qz*w)*1.0 + (1-2*(qx*qx+qz*qz))*2.0 + 2*(qy*qz+qx*w)*3.0, 6) as ey,
  round(2*(qx*qz+qy*w)*1.0 + 2*(qy*qz-qx*w)*2.0 + (1-2*(qx*qx+qy*qy))*3.0, 6) as ez
from q""")
def rotate_to_ego(t: Inputs):
    m = geometry.rotation_matrix(C("score"), C("x"), C("y"), C("z"))
    ex, ey, ez = geometry.rotate(m, [F.lit(1.0), F.lit(2.0), F.lit(3.0)], inverse=True)
    return t.track_obs().select(
        "video_id", "track_id", "frame_index", r(ex).alias("ex"), r(ey).alias("ey"), r(ez).alias("ez")
    )


@query("""
select video_id, start_frame, end_frame, f as frame_index,
  round(greatest(0.0, least(1.0, 1.0 - least(1.0, n / 5.0) * case when n <= 2 then 1.0 else least(1.0, cast(least(f - start_frame, end_frame - f) as double) / greatest(1, (n - 1) // 2)) end)), 6) as confidence
from (select *, end_frame - start_frame + 1 as n, unnest(range(start_frame, end_frame + 1)) as f0, cast(f0 as int) as f from v_runs) t""")
def relabel_confidence(t: Inputs):
    return (
        t.truth_runs()
        .withColumn("frame_index", F.explode(F.sequence("start_frame", "end_frame")))
        .select(
            "video_id",
            "start_frame",
            "end_frame",
            "frame_index",
            r(
                bands.relabel_confidence(
                    C("end_frame") - C("start_frame") + 1, C("frame_index") - C("start_frame"), 5
                )
            ).alias("confidence"),
        )
    )


@query("""
select l_orderkey, l_linenumber, l_partkey,
  round(case when l_linestatus = 'F' then 1 - 5 * l_tax else greatest(0.0, least(1.0, 1 / (1 + exp(-(-0.2 + 0.8 * ((1 - 5 * l_tax) - 0.5) / 0.25 + 0.3 * (l_quantity - 25) / 14.0
     + case l_returnflag when 'A' then 0.4 when 'R' then -0.3 else 0 end))) + case l_returnflag when 'N' then 0.05 else 0 end)) end, 6) as calibrated
from lineitem""")
def calibrated_detection_score(t: Inputs):
    model = t.spark.createDataFrame(
        [("num:score", 0.8, 0.5, 0.25), ("num:size", 0.3, 25.0, 14.0)], "feature string, coef double, mean double, scale double"
    )
    classes = t.spark.createDataFrame([("A", 0.4, 0.0), ("R", -0.3, 0.0), ("N", 0.0, 0.05)], "cls string, coef double, bonus double")
    row = model.groupBy().pivot("feature", ["num:score", "num:size"]).agg(
        F.first("coef").alias("coef"), F.first("mean").alias("mean"), F.first("scale").alias("scale")
    )
    coefficients = row.select(F.struct("*").alias("m"))
    raw = 1 - 5 * C("l_tax")
    z = lambda v, f: C("m")[f"num:{f}_coef"] * (v - C("m")[f"num:{f}_mean"]) / C("m")[f"num:{f}_scale"]
    logit = F.lit(-0.2) + z(raw, "score") + z(C("l_quantity"), "size") + F.coalesce("coef", F.lit(0.0))
    calibrated = scores.clamp01(scores.logistic(logit) + F.coalesce("bonus", F.lit(0.0)))
    # one coefficient row and one row per class: both sides have a fixed size
    return (
        t.table("lineitem")
        .join(F.broadcast(classes), C("l_returnflag") == C("cls"), "left")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(coefficients.withColumn("one", F.lit(1))), "one")
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            r(F.when(C("l_linestatus") == "F", raw).otherwise(calibrated)).alias("calibrated"),
        )
    )


@query("""
select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), -1.0) as k, coalesce(try_cast(event_type as double), 0.5) as bad,
       lower(trim(event_type)) in ('1','true','yes') as flag, 2 as n_listed, 0 as n_plain
from events""")
def tolerant_casts(t: Inputs):
    listed = F.concat(F.lit('["'), C("event_type"), F.lit('", "x"]'))
    return t.table("events").select(
        "event_id",
        text.number_or(F.get_json_object("props", "$.k"), -1.0).alias("k"),
        text.number_or(C("event_type"), 0.5).alias("bad"),
        text.truthy(C("event_type")).alias("flag"),
        F.size(text.list_like(listed)).alias("n_listed"),
        F.size(text.list_like(C("event_type"))).alias("n_plain"),
    )


@query("""
select sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey) as fingerprint, count(*) as n from lineitem group by 1""")
def payload_fingerprint(t: Inputs):
    payload = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey")
    return t.table("lineitem").groupBy(F.sha2(payload, 256).alias("fingerprint")).agg(F.count("*").alias("n"))


@query("""
select video_id, frame_index, round(frame_index / 5.0, 6) as ts_seconds, cast(round_even(round(frame_index / 5.0, 6) * 5.0, 0) as int) as back
from v_signal""")
def frame_times(t: Inputs):
    seconds = r(C("frame_index") / F.lit(5.0))
    return t.signal().select(
        "video_id", "frame_index", seconds.alias("ts_seconds"), F.bround(seconds * 5.0).cast("int").alias("back")
    )


@query("""
select video_id, track_id, frame_index, x < 0 as is_left, x > 0 as is_right, z > 100 and z > 2 * score and z > y as is_red, y > 3 and y > z / 10 and y > x as is_blue,
       y - lead(y) over w > 1e-6 as moves_up, lead(y) over w - y > 1e-6 as moves_down
from v_track_obs window w as (partition by video_id, track_id order by frame_index)""")
def scene_predicates(t: Inputs):
    from trackloom.operators.ordered import by_step, following

    obs = t.track_obs()
    x, y, z = C("x"), C("y"), C("z")
    step = by_step(["video_id", "track_id"], "frame_index", 4096).scan(obs, next_y=following(C("y")))
    return step.select(
        "video_id",
        "track_id",
        "frame_index",
        (x < 0).alias("is_left"),
        (x > 0).alias("is_right"),
        ((z > 100) & (z > 2 * C("score")) & (z > y)).alias("is_red"),
        ((y > 3) & (y > z / 10) & (y > x)).alias("is_blue"),
        ((y - C("next_y")) > 1e-6).alias("moves_up"),
        ((C("next_y") - y) > 1e-6).alias("moves_down"),
    )


@query("""
with p as (select video_id, frame_index, vx, vz, vx + 1 as ox, vz * 0.9 as oz from v_signal),
n as (select *, sqrt(vx*vx + vz*vz) as a, sqrt(ox*ox + oz*oz) as b from p)
select video_id, frame_index, round(degrees(acos(greatest(-1.0, least(1.0, (vx*ox + vz*oz) / greatest(a * b, 1e-6))))), 5) as direction_error,
       round(greatest(a, b, 1e-6) / greatest(least(a, b), 1e-6), 5) as magnitude_ratio, round(sqrt(0.5*0.5 + (a-b)*(a-b)), 6) as sigma
from n""")
def flow_diagnostics(t: Inputs):
    predicted, observed = [C("vx"), C("vz")], [C("vx") + 1, C("vz") * 0.9]
    gap = geometry.norm(*predicted) - geometry.norm(*observed)
    return t.signal().select(
        "video_id",
        "frame_index",
        r(geometry.direction_error_degrees(predicted, observed), 5).alias("direction_error"),
        r(geometry.magnitude_ratio(predicted, observed), 5).alias("magnitude_ratio"),
        r(F.hypot(F.lit(0.5), gap)).alias("sigma"),
    )


@query("""
select video_id, frame_index, case when label = 'signup' then 'info' when label = 'error' and abs(vz)/50 >= 4 then 'hard_violation' when abs(vz)/50 >= 2 then 'violation'
   when abs(vz)/50 >= 1 then 'warning' else 'info' end as severity from v_signal""")
def residual_severity(t: Inputs):
    normalized = F.when(C("label") != "signup", F.abs("vz") / 50)
    return t.signal().select(
        "video_id", "frame_index", bands.severity(normalized, C("label") == "error", 2.0, 4.0).alias("severity")
    )


@query("""
select video_id, track_id, frame_index, round(x + 1 - 0.1 * z, 8) as wx, round(y + 2 + 0.1 * x, 8) as wz,
  round(-((x - 1) * x + (y - 2) * z) / (sqrt(x*x + z*z) + 1e-5), 6) as closing, round(1.1 / (y + 1e-6) + abs(x) + case when z < 15 then 1 else 0 end, 6) as focus
from v_track_obs""")
def world_velocity_and_closing(t: Inputs):
    x, y, z = C("x"), C("y"), C("z")
    wx, wz = geometry.world_velocity(x, y, F.lit(1.0), F.lit(2.0), F.lit(0.1), x, z)
    focus = 1.1 / (y + 1e-6) + F.abs(x) + F.when(z < 15, 1).otherwise(0)
    return t.track_obs().select(
        "video_id",
        "track_id",
        "frame_index",
        r(wx, 8).alias("wx"),
        r(wz, 8).alias("wz"),
        r(geometry.closing_speed(x, y, F.lit(1.0), F.lit(2.0), x, z)).alias("closing"),
        r(focus).alias("focus"),
    )


@query("""
select p.p_partkey, coalesce(string_agg(q.prior_id, ',' order by q.score desc, q.prior_id), '') as prior_ids, cast(coalesce(max(q.score), 0.0) as double) as relevance
from part p left join (values ('brake','ECONOMY',0.9),('brake','PROMO',0.9),('turn','PROMO',0.7),('turn','STANDARD',0.7),('stop','STANDARD',0.95)) q(prior_id, cls, score) on p.p_type = q.cls
group by 1""")
def prior_relevance(t: Inputs):
    priors = t.spark.createDataFrame(
        [("brake", ["ECONOMY", "PROMO"], 0.9), ("turn", ["PROMO", "STANDARD"], 0.7), ("stop", ["STANDARD"], 0.95)],
        "prior_id string, classes array<string>, score double",
    )
    # fixed prior table, a handful of rows: one row of ordered matches per class
    by_class = (
        priors.select(F.explode("classes").alias("cls"), "prior_id", "score")
        .groupBy("cls")
        .agg(
            F.array_sort(F.collect_list(F.struct((-C("score")).alias("k"), "prior_id"))).alias("matches"),
            F.max("score").alias("relevance"),
        )
    )
    return (
        t.table("part")
        .join(F.broadcast(by_class), C("p_type") == C("cls"), "left")
        .select(
            "p_partkey",
            F.coalesce(F.array_join(C("matches.prior_id"), ","), F.lit("")).alias("prior_ids"),
            F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        )
    )


@query("""
select frame_index, det_index, source, case when source = 'gt' then 'accepted_high_confidence' when label = 'A' then 'low_confidence' when label = 'N' then 'borderline_confidence' else 'other' end as bucket,
  case when source = 'gt' then 0 when label = 'A' then 3 when label = 'N' then 2 else 9 end as quality_rank,
  lpad(cast(frame_index as varchar), 6, '0') || ':' || source || ':' || lpad(cast(det_index as varchar), 4, '0') as det_id
from v_boxes""")
def detection_quality(t: Inputs):
    source = F.when(C("label") == "A", "low_confidence").when(C("label") == "N", "borderline_confidence").otherwise("other")
    bucket = bands.quality_bucket(C("source") == "gt", source)
    return t.boxes().select(
        *KEY,
        bucket.alias("bucket"),
        bands.quality_rank(bucket).alias("quality_rank"),
        text.detection_id(C("frame_index"), C("source"), C("det_index")).alias("det_id"),
    )


@query("""
select video_id, frame_index // 6 as frame_index, label from v_signal where frame_index % 6 = 0""")
def thin_frames(t: Inputs):
    from trackloom.operators.signals import thin_frames as thin

    return thin(t.signal().select("video_id", "frame_index", "label"), "frame_index", 30.0, 5.0)


@query("""
select video_id, frame_index, case when abs(vz) < 20 then 1 when abs(vx) > 5 then 2 else 0 end as mode from v_signal""")
def driving_modes(t: Inputs):
    return t.signal().select(
        "video_id", "frame_index", bands.driving_mode(F.abs("vz") < 20, F.abs("vx") > 5).alias("mode")
    )


@query("""
with c as (select video_id, track_id, frame_index, x + sx * 2.0 as px, y + sy * 0.8 as py, z + sz * 1.0 as pz from v_track_obs,
           (values (-1),(1)) a(sx), (values (-1),(1)) b(sy), (values (-1),(1)) c(sz))
select video_id, track_id, frame_index, round(min(px / pz * 100 + 200), 6) as x1, round(min(py / pz * 100 + 100), 6) as y1, round(max(px / pz * 100 + 200), 6) as x2,
   round(max(py / pz * 100 + 100), 6) as y2 from c where pz > 0 group by 1, 2, 3""")
def projected_boxes(t: Inputs):
    from trackloom.operators.projection import project_boxes

    return project_boxes(
        t.track_obs().select("video_id", "track_id", "frame_index", "x", "y", "z"),
        size=(4.0, 1.6, 2.0),
        focal=100.0,
        principal=(200.0, 100.0),
    ).select("video_id", "track_id", "frame_index", *[r(C(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""
select video_id, frame_index, case when abs(vz) < th.stop then 'stop' when vz > th.fast then 'speedup' when vz < -th.fast then 'slowdown' else 'steady' end
     || case when vx < -th.turn then '|right' when vx > th.turn then '|left' else '' end as action
from v_settled_signal, (values (10.0, 60.0, 8.0)) th(stop, fast, turn)""")
def ego_actions(t: Inputs):
    thresholds = t.spark.createDataFrame([(1, 10.0, 60.0, 8.0)], "one int, stop double, fast double, turn double")
    forward = F.when(F.abs("vz") < C("stop"), "stop").when(C("vz") > C("fast"), "speedup").when(
        C("vz") < -C("fast"), "slowdown"
    ).otherwise("steady")
    lateral = F.when(C("vx") < -C("turn"), "|right").when(C("vx") > C("turn"), "|left").otherwise("")
    # a single row of thresholds
    return (
        t.settled_signal()
        .withColumn("one", F.lit(1))
        .join(F.broadcast(thresholds), "one")
        .select("video_id", "frame_index", F.concat(forward, lateral).alias("action"))
    )
