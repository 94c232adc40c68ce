"""Signals cut into labelled segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import bands
from trackloom.functions.numbers import settled
from trackloom.operators import segmentation as seg
from trackloom.operators import short_runs
from trackloom.operators.ordered import runs
from trackloom.operators.tracks import relative_motion as motion_of
from trackloom.plans.catalog import query, rounded
from trackloom.plans.sequences import MOTION, ego
from trackloom.plans.views import Inputs

C = F.col
V = ["video_id"]


def labelled_signal(t: Inputs):
    return t.signal().select(
        "video_id", "frame_index", "vz", bands.three_way(C("vz"), 20, "backward", "static", "forward").alias("state")
    )


def signal_runs(t: Inputs):
    s = labelled_signal(t)
    return runs(s, V, "frame_index", "state", total=("sum", C("vz"))).withColumn("mean", C("total") / C("frames")).drop("total")


RUNS = """
lab as (select video_id, frame_index, vz, case when vz < -20 then 'backward' when vz > 20 then 'forward' else 'static' end as state from v_signal),
chg as (select *, case when state = lag(state) over (partition by video_id order by frame_index) then 0 else 1 end as c from lab),
num as (select *, sum(c) over (partition by video_id order by frame_index) as run from chg),
rt as (select video_id, run, min(state) as state, min(frame_index) as start_frame, max(frame_index) as end_frame, count(*) as frames, avg(vz) as mean, min(vz) as low, max(vz) as high from num group by 1, 2)"""


@query(f"""
with {RUNS} select video_id, state, start_frame, end_frame, frames, round(mean, 6) as mean from rt""")
def labelled_runs(t: Inputs):
    return rounded(signal_runs(t), "video_id", "state", "start_frame", "end_frame", "frames", "mean")


@query("""
with c as (select *, case when label = lag(label) over w and frame_index - lag(frame_index) over w = 1 then 0 else 1 end as c from v_track_obs window w as (partition by video_id, track_id order by frame_index)),
n as (select *, sum(c) over (partition by video_id, track_id order by frame_index) as run from c)
select video_id, track_id, min(label) as label, min(frame_index) as start_frame, max(frame_index) as end_frame, count(*) as frames, round(max(z), 6) as peak from n group by video_id, track_id, run""")
def contiguous_runs(t: Inputs):
    out = runs(t.track_obs(), ["video_id", "track_id"], "frame_index", "label", span=64, contiguous=True, peak=("max", C("z")))
    return rounded(out, "video_id", "track_id", "label", "start_frame", "end_frame", "frames", "peak")


@query("""
with m as (select video_id, frame_index, sqrt(vx*vx + vz*vz) < 60 as st, abs(vx) > 5 as tu from v_signal),
c as (select *, case when st = lag(st) over w then 0 else 1 end as c1, case when tu = lag(tu) over w then 0 else 1 end as c2 from m window w as (partition by video_id order by frame_index)),
r as (select *, sum(c1) over w as r1, sum(c2) over w as r2 from c window w as (partition by video_id order by frame_index))
select video_id, frame_index, st and count(*) over (partition by video_id, r1) >= 3 as stopped, tu and count(*) over (partition by video_id, r2) >= 3 as turning from r""")
def stop_and_turn_masks(t: Inputs):
    s = t.signal().select("video_id", "frame_index", "vx", "vz")
    return seg.stop_and_turn_masks(s, V, "frame_index", "vx", "vz", 60.0, 5.0, 3).select("video_id", "frame_index", "stopped", "turning")


PADDED = lambda col, left, right, width: (
    f"(sum({col}) over (w rows between {left} preceding and {right} following) + greatest(0, {left} - frame_index) * first_value({col}) over (partition by video_id order by frame_index)"
    f" + greatest(0, {right} - (n - 1 - frame_index)) * first_value({col}) over (partition by video_id order by frame_index desc)) / {width}"
)


@query(f"""
with b as (select video_id, frame_index, vz, abs(vz) as av, sqrt(vx*vx+vz*vz) as sp, count(*) over (partition by video_id) as n from v_signal),
m as (select *, {PADDED('vz', 2, 2, 5)} as trend, {PADDED('av', 1, 1, 3)} as am, {PADDED('sp', 1, 1, 3)} as sm from b window w as (partition by video_id order by frame_index)),
h as (select *, coalesce(trend - lag(trend) over w, 0) as change, last_value(case when am <= 50 and sm <= 60 then 1 when not (am <= 70 and sm <= 80) then 0 end ignore nulls) over (w rows between unbounded preceding and current row) as st
  from m window w as (partition by video_id order by frame_index)),
q as (select *, coalesce(st, 0) = 1 as raw from h), c as (select *, case when raw = lag(raw) over (partition by video_id order by frame_index) then 0 else 1 end as c from q),
r as (select *, sum(c) over (partition by video_id order by frame_index) as run from c), s as (select *, raw and count(*) over (partition by video_id, run) >= 3 as stopped from r),
d as (select *, coalesce(last_value(case when stopped then null when trend > 5 then 1 when trend < -5 then -1 end ignore nulls) over (partition by video_id order by frame_index rows between unbounded preceding and current row), 1) as head from s)
select video_id, frame_index, stopped, round(trend, 6) as trend, case when stopped then 'stopping' when head > 0 then case when change > 10 then 'forward_speedup' when change < -10 then 'forward_slowdown' else 'forward_static_moving' end
  else case when change < -10 then 'backward_speedup' when change > 10 then 'backward_slowdown' else 'backward_static_moving' end end as forward_state from d""")
def forward_states(t: Inputs):
    return rounded(forward_axis(t), "video_id", "frame_index", "stopped", "trend", "forward_state")


def forward_axis(t: Inputs):
    s = t.signal().select("video_id", "frame_index", "vx", "vz", F.sqrt(C("vx") * C("vx") + C("vz") * C("vz")).alias("speed"))
    return seg.forward_states(
        s, V, "frame_index", "vz", "speed", accel=10.0, stop_enter=50.0, stop_exit=70.0, speed_enter=60.0, speed_exit=80.0,
        min_stop=3, stop_window=3, motion_window=5, epsilon=5.0,
    )


@query(f"""
with b as (select video_id, frame_index, vx, count(*) over (partition by video_id) as n from v_signal),
m as (select *, {PADDED('vx', 1, 1, 3)} as trend from b window w as (partition by video_id order by frame_index)),
k as (select *, trend > 4 as lf, trend < -4 as rt from m), c as (select *, case when lf = lag(lf) over w then 0 else 1 end as c1, case when rt = lag(rt) over w then 0 else 1 end as c2 from k window w as (partition by video_id order by frame_index)),
r as (select *, sum(c1) over w as r1, sum(c2) over w as r2 from c window w as (partition by video_id order by frame_index))
select video_id, frame_index, case when abs(trend) <= 1 then 'straightforward' when lf and count(*) over (partition by video_id, r1) >= 2 then 'left' when rt and count(*) over (partition by video_id, r2) >= 2 then 'right' else 'straightforward' end as lateral_state from r""")
def lateral_states(t: Inputs):
    return lateral_axis(t.signal().select("video_id", "frame_index", "vx")).select("video_id", "frame_index", "lateral_state")


def lateral_axis(df):
    return seg.lateral_states(df, V, "frame_index", "vx", turn=4.0, straight=1.0, least=2, window=3, epsilon=0.5)


@query("""
with l as (select video_id, frame_index, case when vz < -20 then 'backward' when vz > 20 then 'forward' else 'static' end as f, case when vx < -5 then 'right' when vx > 5 then 'left' else 'straight' end as t from v_signal),
c as (select *, case when f = lag(f) over w and t = lag(t) over w then 0 else 1 end as c from l window w as (partition by video_id order by frame_index)),
r as (select *, sum(c) over (partition by video_id order by frame_index) as run from c)
select video_id, min(frame_index) as start_frame, max(frame_index) as end_frame, count(*) as frames, min(f) as forward_event, min(t) as lateral_event from r group by video_id, run""")
def timeline_segments(t: Inputs):
    s = t.signal().select(
        "video_id", "frame_index",
        bands.three_way(C("vz"), 20, "backward", "static", "forward").alias("f"),
        bands.three_way(C("vx"), 5, "right", "straight", "left").alias("l"),
    )
    return seg.timeline_segments(s, V, "frame_index", "f", "l").drop("event")


@query("""
with m as (select video_id, max(abs(vz)) as top from v_signal group by 1), g as (select video_id, top, cast(unnest(range(1, 101)) as int) as i from m where top > 0),
l as (select s.video_id, frame_index, i, top * i / 101 as th, case when vz < -top * i / 101 then -1 when vz > top * i / 101 then 1 else 0 end as st from v_signal s join g on g.video_id = s.video_id),
c as (select *, case when st = lag(st) over (partition by video_id, i order by frame_index) then 0 else 1 end as c from l)
select video_id, i - 1 as candidate_index, round(max(th), 6) as threshold, cast(sum(c) as bigint) as segment_count from c group by video_id, i""")
def threshold_sweep(t: Inputs):
    return rounded(seg.threshold_sweep(t.signal().select("video_id", "frame_index", "vz"), V, "frame_index", "vz"), "video_id", "candidate_index", "threshold", "segment_count")


@query("""
with m as (select video_id, max(abs(vx)) as top from v_signal group by 1), g as (select video_id, top, cast(unnest(range(1, 101)) as int) as i from m where top > 0),
l as (select s.video_id, frame_index, i, top * i / 101 as th, case when vx * 101 < -top * i then -1 when vx * 101 > top * i then 1 else 0 end as st from v_signal s join g on g.video_id = s.video_id),
c as (select *, case when st = lag(st) over (partition by video_id, i order by frame_index) then 0 else 1 end as c from l),
k as (select video_id, i, max(th) as th, cast(sum(c) as bigint) as n from c group by 1, 2), d as (select *, case when n = lag(n) over (partition by video_id order by i) then 0 else 1 end as c from k),
r as (select *, sum(c) over (partition by video_id order by i) as run from d)
select video_id, min(i) - 1 as start_index, max(i) - 1 as end_index, min(n) as segment_count, count(*) as num_values, round(median(th), 6) as middle,
  concat_ws(',', case when count(*) < 3 then 'too_few_values' end, case when min(n) <= 1 then 'single_segment' end) as rejections from r group by video_id, run""")
def sweep_plateaus(t: Inputs):
    sweep = seg.threshold_sweep(t.signal().select("video_id", "frame_index", "vx"), V, "frame_index", "vx")
    return rounded(seg.plateaus(sweep, V, 3), "video_id", "start_index", "end_index", "segment_count", "num_values", "middle", "rejections")


@query(f"""
with {RUNS}, n as (select *, lag(state) over w as p, lead(state) over w as q from rt window w as (partition by video_id order by start_frame)),
i as (select *, case when (state = 'forward' and p = 'backward') or (state = 'backward' and p = 'forward') then 1 else 0 end + case when (state = 'forward' and q = 'backward') or (state = 'backward' and q = 'forward') then 1 else 0 end as incidents from n)
select video_id, start_frame, end_frame, state, incidents, round(pow(0.5, incidents), 6) as multiplier from i""")
def transition_penalties(t: Inputs):
    out = seg.transition_penalty(signal_runs(t), V, "state", ("forward", "backward"), 0.5)
    return rounded(out, "video_id", "start_frame", "end_frame", "state", "incidents", "multiplier")


@query("""
with f as (select video_id, frame_index, gt_label as state, 0.5 + (frame_index % 5) / 10.0 as confidence from v_timeline),
c as (select s.video_id, s.frame_index, k.id as candidate_id, k.th as threshold, case when s.vz > k.th then 'left' when s.vz < -k.th then 'static' else 'forward' end as label from v_settled_signal s, (values (0, 10.0), (1, 40.0), (2, 160.0)) k(id, th)),
a as (select c.video_id, candidate_id, cast(threshold as double) as threshold, coalesce(sum(case when label = state then confidence else 0 end) / sum(confidence), 0) as weighted, avg(case when label = state then 1.0 else 0 end) as raw,
  count(*) * 1.0 / max(n) as coverage from c join f on f.video_id = c.video_id and f.frame_index = c.frame_index join (select video_id, count(*) as n from f group by 1) g on g.video_id = c.video_id group by 1, 2, 3),
r as (select *, row_number() over (partition by video_id order by round(weighted, 9) desc, round(raw, 9) desc, coverage desc, threshold, candidate_id) as rn from a)
select video_id, candidate_id, threshold, round(weighted, 6) as weighted, round(raw, 6) as raw, round(coverage, 6) as coverage from r where rn = 1""")
def best_threshold_candidate(t: Inputs):
    final = t.timeline().select("video_id", "frame_index", C("gt_label").alias("state"), (0.5 + (C("frame_index") % 5) / 10.0).alias("confidence"))
    options = F.array(*[F.struct(F.lit(i).alias("candidate_id"), F.lit(th).alias("threshold")) for i, th in enumerate((10.0, 40.0, 160.0))])
    candidates = (
        t.settled_signal()
        .select("video_id", "frame_index", "vz", F.explode(options).alias("o"))
        .select("video_id", "frame_index", "o.candidate_id", "o.threshold", seg.sweep_label(C("vz"), C("o.threshold"), ("static", "forward", "left")).alias("label"))
    )
    return rounded(seg.best_candidate(candidates, final, V, []), "video_id", "candidate_id", "threshold", "weighted", "raw", "coverage")


KEYFRAMES = """
kf as (select video_id, frame_index as f, gt_label as label, pred_label, count(*) over (partition by video_id) as n from v_timeline),
ks as (select video_id, f, label, n from kf where pred_label <> 'forward'),
sg as (select video_id, n, f as start, coalesce(lead(f) over (partition by video_id order by f), n) - 1 as stop, label from ks)"""


def keyframes(t: Inputs):
    from trackloom.operators.ordered import by_step, total

    frames = by_step(V, "frame_index", 8192).scan(t.timeline(), n=total(1))
    return frames.filter("pred_label <> 'forward'").select("video_id", "frame_index", C("gt_label").alias("label"), "n")


def keyed_segments(t: Inputs):
    from trackloom.operators.ordered import by_step, following

    seen = by_step(V, "frame_index", 8192).scan(keyframes(t), after=following(C("frame_index")))
    return seen.select("video_id", "n", C("frame_index").alias("start"), (F.coalesce("after", "n") - 1).cast("int").alias("end"), "label")


@query(f"""
with {KEYFRAMES} select video_id, start, cast(stop as int) as "end", label from sg""")
def keyframe_segments(t: Inputs):
    return seg.keyframe_segments(keyframes(t), V, "frame_index", "label", C("n"))


@query(f"""
with {KEYFRAMES}, c as (select *, case when label = lag(label) over w and lag(stop) over w + 1 = start then 0 else 1 end as c from sg window w as (partition by video_id order by start)),
r as (select *, sum(c) over (partition by video_id order by start) as part from c)
select video_id, min(label) as label, min(start) as start, cast(max(stop) as int) as "end" from r group by video_id, part""")
def merged_keyframe_segments(t: Inputs):
    return seg.merge_touching(keyed_segments(t).drop("n"), V).drop("part")


@query(f"""
with {KEYFRAMES} select video_id, start, cast(greatest(0, least(100 - 1, floor(start * (100.0 / n)))) as int) as scaled_start,
 cast(greatest(greatest(0, least(100 - 1, floor(start * (100.0 / n)))), least(100 - 1, ceil((stop + 1) * (100.0 / n)) - 1)) as int) as scaled_end, label from sg""")
def rescaled_segments(t: Inputs):
    out = seg.rescale_segments(keyed_segments(t), V, C("n"), F.lit(100.0))
    return out.select("video_id", "start", "scaled_start", "scaled_end", "label")


@query("""
with r as (select video_id, label, frame_index as s, frame_index + frame_index % 3 as e, abs(vz)/50 as z, label = 'error' and abs(vz)/50 >= 4 as hard from v_signal where abs(vz)/50 >= 2),
c as (select *, case when s <= lag(e) over (partition by video_id, label order by s) + 4 then 0 else 1 end as c from r),
n as (select *, cast(sum(c) over (partition by video_id, label order by s) as bigint) as window_index from c)
select video_id, label, window_index, min(s) as start_frame, max(e) as end_frame, count(*) as residuals, round(max(z), 6) as peak, bool_or(hard) as hard from n group by 1, 2, 3""")
def conflict_windows(t: Inputs):
    z = F.abs("vz") / 50
    rows = t.signal().select(
        "video_id", "label", C("frame_index").alias("s"), (C("frame_index") + C("frame_index") % 3).alias("e"), z.alias("z"),
        ((C("label") == "error") & (z >= 4)).alias("hard"),
    ).filter("z >= 2")
    out = seg.conflict_windows(rows, ["video_id", "label"], "s", "e", "z", "hard", 3)
    return rounded(out, "video_id", "label", "window_index", "start_frame", "end_frame", "residuals", "peak", "hard")


@query("""
with s as (select *, sqrt(vx*vx + vz*vz) as sp from v_signal), d as (select *, sp - lag(sp) over (partition by video_id order by frame_index) as df from s),
g as (select video_id, frame_index // 20 as seg, count(*) as n, avg(case when sp < 60 then 1.0 else 0 end) as st, avg(case when abs(vx) > 5 then 1.0 else 0 end) as tu, count_if(df > 10) as up, count_if(df < -10) as dn from d group by 1, 2)
select video_id, seg, case when st > 0.7 then 'stopped' when 1 - st > 0.7 then 'moving' else 'uncertain' end as moving, round(abs(2 * st - 1), 6) as moving_confidence,
  case when tu > 0.7 then 'turning' when 1 - tu > 0.7 then 'not_turning' else 'uncertain' end as turning,
  case when up + dn = 0 then 'constant_speed' when up / (up + dn) > 0.7 then 'speeding_up' when dn / (up + dn) > 0.7 then 'slowing_down' else 'constant_speed' end as speed_change from g""")
def ego_segment_predicates(t: Inputs):
    from trackloom.operators.motion_states import ego_predicates

    s = t.signal().select("video_id", "frame_index", "vx", "vz")
    out = ego_predicates(s, V, "frame_index", 20, 60.0, 5.0, 10.0, 0.7)
    return rounded(out, "video_id", "seg", "moving", "moving_confidence", "turning", "speed_change")


@query(f"""
with {MOTION}, st as (select video_id, frame_index, median(abs(rel_vz)) as mv, median(rel_speed) as ms, count(*) as n from motion where label = 'A' group by 1, 2),
fr as (select video_id, frame_index, case when avg(z) > 25 then 'forward' else 'backward' end as state from v_track_obs group by 1, 2)
select fr.video_id, fr.frame_index, state, case when n >= 2 and mv <= 2 and ms <= 4 then 'stopping' else state end as corrected from fr left join st on st.video_id = fr.video_id and st.frame_index = fr.frame_index""")
def static_reference_correction(t: Inputs):
    frames = t.track_obs().groupBy("video_id", "frame_index").agg(F.when(F.avg("z") > 25, "forward").otherwise("backward").alias("state"))
    static = motion_of(t.track_obs(), ego(t)).filter("label = 'A'")
    out = seg.static_correction(frames, static.select("video_id", "frame_index", "rel_vz", "rel_speed"), "state", 2.0, 4.0, 2)
    return out.select("video_id", "frame_index", "state", "corrected")


@query()
def absorbed_short_runs(t: Inputs):
    return rounded(short_runs.absorb_short_runs(signal_runs(t), V, "state", 3), "video_id", "start_frame", "end_frame", "state", "mean")


@query()
def smoothed_short_runs(t: Inputs):
    return rounded(short_runs.smooth_short_runs(signal_runs(t), V, "state", 3), "video_id", "start_frame", "end_frame", "state", "mean")


@query()
def bridged_interruptions(t: Inputs):
    out = short_runs.bridge_interruptions(signal_runs(t), V, "state", 2, 4, 2, 3)
    return rounded(out, "video_id", "start_frame", "end_frame", "state", "mean")


@query()
def assigned_short_islands(t: Inputs):
    out = short_runs.assign_short_islands(signal_runs(t), V, "state", 2)
    return rounded(out, "video_id", "start_frame", "end_frame", "state", "mean")


@query(f"""
with {RUNS}, fr as (select n.video_id, n.frame_index, n.state as original, r.frames, r.start_frame, r.end_frame, lag(r.state) over w as p, lead(r.state) over w as q from num n join rt r on r.video_id = n.video_id and r.run = n.run
   window w as (partition by n.video_id order by n.frame_index)),
a as (select *, first_value(p) over (partition by video_id, start_frame order by frame_index) as ps, first_value(q) over (partition by video_id, start_frame order by frame_index desc) as qs from fr)
select video_id, frame_index, original, case when frames < 3 and ps = qs then ps else original end as final,
  round(case when frames < 3 and ps = qs then greatest(0.0, 1 - least(1.0, frames / 3.0)) else 1.0 end, 6) as confidence from a""")
def frame_label_audit(t: Inputs):
    from trackloom.operators.ordered import by_step, following, previous

    rt = by_step(V, "start_frame", 8192).scan(signal_runs(t), p=previous(C("state")), q=following(C("state")))
    changed = (C("frames") < 3) & (C("p") == C("q"))
    frames = rt.withColumn("frame_index", F.explode(F.sequence("start_frame", "end_frame"))).withColumn("changed", F.coalesce(changed, F.lit(False)))
    confidence = bands.relabel_confidence(C("frames"), C("frame_index") - C("start_frame"), 3)
    return frames.select(
        "video_id", "frame_index", C("state").alias("original"),
        F.when(C("changed"), C("p")).otherwise(C("state")).alias("final"),
        settled(F.when(C("changed"), confidence).otherwise(1.0)).alias("confidence"),
    )


@query()
def consensus_segments(t: Inputs):
    from trackloom.plans.scoring import frame_votes

    decoded = seg.decode_consensus(frame_votes(t), V, "frame_index", ["static", "forward", "left"], 3)
    out = runs(decoded, V, "frame_index", "state", total=("sum", C("confidence")))
    return rounded(out.withColumn("confidence", C("total") / C("frames")), "video_id", "state", "start_frame", "end_frame", "confidence")


GRID = [(x, y) for x in (20.0, 60.0, 120.0, 240.0) for y in (10.0, 30.0, 50.0)]


@query("""
with m as (select video_id, max(abs(vz)) as top from v_signal group by 1), g as (select video_id, top, unnest(range(1, 101)) as i from m where top > 0), l as (select s.video_id, frame_index, i, top * i / 101 as th, case when vz < -top * i / 101 then -1 when vz > top * i / 101 then 1 else 0 end as st from v_signal s join g on g.video_id = s.video_id),
c as (select *, case when st = lag(st) over (partition by video_id, i order by frame_index) then 0 else 1 end as c from l), p as (select video_id, max(th) as x, cast(sum(c) as double) as y from c group by video_id, i),
b as (select greatest(1e-6, stddev_pop(x) * pow(count(*), -1.0/6)) as sx, greatest(1e-6, stddev_pop(y) * pow(count(*), -1.0/6)) as sy from p), gr as (select gx, gy from (values (20.0::double), (60.0::double), (120.0::double), (240.0::double)) a(gx), (values (10.0::double), (30.0::double), (50.0::double)) b(gy)),
d as (select gx, gy, avg(exp(-0.5 * (pow((x - gx) / sx, 2) + pow((y - gy) / sy, 2)))) as density from p, b, gr group by 1, 2) select gx, gy, round(density / (select max(density) from d), 6) as confidence from d""")
def confidence_surface(t: Inputs):
    sweep = seg.threshold_sweep(t.signal().select("video_id", "frame_index", "vz"), V, "frame_index", "vz")
    points = t.once("sweep", lambda: sweep.select("threshold", C("segment_count").cast("double").alias("count")))
    return rounded(seg.confidence_surface(points, GRID), "gx", "gy", "confidence")


@query("""
with o as (select * from (values (0, 10.0), (1, 30.0), (2, 90.0), (3, 200.0)) o(id, th)), l as (select video_id, frame_index, id, vz, case when vz < -th then 'backward' when vz > th then 'forward' else 'static' end as st from v_signal, o),
c as (select *, case when st <> lag(st) over (partition by video_id, id order by frame_index) then 1 else 0 end as c from l), s as (select video_id, id, st, count(*) as n, var_pop(vz) as v, sum(c) as t from c group by 1, 2, 3),
a as (select video_id, id, round(sum(n * v) / sum(n) / 1000 + sum(t) / sum(n), 9) as score, cast(sum(t) as bigint) as transitions from s group by 1, 2), k as (select *, row_number() over (partition by video_id order by score, id) as k from a)
select video_id, id as "option", round(score, 6) as score, transitions from k where k = 1""")
def scored_thresholds(t: Inputs):
    out = seg.score_thresholds(t.signal().select("video_id", "frame_index", "vz"), V, "frame_index", "vz", [10.0, 30.0, 90.0, 200.0], ("backward", "static", "forward"))
    return rounded(out, "video_id", "option", "score", "transitions")
