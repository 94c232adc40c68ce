"""Ordered signals and tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions.numbers import settled
from trackloom.operators import signals, tracks
from trackloom.operators.ordered import by_step, following, previous, row_number
from trackloom.operators.quantiles import quantiles, weighted_median
from trackloom.plans.catalog import query, rounded
from trackloom.plans.views import Inputs

C = F.col
V = ["video_id"]


def ego(t: Inputs):
    """Mean motion of a video's frame stands in for its ego motion."""
    return ego_of(t.track_obs())


def ego_of(observations):
    return observations.groupBy("video_id", "frame_index").agg((F.avg("x") / 10).alias("ego_vx"), (F.avg("z") / 50).alias("ego_vz"))


def with_ego(observations):
    """The same beside each observation of videos that are short."""
    frame = Window.partitionBy("video_id", "frame_index")
    return observations.withColumns({"ego_vx": F.avg("x").over(frame) / 10, "ego_vz": F.avg("z").over(frame) / 50})


EGO = "select video_id, frame_index, avg(x) / 10 as ego_vx, avg(z) / 50 as ego_vz from v_track_obs group by 1, 2"
MOTION = f"""
ego as ({EGO}),
step as (select *, lag(frame_index) over w as pf, lag(x) over w as px, lag(y) over w as py, lag(z) over w as pz from v_track_obs
         window w as (partition by video_id, track_id order by frame_index)),
mot as (select s.*, coalesce(e.ego_vx, 0) as ego_vx, coalesce(e.ego_vz, 0) as ego_vz, pf is not null as has_rel_motion,
          case when pf is null then 0 else (x - px) / greatest(1, s.frame_index - pf) end as obj_vx,
          case when pf is null then 0 else (z - pz) / greatest(1, s.frame_index - pf) end as obj_vz
        from step s left join ego e on e.video_id = s.video_id and e.frame_index = s.frame_index),
motion as (select *, case when has_rel_motion then obj_vx - ego_vx else 0 end as rel_vx, case when has_rel_motion then obj_vz - ego_vz else 0 end as rel_vz,
          case when has_rel_motion then sqrt((obj_vx-ego_vx)*(obj_vx-ego_vx) + (obj_vz-ego_vz)*(obj_vz-ego_vz)) else 0.0 end as rel_speed from mot)
"""


@query(f"""
with {MOTION}
select video_id, track_id, frame_index, round(obj_vx, 6) as obj_vx, round(obj_vz, 6) as obj_vz, round(rel_vx, 6) as rel_vx, round(rel_vz, 6) as rel_vz,
  round(rel_speed, 6) as rel_speed, has_rel_motion from motion""")
def relative_motion(t: Inputs):
    m = tracks.relative_motion(t.track_obs(), ego(t))
    return rounded(m, "video_id", "track_id", "frame_index", "obj_vx", "obj_vz", "rel_vx", "rel_vz", "rel_speed", "has_rel_motion")


@query("""
select video_id, frame_index, round(v, 4) as v from (
select video_id, frame_index, case when frame_index = 0 then nxt else own end as v from (
select video_id, frame_index, case when dt > 0 then (vx - lag(vx) over w) / (dt / 1e6) else 0.0 end as own,
  case when lead(us) over w > us then (lead(vx) over w - vx) / ((lead(us) over w - us) / 1e6) else 0.0 end as nxt
from (select *, us - lag(us) over (partition by video_id order by frame_index) as dt from (select *, epoch_us(ts) as us from v_signal) a) b
window w as (partition by video_id order by frame_index)) c) d""")
def timestamp_velocity(t: Inputs):
    s = t.signal().select("video_id", "frame_index", "vx", F.unix_micros(C("ts").cast("timestamp")).alias("us"))
    return signals.timestamp_velocity(s, V, "frame_index", "us", ["vx"]).select(
        "video_id", "frame_index", settled(C("v_vx"), 4).alias("v")
    )


@query("""
with n as (select video_id, frame_index, vx, vz, frame_index / 5.0 as sec, 0.1 + (frame_index % 3) * 0.2 as sd from v_signal),
e as (select *, coalesce(lag(vx) over w, vx) as lx, coalesce(lead(vx) over w, vx) as rx, coalesce(lag(vz) over w, vz) as lz, coalesce(lead(vz) over w, vz) as rz,
  coalesce(lag(sec) over w, sec) as lt, coalesce(lead(sec) over w, sec) as rt, coalesce(lag(sd) over w, sd) as ls, coalesce(lead(sd) over w, sd) as rs from n
  window w as (partition by video_id order by frame_index)),
s as (select *, sqrt(pow(rx-lx,2) + pow(rz-lz,2)) / (rt-lt) as speed, 2.0 * sqrt(2 * (rs*rs + ls*ls)) / (rt-lt) as u from e where rt - lt > 1e-9)
select e.video_id, e.frame_index, round(speed, 6) as speed, round(greatest(0, speed - u), 6) as speed_low, round(speed + u, 6) as speed_high
from e left join s on s.video_id = e.video_id and s.frame_index = e.frame_index""")
def central_velocity(t: Inputs):
    s = t.signal().select(
        "video_id", "frame_index", "vx", "vz", (C("frame_index") / 5.0).alias("sec"), (0.1 + (C("frame_index") % 3) * 0.2).alias("sd")
    )
    out = signals.central_velocity(s, V, "frame_index", "sec", ["vx", "vz"], "sd", 2.0)
    return rounded(out, "video_id", "frame_index", "speed", "speed_low", "speed_high")


@query("""
with b as (select video_id, frame_index, vz, first_value(vz) over (partition by video_id order by frame_index) as f, first_value(vz) over (partition by video_id order by frame_index desc) as l,
   count(*) over (partition by video_id) as n from v_signal)
select video_id, frame_index,
  round((sum(vz) over (w rows between 3 preceding and 2 following) + greatest(0, 3 - frame_index) * f + greatest(0, 2 - (n - 1 - frame_index)) * l) / 6, 6) as padded6,
  round((sum(vz) over (w rows between 2 preceding and 2 following) + greatest(0, 2 - frame_index) * f + greatest(0, 2 - (n - 1 - frame_index)) * l) / 5, 6) as padded_odd,
  round(avg(vz) over (w rows between 2 preceding and 2 following), 6) as shrinking,
  round(sum(vz) over (w rows between 2 preceding and 2 following) / 5, 6) as zero_padded
from b window w as (partition by video_id order by frame_index)""")
def moving_means(t: Inputs):
    s = t.signal().select("video_id", "frame_index", "vz")
    out = signals.rolling(
        s,
        V,
        "frame_index",
        3,
        padded6=signals.edge_padded_mean("vz", 6),
        padded_odd=signals.edge_padded_mean("vz", signals.odd(4)),
        shrinking=signals.shrinking_mean("vz", 4),
        zero_padded=signals.zero_padded_mean("vz", 5),
    )
    return rounded(out, "video_id", "frame_index", "padded6", "padded_odd", "shrinking", "zero_padded")


@query("""
select video_id, track_id, frame_index, round(avg(x) over (partition by video_id, track_id order by frame_index range between 2 preceding and 2 following), 6) as smooth_x,
 round(avg(z) over (partition by video_id, track_id order by frame_index rows between 2 preceding and 2 following), 6) as observed_z
from v_track_obs""")
def presence_means(t: Inputs):
    obs = t.track_obs().select("video_id", "track_id", "frame_index", "x", "z")
    smooth = signals.presence_mean(obs, tracks.TRACK, "frame_index", "x", 2, "smooth_x")
    dense = by_step(tracks.TRACK, "frame_index", 8192).scan(smooth, at=row_number())
    out = signals.rolling(dense, tracks.TRACK, "at", 2, observed_z=signals.shrinking_mean("z", 5))
    return rounded(out, "video_id", "track_id", "frame_index", "smooth_x", "observed_z")


@query("""
with m as (select video_id, frame_index, vz, median(vz) over (partition by video_id order by frame_index rows between 2 preceding and 2 following) as med from v_signal),
g as (select video_id, median(abs(vz - med)) as mad from m group by 1)
select m.video_id, frame_index, round(med, 6) as med, round(case when abs(vz - med) > 3 * 1.4826 * mad then med else vz end, 6) as cleaned
from m join g on g.video_id = m.video_id""")
def median_outliers(t: Inputs):
    s = signals.rolling(t.signal().select("video_id", "frame_index", "vz"), V, "frame_index", 2, med=signals.rolling_median("vz", 2))
    off = F.abs(C("vz") - C("med"))
    mads = quantiles(s.withColumn("off", off), V, "off", mad=0.5)
    out = s.join(mads, "video_id").withColumn("cleaned", F.when(off > 3 * 1.4826 * C("mad"), C("med")).otherwise(C("vz")))
    return rounded(out, "video_id", "frame_index", "med", "cleaned")


@query("""
with s as (select video_id, frame_index, vz, epoch_us(ts) as us from v_signal),
d as (select *, (us - lag(us) over w) / 1e6 as dt, vz - lag(vz) over w as dv from s window w as (partition by video_id order by frame_index)),
f as (select video_id, median(dt) as fb from d where dt > 0 group by 1),
a as (select d.video_id, frame_index, dv / case when dt > 0 then dt else coalesce(fb, 0.5) end as acc from d left join f on f.video_id = d.video_id)
select video_id, frame_index, round(coalesce(acc, lead(acc) over (partition by video_id order by frame_index), 0), 6) as acceleration from a""")
def acceleration(t: Inputs):
    s = t.signal().select("video_id", "frame_index", "vz", F.unix_micros(C("ts").cast("timestamp")).alias("us"))
    near = signals.rolling(
        s,
        V,
        "frame_index",
        1,
        dt=lambda w: (C("us") - F.lag("us").over(w)) / 1e6,
        dv=lambda w: C("vz") - F.lag("vz").over(w),
        next_dt=lambda w: (F.lead("us").over(w) - C("us")) / 1e6,
        next_dv=lambda w: F.lead("vz").over(w) - C("vz"),
    )
    usual = quantiles(near.filter("dt > 0").select("video_id", "dt"), V, "dt", usual=0.5)
    out = near.join(usual, "video_id", "left")
    rate = lambda dv, dt: C(dv) / F.when(C(dt) > 0, C(dt)).otherwise(F.coalesce("usual", F.lit(0.5)))
    both = F.coalesce(rate("dv", "dt"), rate("next_dv", "next_dt"), F.lit(0.0))
    return rounded(out.withColumn("acceleration", both), "video_id", "frame_index", "acceleration")


@query("""
with s as (select *, vz - lag(vz) over (partition by video_id order by frame_index) as step from v_signal)
select video_id, count(*) as n, round(min(vz), 6) as low, round(max(vz), 6) as high, round(avg(vz), 6) as mean, round(stddev_pop(vz), 6) as std,
  round(arg_max(vz, frame_index) - arg_min(vz, frame_index), 6) as delta, round(abs(arg_max(vz, frame_index) - arg_min(vz, frame_index)), 6) as abs_delta,
  round(coalesce(avg(abs(step)), 0), 6) as mean_abs_step, round(coalesce(max(abs(step)), 0), 6) as max_abs_step
from s group by 1""")
def numeric_profile(t: Inputs):
    p = tracks.numeric_profile(t.signal().select("video_id", "frame_index", "vz"), V, "frame_index", "vz")
    
    return rounded(p, "video_id", "n", "low", "high", "mean", "std", "delta", "abs_delta", "mean_abs_step", "max_abs_step")


PROFILE = """
o as (select *, case label when 'R' then 'repaired' when 'A' then 'merged' else 'observed' end as source from v_track_obs),
s as (select *, frame_index - lag(frame_index) over w as hop, x - lag(x) over w as dx, y - lag(y) over w as dy, z - lag(z) over w as dz from o
      window w as (partition by video_id, track_id order by frame_index)),
prof as (select video_id, track_id, count(*) as observations, min(frame_index) as start_frame, max(frame_index) as end_frame, count_if(hop > 1) as gaps, coalesce(max(hop), 0) as max_gap,
  coalesce(avg(hop), 0) as mean_gap, coalesce(sum(sqrt(dx*dx+dy*dy+dz*dz)), 0) as path_3d, coalesce(sum(sqrt(dx*dx+dz*dz)), 0) as path_xz,
  avg(case when source = 'repaired' then 1.0 else 0 end) as repaired_ratio, avg(case when source = 'merged' then 1.0 else 0 end) as merged_ratio,
  avg(case when hop is null then 0.0 else 1 end) as motion_ratio, avg(score) as mean_score,
  sqrt(pow(arg_max(x, frame_index) - arg_min(x, frame_index), 2) + pow(arg_max(y, frame_index) - arg_min(y, frame_index), 2) + pow(arg_max(z, frame_index) - arg_min(z, frame_index), 2)) as displacement_3d,
  max(frame_index) - min(frame_index) + 1 as frame_span, count(*) / (max(frame_index) - min(frame_index) + 1) as coverage
  from s group by 1, 2)"""


def sourced(t: Inputs):
    return with_source(t.track_obs())


def with_source(observations):
    label = C("label")
    return observations.withColumn("source", F.when(label == "R", "repaired").when(label == "A", "merged").otherwise("observed"))


@query(f"""
with {PROFILE}
select video_id, track_id, observations, start_frame, end_frame, gaps, max_gap, frame_span, round(coverage, 6) as coverage, round(mean_gap, 6) as mean_gap, round(path_3d, 6) as path_3d, round(path_xz, 6) as path_xz,
  round(repaired_ratio, 6) as repaired_ratio, round(merged_ratio, 6) as merged_ratio, round(motion_ratio, 6) as motion_ratio, round(displacement_3d, 6) as displacement_3d from prof""")
def track_profile(t: Inputs):
    return rounded(
        tracks.track_profile(sourced(t)),
        "video_id", "track_id", "observations", "start_frame", "end_frame", "gaps", "max_gap", "frame_span", "coverage",
        "mean_gap", "path_3d", "path_xz", "repaired_ratio", "merged_ratio", "motion_ratio", "displacement_3d",
    )


@query(f"""
with {PROFILE}
select video_id, track_id, round(least(1.0, 0.25*repaired_ratio + 0.15*merged_ratio + 0.25*(1-motion_ratio) + 0.15*least(1.0, gaps/greatest(1.0, observations)) + 0.1*greatest(0, 1-mean_score)
  + 0.1*(0.35*repaired_ratio + 0.2*merged_ratio)), 6) as uncertainty from prof""")
def track_uncertainty(t: Inputs):
    p = tracks.track_profile(sourced(t))
    u = tracks.track_uncertainty(p, 0.35 * C("repaired_ratio") + 0.2 * C("merged_ratio"))
    return rounded(p.withColumn("uncertainty", u), "video_id", "track_id", "uncertainty")


@query(f"""
with b as (select video_id, track_id, frame_index, z as v, greatest(1e-6, 1e-3 * greatest(1.0, max(abs(z)) over (partition by video_id, track_id))) as eps from v_track_obs),
s as (select *, (v - lag(v) over w) / greatest(1, frame_index - lag(frame_index) over w) as step from b window w as (partition by video_id, track_id order by frame_index)),
g as (select video_id, track_id, count(*) as n, arg_min(v, frame_index) as st, arg_max(v, frame_index) as en, avg(v) as mean, stddev_pop(v) as std, max(v) - min(v) as rng,
  coalesce(case when count(*) > 1 then regr_slope(v, frame_index) end, 0) as slope, stddev_pop(frame_index) as fs, max(eps) as eps, count(step) as steps, count_if(step > eps) as up, count_if(step < -eps) as dn,
  count_if(v > eps) as ab, count_if(v < -eps) as be from s group by 1, 2),
h as (select *, en - st as delta, greatest(0, least(1, 1 - sqrt(greatest(0, std*std - pow(slope*fs, 2))) / greatest(1e-6, rng, abs(en - st), std))) as coh,
  abs(en - st) <= eps and abs(slope) <= eps as flat from g),
k as (select *, case when flat and up + dn = 0 then 1.0 when flat then greatest(0, 1 - (up + dn) / greatest(1, steps)) when up + dn > 0 then case when slope >= 0 then up else dn end / (up + dn) else 0 end as cons from h)
select video_id, track_id, n, round(delta, 6) as delta, round(slope, 6) as slope, round(mean, 6) as mean, case when flat then 'stable' when cons >= 0.6 then case when slope >= 0 then 'increasing' else 'decreasing' end else 'mixed' end as trend,
  case when ab = 0 and be = 0 then 'near_zero' when ab / n >= 0.7 then 'positive' when be / n >= 0.7 then 'negative' else 'mixed' end as level, round(coh, 5) as coherence, round(cons, 6) as consistency,
  round(greatest(0, least(1, 0.8 * least(1, (n - 1) / 4.0) * (0.55 * coh + 0.45 * cons))), 5) as confidence from k""")
def linear_trend(t: Inputs):
    out = tracks.linear_trend(t.track_obs().select("video_id", "track_id", "frame_index", "z"), tracks.TRACK, "frame_index", "z", 0.8)
    out = out.withColumn("coherence", settled(C("coherence"), 5)).withColumn("confidence", settled(C("confidence"), 5))
    return rounded(out, "video_id", "track_id", "n", "delta", "slope", "mean", "trend", "level", "coherence", "consistency", "confidence")


@query(f"""
with {MOTION},
st as (select *, frame_index - lag(frame_index) over w as hop, lag(x) over w as qx, lag(z) over w as qz, lag(rel_vx) over w as qvx, lag(rel_vz) over w as qvz, lag(rel_speed) over w as qs, lag(has_rel_motion) over w as qh
  from motion window w as (partition by video_id, track_id order by frame_index)),
k as (select *, (z - qz) / greatest(1, hop) as sz, case when has_rel_motion and qh then sqrt(pow(rel_vx-qvx,2)+pow(rel_vz-qvz,2)) end as jump from st)
select video_id, track_id, round(max(abs(sz)), 6) as max_depth_step, round(max(least(abs(sz), abs(sz - ego_vz), abs(sz + ego_vz))) filter (sz is not null), 6) as max_compensated_depth_step,
  round(max(sqrt(pow(x-qx,2)+pow(z-qz,2)) / greatest(1, hop)), 6) as max_plane_step, round(avg(jump), 6) as mean_velocity_change, round(max(jump), 6) as max_velocity_change,
  round(max(case when has_rel_motion and qh then abs(rel_speed - qs) end), 6) as max_speed_change,
  count_if(has_rel_motion and qh and rel_speed > 0.3 and qs > 0.3 and rel_vx*qvx + rel_vz*qvz < 0) as reversals
from k group by 1, 2""")
def track_step_metrics(t: Inputs):
    m = tracks.step_metrics(tracks.relative_motion(t.track_obs(), ego(t)))
    return rounded(m, *m.columns)


@query("""
with o as (select *, frame_index - lag(frame_index) over w - 1 > 2 as cut from v_track_obs window w as (partition by video_id, track_id order by frame_index)),
p as (select *, cast(sum(case when cut then 1 else 0 end) over (partition by video_id, track_id order by frame_index) as bigint) as part from o),
n as (select video_id, track_id, part, row_number() over (partition by video_id order by track_id, part) as k from (select distinct video_id, track_id, part from p where part > 0) a),
m as (select video_id, max(track_id) as top from v_track_obs group by 1)
select p.video_id, p.track_id, p.frame_index, p.part, coalesce(m.top + n.k, p.track_id) as new_id
from p join m on m.video_id = p.video_id left join n on n.video_id = p.video_id and n.track_id = p.track_id and n.part = p.part""")
def split_tracks_at_gaps(t: Inputs):
    obs = t.track_obs().select("video_id", "track_id", "frame_index")
    return tracks.split_at_gaps(obs, 2).select("video_id", "track_id", "frame_index", "part", "new_id")


@query("""
with s as (select *, case when vz < -20 then 'backward' when vz > 20 then 'forward' when label = 'signup' then 'unknown' else 'static' end as state from v_signal),
k as (select *, lag(state) over (partition by video_id order by frame_index) as prev from s where state <> 'unknown')
select video_id, count_if(state <> prev) as transitions, count_if((state = 'forward' and prev = 'backward') or (state = 'backward' and prev = 'forward')) as reversals from k group by 1""")
def state_transitions(t: Inputs):
    vz = C("vz")
    state = F.when(vz < -20, "backward").when(vz > 20, "forward").when(C("label") == "signup", "unknown").otherwise("static")
    s = t.signal().select("video_id", "frame_index", state.alias("state"))
    return signals.transitions(s, V, "frame_index", "state", ("forward", "backward"))


@query("""
select video_id, frame_index, coalesce(count(vz) over w >= 4 and vz > avg(vz) over w + 2.0 * stddev_pop(vz) over w, false) as spike
from v_signal window w as (partition by video_id order by frame_index rows between 8 preceding and 1 preceding)""")
def spikes(t: Inputs):
    s = t.signal().select("video_id", "frame_index", "vz")
    return signals.spikes(s, V, "frame_index", "vz", 8, 2.0, 4).select("video_id", "frame_index", "spike")


@query("""
select video_id, segment_index,
  coalesce(max(h) over (w rows between 1 following and 1 following), 0) = 1 as within_1, coalesce(max(h) over (w rows between 1 following and 3 following), 0) = 1 as within_3,
  cast(min(case when h = 1 then segment_index end) over (w rows between 1 following and unbounded following) - segment_index as int) as first_horizon,
  count(*) over (w rows between 1 following and unbounded following) as remaining
from (select *, case when forward_label = 'forward_slowdown' then 1 else 0 end as h from v_segments) t window w as (partition by video_id order by segment_index)""")
def future_events(t: Inputs):
    from trackloom.operators.ordered import total, upcoming

    hit = C("forward_label") == "forward_slowdown"
    s = t.segments().select("video_id", "segment_index", "forward_label")
    at = by_step(V, "segment_index", 4096).scan(
        s, hit_at=upcoming(F.when(hit, C("segment_index"))), n=total(1)
    )
    # the first event strictly after the row is the upcoming one of the next row
    near = signals.rolling(
        at,
        V,
        "segment_index",
        3,
        within_1=lambda w: F.coalesce(F.max(hit.cast("int")).over(w.rowsBetween(1, 1)), F.lit(0)) == 1,
        within_3=lambda w: F.coalesce(F.max(hit.cast("int")).over(w.rowsBetween(1, 3)), F.lit(0)) == 1,
        next_hit=lambda w: F.lead("hit_at").over(w),
    )
    return near.select(
        "video_id",
        "segment_index",
        "within_1",
        "within_3",
        (C("next_hit") - C("segment_index")).alias("first_horizon"),
        (C("n") - 1 - C("segment_index")).alias("remaining"),
    )


@query("""
with q as (select video_id, count(*) as n, avg(vz) as mean, stddev_pop(vz) as std, median(vz) as med, quantile_cont(vz, 0.25) as q25, quantile_cont(vz, 0.75) as q75 from v_signal group by 1),
m as (select s.video_id, median(abs(vz - med)) as mad from v_signal s join q on q.video_id = s.video_id group by 1)
select q.video_id, n, round(mean, 6) + 0.0 as mean, round(std, 6) as std, round(med, 6) as med, round(mad, 6) as mad, round(q25, 6) as q25, round(q75, 6) as q75,
  round(case when 1.4826*mad > 0 then 1.4826*mad when (q75-q25)/1.349 > 0 then (q75-q25)/1.349 when greatest(abs(med), std) > 0 then greatest(abs(med), std) else 1 end, 6) as scale,
  case when 1.4826*mad > 0 then 'scaled_mad' when (q75-q25)/1.349 > 0 then 'iqr_scale' when greatest(abs(med), std) > 0 then 'median_or_std_scale' else 'degenerate_unit_scale' end as scale_method
from q join m on m.video_id = q.video_id""")
def robust_statistics(t: Inputs):
    from trackloom.operators.robust import robust_statistics as robust

    out = robust(t.signal().select("video_id", "vz"), V, "vz")
    return rounded(out, "video_id", "n", "mean", "std", "med", "mad", "q25", "q75", "scale", "scale_method")


@query("""
select label, round(quantile_cont(vz, 0.05), 6) as q05, round(quantile_cont(vz, 0.25), 6) as q25, round(quantile_cont(vz, 0.5), 6) as q50, round(quantile_cont(vz, 0.95), 6) as q95 from v_signal group by 1""")
def label_quantiles(t: Inputs):
    return rounded(quantiles(t.signal(), ["label"], "vz", q05=0.05, q25=0.25, q50=0.5, q95=0.95), "label", "q05", "q25", "q50", "q95")


@query("""
with w as (select label, vz, 1.0 + frame_index % 5 as w from v_signal), g as (select label, vz, sum(w) as w from w group by 1, 2),
c as (select *, sum(w) over (partition by label order by vz) as cum, sum(w) over (partition by label) as tot from g),
m as (select label, min(vz) as weighted_median from c where cum * 2 >= tot group by 1), a as (select label, sum(vz * w) / sum(w) as weighted_mean from w group by 1)
select m.label, round(weighted_median, 6) as weighted_median, round(weighted_mean, 6) as weighted_mean from m join a on a.label = m.label""")
def weighted_medians(t: Inputs):
    s = t.signal().select("label", "vz", (1.0 + C("frame_index") % 5).alias("w"))
    mean = s.groupBy("label").agg((F.sum(C("vz") * C("w")) / F.sum("w")).alias("weighted_mean"))
    out = weighted_median(s, ["label"], "vz", "w", "weighted_median").join(mean, "label")
    return rounded(out, "label", "weighted_median", "weighted_mean")


@query("""
with h as (select *, atan2(vz, vx) as a from v_signal where sqrt(vx*vx + vz*vz) > 0.5),
d as (select *, a - lag(a) over (partition by video_id order by frame_index) as raw from h),
u as (select *, raw - 2*pi() * floor((raw + pi()) / (2*pi())) as turn from d)
select video_id, count(*) as headings, round(coalesce(avg(case when turn is null then null when abs(turn) > 0.12 then 1.0 else 0 end), 0), 6) as turning_ratio,
  case when count(*) < 2 then 'unknown' when avg(case when turn is null then null when abs(turn) > 0.12 then 1.0 else 0 end) >= 0.5 then 'turning'
       when 1 - avg(case when turn is null then null when abs(turn) > 0.12 then 1.0 else 0 end) >= 0.7 then 'not_turning' else 'uncertain' end as state,
  round(1 - sqrt(pow(avg(sin(a)),2) + pow(avg(cos(a)),2)), 6) as dispersion
from u group by 1""")
def turning_states(t: Inputs):
    from trackloom.operators.motion_states import turning

    return rounded(turning(t.signal(), V, "frame_index", "vx", "vz", 0.5, 0.12), "video_id", "headings", "turning_ratio", "state", "dispersion")


@query("""
with d as (select *, z - lag(z) over (partition by video_id, track_id order by frame_index) as step from v_track_obs),
g as (select video_id, track_id, count(*) as n, avg(case when step is null then null when step < -5 then 1.0 else 0 end) as ap, avg(case when step is null then null when step > 5 then 1.0 else 0 end) as aw,
  avg(case when step is null then null when abs(step) <= 5 then 1.0 else 0 end) as st, arg_max(z, frame_index) - arg_min(z, frame_index) as tot from d group by 1, 2)
select video_id, track_id, case when n < 2 then 'unknown' when ap >= 0.6 then 'approaching' when aw >= 0.6 then 'moving_away' when st >= 0.6 then 'stable' when tot < -5 then 'approaching' when tot > 5 then 'moving_away' else 'stable' end as state,
  round(case when n < 2 then 0 when ap >= 0.6 then ap when aw >= 0.6 then aw when st >= 0.6 then st when tot < -5 then greatest(ap, 0.5) when tot > 5 then greatest(aw, 0.5) else greatest(st, 0.5) end, 6) as confidence from g""")
def distance_trends(t: Inputs):
    from trackloom.operators.motion_states import distance_trend

    return rounded(distance_trend(t.track_obs(), tracks.TRACK, "frame_index", "z", 5.0, 0.6), "video_id", "track_id", "state", "confidence")


@query("""
with v as (select *, lag(vx) over w as ax, lag(vz) over w as az, lead(vx) over w as bx, lead(vz) over w as bz from (select video_id, frame_index, vx / 20 as vx, vz / 50 as vz from v_signal) s window w as (partition by video_id order by frame_index)),
k as (select *, sqrt(ax*ax+az*az) > 0.1 and sqrt(bx*bx+bz*bz) > 0.1 as chk, acos(greatest(-1, least(1, (ax*bx+az*bz) / (sqrt(ax*ax+az*az) * sqrt(bx*bx+bz*bz))))) > pi()/4 as chg from v),
g as (select video_id, count(*) as n, count_if(chk and chg) as changes, count_if(chk) as checks from k group by 1)
select video_id, changes, checks, round(case when n < 3 or checks = 0 then 0 when changes > 2 then least(1, changes / greatest(1, checks) + 0.3) else changes / greatest(1, checks) end, 6) as confidence from g""")
def direction_changes(t: Inputs):
    from trackloom.operators.motion_states import direction_changes as changes

    s = t.signal().select("video_id", "frame_index", (C("vx") / 20).alias("vx"), (C("vz") / 50).alias("vz"))
    return rounded(changes(s, V, "frame_index", "vx", "vz"), "video_id", "changes", "checks", "confidence")


@query("""

select video_id, frame_index, track_id, cast(row_number() over (partition by video_id, frame_index order by z, track_id) as int) as distance_rank from v_track_obs""")
def frame_distance_ranks(t: Inputs):
    from pyspark.sql.window import Window as W

    # a frame holds at most one row per track, so the window is bounded by the objects seen at once
    w = W.partitionBy("video_id", "frame_index").orderBy("z", "track_id")
    return t.track_obs().select("video_id", "frame_index", "track_id", F.row_number().over(w).alias("distance_rank"))


@query("""
with m as (select video_id, track_id, median(z) as med from v_track_obs group by 1, 2)
select video_id, track_id, round(med, 6) as med, row_number() over (partition by video_id order by med, track_id) - 1 as track_rank from m""")
def track_distance_ranks(t: Inputs):
    from trackloom.operators.ordered import Ordered, value_bucket

    med = quantiles(t.track_obs(), tracks.TRACK, "z", med=0.5)
    by_distance = Ordered(V, ["med", "track_id"], value_bucket(C("med")))
    out = by_distance.scan(med, n=row_number()).withColumn("track_rank", C("n") - 1)
    return rounded(out, "video_id", "track_id", "med", "track_rank")


@query("""
select video_id, segment_index, forward_label, nxt as next_label, nxt = 'forward_slowdown' as label from (select *, lead(forward_label) over (partition by video_id order by segment_index) as nxt from v_segments) t where nxt is not null""")
def next_segment_targets(t: Inputs):
    return (
        t.segments(with_next=True)
        .filter("next_label is not null")
        .select("video_id", "segment_index", "forward_label", "next_label", (C("next_label") == "forward_slowdown").alias("label"))
    )


@query("""
with f as (select video_id, frame_index, median(x) as mx, median(z) as mz from v_track_obs group by 1, 2)
select video_id, frame_index, round(mx, 6) as ego_vx, round(mz, 6) as ego_vz, round((mz - avg(mz) over (partition by video_id)) / (stddev_pop(mz) over (partition by video_id) + 1e-6), 5) as z_score from f""")
def median_ego_velocity(t: Inputs):
    # objects of one frame: a bounded group, so the built-in exact percentile fits
    half = F.lit(0.5)
    per_frame = t.track_obs().groupBy("video_id", "frame_index").agg(
        F.percentile(C("x"), half).alias("ego_vx"), F.percentile(C("z"), half).alias("ego_vz")
    )
    per_video = per_frame.groupBy("video_id").agg(F.avg("ego_vz").alias("m"), F.stddev_pop("ego_vz").alias("s"))
    out = per_frame.join(per_video, "video_id").withColumn("z_score", settled((C("ego_vz") - C("m")) / (C("s") + 1e-6), 5))
    return rounded(out, "video_id", "frame_index", "ego_vx", "ego_vz", "z_score")


@query("""
with s as (select *, vz - lag(vz) over (partition by video_id order by frame_index) as step from v_signal)
select video_id, round(avg(vz),6) + 0.0 as mean, round(max(vz) - min(vz), 6) as amplitude, round(var_pop(vz), 4) as variance, round(coalesce(case when count(*) > 1 then regr_slope(vz, frame_index) end, 0), 6) as slope,
  round(coalesce(avg(abs(step)), 0), 6) as mean_abs_step, round(coalesce(max(abs(step)), 0), 6) as max_abs_step, round(sum(vz*vz), 3) as energy from s group by 1""")
def segment_primitives(t: Inputs):
    moved = by_step(V, "frame_index", 8192).scan(t.signal().select("video_id", "frame_index", "vz"), before=previous(C("vz")))
    step, v = F.abs(C("vz") - C("before")), C("vz")
    return moved.groupBy("video_id").agg(
        settled(F.avg(v), 6).alias("mean"),
        settled(F.max(v) - F.min(v), 6).alias("amplitude"),
        settled(F.var_pop(v), 4).alias("variance"),
        settled(F.coalesce(F.regr_slope(v, C("frame_index").cast("double")), F.lit(0.0)), 6).alias("slope"),
        settled(F.coalesce(F.avg(step), F.lit(0.0)), 6).alias("mean_abs_step"),
        settled(F.coalesce(F.max(step), F.lit(0.0)), 6).alias("max_abs_step"),
        settled(F.sum(v * v), 3).alias("energy"),
    )


@query("""
with b as (select *, 0.1 * stddev_pop(z) over (partition by video_id, track_id) as band, z - lag(z) over (partition by video_id, track_id order by frame_index) as step from v_track_obs),
s as (select *, sign(step) as sg from b), k as (select *, lag(sg) over (partition by video_id, track_id order by frame_index) as psg from s),
g as (select video_id, track_id, count(step) as n, coalesce(avg(case when step is null then null when step < -band then 1.0 else 0 end), 0) as ap, coalesce(avg(case when step is null then null when step > band then 1.0 else 0 end), 0) as aw,
  count_if(sg <> psg) as flips from k group by 1, 2)
select video_id, track_id, case when n = 0 then 'unknown' when ap > 0.7 then 'approaching' when aw > 0.7 then 'moving_away' else 'stable' end as state, round(ap, 6) as approaching_ratio, round(aw, 6) as away_ratio, round(flips / greatest(1, n - 1), 6) as flip_ratio from g""")
def adaptive_motion_states(t: Inputs):
    from trackloom.operators.motion_states import adaptive_motion

    out = adaptive_motion(t.track_obs(), tracks.TRACK, "frame_index", "z", 0.1, 0.7)
    return rounded(out, "video_id", "track_id", "state", "approaching_ratio", "away_ratio", "flip_ratio")


@query(f"""
with {MOTION}, g as (select video_id, track_id, avg(case when rel_vz < -0.2 then 1.0 else 0 end) as lo, avg(case when rel_vz > 0.2 then 1.0 else 0 end) as hi, avg(case when abs(rel_vz) <= 0.2 then 1.0 else 0 end) as mid, avg(rel_vz) as m
   from motion where has_rel_motion group by 1, 2)
select video_id, track_id, round(lo, 6) as low_ratio, round(hi, 6) as high_ratio, case when lo >= 0.6 then 'vz_approaching' when hi >= 0.6 then 'vz_awaying' when mid >= 0.6 then 'vz_stable' when m < -0.2 then 'vz_approaching' when m > 0.2 then 'vz_awaying' else 'vz_stable' end as state from g""")
def dominant_motion_states(t: Inputs):
    from trackloom.operators.motion_states import dominance

    m = tracks.relative_motion(t.track_obs(), ego(t)).filter("has_rel_motion")
    out = dominance(m, tracks.TRACK, "rel_vz", 0.2, 0.6, ("vz_approaching", "vz_stable", "vz_awaying"))
    return rounded(out, "video_id", "track_id", "low_ratio", "high_ratio", "state")


@query("""
with p as (select video_id, track_id, frame_index, x, z, lag(x, 3) over w as bx, lag(z, 3) over w as bz, lag(frame_index, 3) over w as bf, first_value(x) over w as fx, first_value(z) over w as fz, first_value(frame_index) over w as ff,
   row_number() over w as rn from v_track_obs window w as (partition by video_id, track_id order by frame_index))
select video_id, track_id, frame_index, round(case when rn = 1 then 0 else (x - coalesce(bx, fx)) / greatest(1, frame_index - coalesce(bf, ff)) end, 6) as obj_vx,
  round(case when rn = 1 then 0 else (z - coalesce(bz, fz)) / greatest(1, frame_index - coalesce(bf, ff)) end, 6) as obj_vz from p""")
def windowed_velocity(t: Inputs):
    obs = t.track_obs().select("video_id", "track_id", "frame_index", "x", "z")
    dense = by_step(tracks.TRACK, "frame_index", 8192).scan(obs, at=row_number())
    # rows nearer to the start than the window compare with the first row
    past = lambda c: lambda w: F.first(c).over(w.rowsBetween(-3, 0))
    out = signals.rolling(dense, tracks.TRACK, "at", 3, bx=past("x"), bz=past("z"), bf=past("frame_index"))
    hop = F.greatest(F.lit(1), C("frame_index") - C("bf"))
    out = out.withColumn("obj_vx", (C("x") - C("bx")) / hop).withColumn("obj_vz", (C("z") - C("bz")) / hop)
    return rounded(out, "video_id", "track_id", "frame_index", "obj_vx", "obj_vz")


@query("""
with d as (select video_id, track_id, frame_index, x, z from v_track_obs), s as (select *, x - lag(x) over w as dx, z - lag(z) over w as dz from d window w as (partition by video_id, track_id order by frame_index)),
u as (select *, sqrt(dx*dx+dz*dz) as n from s), k as (select video_id, track_id, avg(dx/n) as ax, avg(dz/n) as az from u where n > 0.1 group by 1, 2),
v as (select u.video_id, u.track_id, avg(sqrt(pow(dx/n - ax, 2) + pow(dz/n - az, 2))) as dev from u join k on k.video_id = u.video_id and k.track_id = u.track_id where n > 0.1 group by 1, 2),
c as (select video_id, track_id, count(*) as cnt from d group by 1, 2)
select c.video_id, c.track_id, round(case when cnt < 3 or dev is null then 0.5 else greatest(0, least(1, 1 - dev / 2)) end, 6) as linearity from c left join v on v.video_id = c.video_id and v.track_id = c.track_id""")
def linear_motion_confidence(t: Inputs):
    from trackloom.operators.motion_states import linearity

    return rounded(linearity(t.track_obs(), tracks.TRACK, "frame_index", "x", "z"), "video_id", "track_id", "linearity")
