"""Repair search over the observed tracks: all candidates, the chosen ones, and the tracks after them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.numbers import settled
from trackloom.operators import repair_search as rs
from trackloom.plans.catalog import query, rounded
from trackloom.plans.sequences import EGO, ego_of, with_source
from trackloom.plans.views import Inputs

C = F.col


def boxed(observations):
    """Observations with a box made of place and depth."""
    left, top = C("x") * 4, C("y")
    return with_source(observations).withColumns({"x1": left, "y1": top, "x2": left + 60 + 2 * C("z"), "y2": top + 40 + C("z")})


def candidates_of(observations, whole: bool):
    if whole:
        return rs.tried(rs.gathered(boxed(observations), ego_of(observations)))
    return rs.repair_candidates(boxed(observations), ego_of(observations))[0]


def repaired_of(observations, whole: bool):
    if whole:
        found = rs.gathered(boxed(observations), ego_of(observations))
        return rs.repaired(found, rs.chosen_repairs(rs.tried(found)))
    candidates, rows, first = rs.repair_candidates(boxed(observations), ego_of(observations))
    return rs.repaired_tracks(rows, first, rs.chosen_repairs(candidates))


TESTED = f"""
ob as (select video_id, track_id, frame_index, label, case label when 'R' then 'repaired' when 'A' then 'merged' else 'observed' end as source, score, x, z, 4 * x as x1, y as y1, 4 * x + 60 + 2 * z as x2, y + 40 + z as y2 from v_track_obs),
eg as ({EGO}),
ct as (select video_id, track_id, label, count(*) as k, min(frame_index) as f from ob group by 1, 2, 3),
dm as (select video_id, track_id, label as dominant from (select *, row_number() over (partition by video_id, track_id order by k desc, f) as r from ct) where r = 1),
pr as (select ob.*, dominant, cand from ob join dm using (video_id, track_id) cross join (values ('original'), ('track_split'), ('fragment_reassociation'), ('multi_frame_velocity_recomputation'), ('outlier_removal'), ('depth_reestimation'), ('bbox_stabilization'), ('in_order'), ('cleared')) as v(cand)),
pq as (select * replace (case when cand = 'fragment_reassociation' then dominant else label end as label) from pr where cand not in ('track_split', 'in_order', 'cleared') or label = dominant),
md as (select *, median(x) over w as bx, median(z) over w as bz, median((x1 + x2) / 2) over w as mx, median((y1 + y2) / 2) over w as my, median(abs(x2 - x1)) over w as mw, median(abs(y2 - y1)) over w as mh
  from pq where cand in ('outlier_removal', 'depth_reestimation', 'bbox_stabilization', 'cleared') window w as (partition by cand, video_id, track_id order by frame_index rows between 2 preceding and 2 following)),
m1 as (select cand, video_id, track_id, median(x - bx) as cx, median(z - bz) as cz from md group by 1, 2, 3),
m2 as (select cand, video_id, track_id, greatest(1e-6, median(abs(x - bx - cx))) as sx, greatest(1e-6, median(abs(z - bz - cz))) as sz from md join m1 using (cand, video_id, track_id) group by 1, 2, 3),
fi as (select md.* replace (case when abs(x - bx) > case cand when 'depth_reestimation' then 2.5 else 3.0 end * sx then bx else x end as x, case when abs(z - bz) > case cand when 'depth_reestimation' then 2.5 else 3.0 end * sz then bz else z end as z)
  from md join m2 using (cand, video_id, track_id) where cand <> 'bbox_stabilization'),
ll as (select video_id, track_id, list(frame_index order by frame_index) as f, list(x order by frame_index) as xs, list(z order by frame_index) as zs from ob group by 1, 2),
fw as (select *, list_transform(range(1, len(f) + 1), lambda i: list_reduce(xs[1:i], lambda a, b: 0.55 * b + 0.45 * a)) as fx, list_transform(range(1, len(f) + 1), lambda i: list_reduce(zs[1:i], lambda a, b: 0.55 * b + 0.45 * a)) as fz from ll),
bw as (select *, list_transform(range(1, len(f) + 1), lambda i: list_reduce(list_reverse(fx[i:]), lambda a, b: 0.55 * b + 0.45 * a)) as gx, list_transform(range(1, len(f) + 1), lambda i: list_reduce(list_reverse(fz[i:]), lambda a, b: 0.55 * b + 0.45 * a)) as gz from fw),
ka as (select video_id, track_id, unnest(f) as frame_index, unnest(fx) as fx, unnest(gx) as gx, unnest(fz) as fz, unnest(gz) as gz from bw),
ax as (select video_id, track_id, 'x' as axis, f, xs as v from ll union all select video_id, track_id, 'z', f, zs from ll),
li as (select video_id, track_id, axis, f, v, 0 as turn from ax union all
  select video_id, track_id, axis, list_transform(kept, lambda p: p[1]::int), list_transform(kept, lambda p: p[2]), turn + 1 from (
    select *, list_filter(list_zip(f, v, rest), lambda p: abs(p[3]) <= greatest(1e-6, 3 * list_median(list_transform(rest, lambda r: abs(r - list_median(rest))))) + 1e-9) as kept from (
      select *, list_transform(list_zip(f, v), lambda p: round(p[2] - mv - slope * (p[1] - mf), 9)) as rest from (
        select *, list_sum(list_transform(list_zip(f, v), lambda p: (p[1] - mf) * (p[2] - mv))) / greatest(1e-9, list_sum(list_transform(f, lambda q: (q - mf) * (q - mf)))) as slope from (
          select *, list_avg(f) as mf, list_avg(v) as mv from li where len(f) >= 2) s1) s2) s3) s4 where len(kept) >= 2 and len(kept) < len(f)),
ln as (select video_id, track_id, axis, mf, mv, list_sum(list_transform(list_zip(f, v), lambda p: (p[1] - mf) * (p[2] - mv))) / greatest(1e-9, list_sum(list_transform(f, lambda q: (q - mf) * (q - mf)))) as slope
  from (select *, list_avg(f) as mf, list_avg(v) as mv, row_number() over (partition by video_id, track_id, axis order by turn desc) as r from li) where r = 1),
gp as (select *, lead(frame_index) over w as nf, lead(x) over w as nx, lead(z) over w as nz, lead(x1) over w as n1, lead(y1) over w as n2, lead(x2) over w as n3, lead(y2) over w as n4 from ob window w as (partition by video_id, track_id order by frame_index)),
gi as (select *, unnest(case when nf - frame_index between 2 and 12 then range(0, nf - frame_index) else [0] end) as k from gp),
al as (
  select cand, video_id, track_id, frame_index, label, source, score, x, z, x1, y1, x2, y2 from pq where cand in ('original', 'track_split', 'fragment_reassociation', 'multi_frame_velocity_recomputation', 'in_order')
  union all select cand, video_id, track_id, frame_index, label, source, score, x, z, x1, y1, x2, y2 from fi
  union all select cand, video_id, track_id, frame_index, label, source, score, x, z, mx - mw / 2, my - mh / 2, mx + mw / 2, my + mh / 2 from md where cand = 'bbox_stabilization'
  union all select 'kalman_smoothing', video_id, track_id, frame_index, label, source, score, (fx + gx) / 2, (fz + gz) / 2, x1, y1, x2, y2 from ob join ka using (video_id, track_id, frame_index)
  union all select 'robust_polynomial_regression', video_id, track_id, frame_index, label, source, score, a.mv + a.slope * (frame_index - a.mf), b.mv + b.slope * (frame_index - b.mf), x1, y1, x2, y2
    from ob join (select * from ln where axis = 'x') a using (video_id, track_id) join (select * from ln where axis = 'z') b using (video_id, track_id)
  union all select 'gap_interpolation', video_id, track_id, frame_index + k, label, case when k > 0 then 'repaired' else source end, score, case when k > 0 then x + k / (nf - frame_index) * (nx - x) else x end, case when k > 0 then z + k / (nf - frame_index) * (nz - z) else z end,
    case when k > 0 then x1 + k / (nf - frame_index) * (n1 - x1) else x1 end, case when k > 0 then y1 + k / (nf - frame_index) * (n2 - y1) else y1 end, case when k > 0 then x2 + k / (nf - frame_index) * (n3 - x2) else x2 end, case when k > 0 then y2 + k / (nf - frame_index) * (n4 - y2) else y2 end from gi),
e1 as (select al.*, coalesce(ego_vx, 0) as ex, coalesce(ego_vz, 0) as ez, row_number() over w as pos, lag(al.frame_index) over w as pf, lag(x) over w as px, lag(z) over w as pz, lag(x1) over w as p1, lag(y1) over w as p2, lag(x2) over w as p3, lag(y2) over w as p4,
  lag(al.frame_index, 2) over w as qf, lag(x, 2) over w as qx, lag(z, 2) over w as qz, lag(al.frame_index, 3) over w as rf, lag(x, 3) over w as rx, lag(z, 3) over w as rz
  from al left join eg on eg.video_id = al.video_id and eg.frame_index = al.frame_index window w as (partition by cand, al.video_id, track_id order by al.frame_index)),
e2 as (select *, case when cand like 'multi%' then coalesce(rf, qf, pf) else pf end as sf, case when cand like 'multi%' then coalesce(rx, qx, px) else px end as sx, case when cand like 'multi%' then coalesce(rz, qz, pz) else pz end as sz from e1),
e3 as (select *, case when sf is null then 0 else (x - sx) / greatest(1, frame_index - sf) end as ox, case when sf is null then 0 else (z - sz) / greatest(1, frame_index - sf) end as oz from e2),
e4 as (select *, lag(ox) over w as lox, lag(oz) over w as loz, lag(ex) over w as lex, lag(ez) over w as lez, pos > 2 as bo, pos > 1 as mo, frame_index - pf as hop from e3 window w as (partition by cand, video_id, track_id order by frame_index)),
e5 as (select *, (z - pz) / greatest(1, hop) as dz, x2 - x1 as w, y2 - y1 as h, p3 - p1 as pw, p4 - p2 as ph from e4),
e6 as (select *, case when pf is not null then sqrt(pow((x1 + x2 - p1 - p3) / 2, 2) + pow((y1 + y2 - p2 - p4) / 2, 2)) / greatest(1, hop) / greatest(1.0, (sqrt(w * w + h * h) + sqrt(pw * pw + ph * ph)) / 2) end as drift,
  case when pf is not null then greatest(w / pw, pw / w, h / ph, ph / h, w * h / (pw * ph), pw * ph / (w * h)) end as size from e5),
e7 as (select cand, video_id, track_id, count(*) as n, count(distinct label) as labels, coalesce(max(hop), 0) as max_gap, count_if(hop > 1) as gaps, avg(case when mo then 1.0 else 0 end) as mr, count_if(z < 0 or w <= 0 or h <= 0) as behind,
  coalesce(max(drift), 0) as drift, coalesce(max(size), 1) as size, coalesce(max(least(abs(dz), abs(dz - ez), abs(dz + ez))) filter (pf is not null), 0) as depth,
  coalesce(max(sqrt(pow(ox - ex, 2) + pow(oz - ez, 2))) filter (mo), 0) as ms, coalesce(max(sqrt(pow(ox + ex, 2) + pow(oz + ez, 2))) filter (mo), 0) as ps,
  coalesce(max(sqrt(pow(ox - ex - lox + lex, 2) + pow(oz - ez - loz + lez, 2))) filter (bo), 0) as mc, coalesce(max(sqrt(pow(ox + ex - lox - lex, 2) + pow(oz + ez - loz - lez, 2))) filter (bo), 0) as pc,
  count_if(bo and sqrt(pow(ox - ex, 2) + pow(oz - ez, 2)) > 0.3 and sqrt(pow(lox - lex, 2) + pow(loz - lez, 2)) > 0.3 and (ox - ex) * (lox - lex) + (oz - ez) * (loz - lez) < 0) as reversals,
  count_if(source = 'repaired') as fixed, count_if(source = 'merged') as merged, avg(score) as score from e6 group by 1, 2, 3),
e8 as (select *, case when ms < ps or (ms = ps and mc <= pc) then ms else ps end as speed, case when ms < ps or (ms = ps and mc <= pc) then mc else pc end as delta from e7),
e9 as (select *, list_filter([case when behind > 0 then 'physical_invalidity' end, case when labels > 1 then 'id_switch' end, case when max_gap > 3 then 'trajectory_discontinuity' end, case when drift > 2 then 'track_drift' end, case when size > 3 then 'bbox_jump' end,
    case when depth > 8 then 'depth_jump' end, case when delta > 10 or speed > 25 then 'speed_abnormal_change' end, case when reversals > 1 then 'motion_direction_abrupt_change' end], lambda v: v is not null) as inv,
  list_filter([case when n < 2 then 1 end, case when max_gap in (2, 3) then 1 end, case when mr < 0.5 then 1 end, case when drift > 1 and drift <= 2 then 1 end, case when size > 2 and size <= 3 then 1 end, case when depth > 4 and depth <= 8 then 1 end,
    case when not (delta > 10 or speed > 25) and (delta > 5 or speed > 12) then 1 end, case when reversals = 1 then 1 end], lambda v: v is not null) as unc from e8),
ev as (select *, case when len(inv) > 0 then 'invalid' when len(unc) > 0 then 'uncertain' when fixed + merged > 0 then 'repaired' else 'valid' end as status,
  35.0 * (3 * len(inv) + len(unc)) + least(25, 4 * drift) + least(25, depth) + least(25, delta) + least(25, speed)
  + 15 * least(1.0, 0.25 * fixed / n + 0.15 * merged / n + 0.25 * (1 - mr) + 0.15 * least(1, gaps / greatest(1, n)) + 0.1 * greatest(0, 1 - score) + 0.1 * (0.35 * fixed / n + 0.2 * merged / n)) as cost from e9),
cm as (select a.cand, a.video_id, a.track_id, count(o.frame_index) as matched, count_if(o.frame_index is null or a.label <> o.label or greatest(abs(a.x - o.x), abs(a.z - o.z), abs(a.x1 - o.x1), abs(a.y1 - o.y1), abs(a.x2 - o.x2), abs(a.y2 - o.y2), abs(a.ox - o.ox), abs(a.oz - o.oz)) > 1e-9) as modified_frames,
  coalesce(sqrt(avg(pow(a.x - o.x, 2) + pow(a.z - o.z, 2))), 0) as rmse from e3 a left join (select * from e3 where cand = 'original') o on o.video_id = a.video_id and o.track_id = a.track_id and o.frame_index = a.frame_index group by 1, 2, 3),
nm as (select * from (values ('track_split', 1), ('fragment_reassociation', 2), ('gap_interpolation', 3), ('kalman_smoothing', 4), ('robust_polynomial_regression', 5), ('outlier_removal', 6), ('bbox_stabilization', 7), ('depth_reestimation', 8), ('multi_frame_velocity_recomputation', 9), ('in_order', 10), ('cleared', 10)) as v(cand, rank)),
cd as (select b.video_id, b.track_id, nm.rank, case when a.cand = 'cleared' then 'in_order' else a.cand end as candidate, b.n as n_before, a.n as n_after, b.status as status_before, a.status as status_after, b.inv as rejections_before, a.inv as rejections_after, b.cost as cost_before, a.cost as cost_after,
    b.cost - a.cost as improvement, matched, modified_frames, rmse, matched < b.n as removes_rows, list_filter(a.inv, lambda r: not list_contains(b.inv, r)) as new_rejections,
    a.cost + 5.0 * case when a.cand = 'in_order' then 2 when a.cand = 'cleared' then 3 else 1 end as score
  from ev b join ev a using (video_id, track_id) join nm on nm.cand = a.cand join cm on cm.cand = a.cand and cm.video_id = a.video_id and cm.track_id = a.track_id
  where b.cand = 'original' and a.cand <> 'original' and len(b.inv) > 0
    and (a.cand not in ('in_order', 'cleared') or (list_contains(b.inv, 'id_switch') and (a.cand = 'cleared') = list_has_any(b.inv, ['track_drift', 'bbox_jump', 'depth_jump', 'speed_abnormal_change', 'motion_direction_abrupt_change'])))),
ca as (select *, improvement >= 8 and not removes_rows and len(new_rejections) = 0 and case status_after when 'invalid' then 3 when 'uncertain' then 1 else 0 end <= 3 as accepted from cd)"""


@query(f"""
with recursive {TESTED} select video_id, track_id, candidate, status_after, array_to_string(rejections_before, ',') as rejections_before, array_to_string(rejections_after, ',') as rejections_after, round(cost_before, 6) as cost_before, round(cost_after, 6) as cost_after,
  matched, modified_frames, round(rmse, 6) as rmse, removes_rows, accepted, round(score, 6) as score from ca""")
def repair_candidates(t: Inputs):
    out = t.by_length(candidates_of).withColumns({k: F.array_join(k, ",") for k in ("rejections_before", "rejections_after")})
    return rounded(out, "video_id", "track_id", "candidate", "status_after", "rejections_before", "rejections_after", "cost_before", "cost_after", "matched", "modified_frames", "rmse", "removes_rows", "accepted", "score")


CHOSEN = f"""{TESTED},
bs as (select * from (select *, row_number() over (partition by video_id, track_id order by round(score, 9), rank) as r from ca where accepted) where r = 1)"""


@query(f"""
with recursive {CHOSEN}, tr as (select video_id, track_id, any_value(cost_before) as cost_before, count(*) as tried, count_if(accepted) as accepted from ca group by 1, 2)
select tr.video_id, tr.track_id, tried, tr.accepted, candidate, round(tr.cost_before, 6) as cost_before, round(cost_after, 6) as cost_after, modified_frames,
  case when candidate is null then 'Unrepairable' when len(rejections_after) = 0 then 'Repair' else 'Keep_with_uncertainty' end as decision, round(coalesce(least(1.0, greatest(0.0, improvement / greatest(8.0, tr.cost_before))), 0), 6) as confidence
from tr left join bs using (video_id, track_id)""")
def chosen_repairs(t: Inputs):
    out = rs.chosen_repairs(t.by_length(candidates_of))
    return rounded(out, "video_id", "track_id", "tried", "accepted", "candidate", "cost_before", "cost_after", "modified_frames", "decision", "confidence")


@query(f"""
with recursive {CHOSEN}, pk as (select e3.*, bs.candidate, o.frame_index is null as inserted, o.x as original_x, o.z as original_z,
  (o.frame_index is null or e3.label <> o.label or greatest(abs(e3.x - o.x), abs(e3.z - o.z), abs(e3.x1 - o.x1), abs(e3.y1 - o.y1), abs(e3.x2 - o.x2), abs(e3.y2 - o.y2), abs(e3.ox - o.ox), abs(e3.oz - o.oz)) > 1e-9) as modified
  from e3 join bs on bs.video_id = e3.video_id and bs.track_id = e3.track_id and e3.cand = bs.candidate left join (select * from e3 where cand = 'original') o on o.video_id = e3.video_id and o.track_id = e3.track_id and o.frame_index = e3.frame_index)
select video_id, track_id, frame_index, label, case when modified then 'repaired' else source end as source, candidate, modified, inserted, round(x, 6) as x, round(z, 6) as z, round(x1, 6) as x1, round(y2, 6) as y2, round(ox, 6) as obj_vx, round(oz, 6) as obj_vz, original_x, original_z from pk
union all select video_id, track_id, frame_index, label, source, null, false, false, round(x, 6), round(z, 6), round(x1, 6), round(y2, 6), round(ox, 6), round(oz, 6), x, z from e3 where cand = 'original' and (video_id, track_id) not in (select (video_id, track_id) from bs)""")
def repaired_tracks(t: Inputs):
    kept = ["video_id", "track_id", "frame_index", "label", "source", "candidate", "modified", "inserted", "x", "z", "x1", "y2", "obj_vx", "obj_vz"]
    out = t.by_length(repaired_of).select(*kept, "original_x", "original_z")
    return out.withColumns({k: settled(C(k)) for k in kept[8:]})
