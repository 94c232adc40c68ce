"""Interval reports, sessions, sources and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.numbers import settled
from trackloom.plans.catalog import query, rounded
from trackloom.plans.views import Inputs
from trackloom.sources import readers, stores
from trackloom.streaming import monitor

C = F.col


def events(t: Inputs):
    return t.table("events").withColumn("ts", C("ts").cast("timestamp"))


@query("""
select epoch_us(time_bucket(interval '6 hours', ts)) as interval_start, count(*) as events, round(avg(case when event_type = 'error' then 1.0 else 0 end), 6) as failure_rate, round(avg(value), 6) as mean_latency from events group by 1""")
def interval_report(t: Inputs):
    out = monitor.interval_report(events(t), "ts", "6 hours", C("event_type") == "error", C("value"), "1 hour")
    return out.select(F.unix_micros("interval_start").alias("interval_start"), "events", settled(C("failure_rate")).alias("failure_rate"), settled(C("mean_latency")).alias("mean_latency"))


@query("""
with s as (select epoch_us(time_bucket(interval '1 hour', ts)) - o.h * 3600000000 as interval_start, event_type from events, (values (0), (1), (2), (3)) o(h))
select interval_start, count(*) as events, round(avg(case when event_type = 'error' then 1.0 else 0 end), 6) as failure_rate from s group by 1 having count(*) >= 4 and avg(case when event_type = 'error' then 1.0 else 0 end) > 0.25""")
def rolling_alerts(t: Inputs):
    out = monitor.rolling_alerts(events(t), "ts", "4 hours", "1 hour", C("event_type") == "error", 0.25, 4, "1 hour")
    return out.select(F.unix_micros("interval_start").alias("interval_start"), "events", settled(C("failure_rate")).alias("failure_rate"))


@query("""
with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 7200000000 then 0 else 1 end as c from events), s as (select *, sum(c) over (partition by user_id order by ts) as k from g)
select user_id, epoch_us(min(ts)) as session_start, epoch_us(max(ts)) + 7200000000 as session_end, count(*) as events, max(value) as peak from s group by user_id, k""")
def quiet_gap_sessions(t: Inputs):
    out = monitor.quiet_gap_sessions(events(t), ["user_id"], "ts", "2 hours", C("value"), "1 hour")
    return out.withColumn("session_start", F.unix_micros("session_start")).withColumn("session_end", F.unix_micros("session_end"))


@query("""
select event_type, count(*) as votes from (select distinct event_type, user_id, cast(ts as date) as d from events) v group by 1""")
def votes_once(t: Inputs):
    dated = events(t).withColumn("d", F.to_date("ts"))
    once = monitor.votes_once(dated, ["event_type", "user_id", "d"], "ts", "1 day")
    return once.groupBy("event_type").agg(F.count("*").alias("votes"))


@query("""
select o_custkey as video_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as position, o_orderkey as token from orders qualify position <= 3""")
def first_samples(t: Inputs):
    samples = t.table("orders").select(
        C("o_custkey").alias("scene_token"), F.unix_micros(C("o_orderdate").cast("timestamp")).alias("timestamp"), C("o_orderkey").alias("token")
    )
    out = readers.ordered_samples(samples, 3)
    return out.select(C("scene_token").alias("video_id"), "position", "token")


@query("""
with m as (select c_custkey + 40 as video_id, row_number() over (order by c_custkey) - 1 as position from customer where c_mktsegment = 'BUILDING'), v as (select distinct o_custkey as video_id from orders)
select m.video_id, position, v.video_id is null as missing from m left join v on v.video_id = m.video_id""")
def manifest_videos(t: Inputs):
    from trackloom.operators.splits import Ordered
    from trackloom.operators.ordered import row_number

    listed = t.table("customer").filter("c_mktsegment = 'BUILDING'").select((C("c_custkey") + 40).alias("video_id"))
    manifest = Ordered([], ["video_id"], F.floor(C("video_id") / 1024)).scan(listed, n=row_number()).select("video_id", (C("n") - 1).alias("position"))
    videos = t.table("orders").select(C("o_custkey").alias("video_id")).distinct()
    present, missing = readers.in_manifest_order(videos, manifest)
    return present.select("video_id", "position", F.lit(False).alias("missing")).unionByName(missing.select("video_id", "position", F.lit(True).alias("missing")))


@query("""
select distinct o_custkey as video_id from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')""")
def pending_videos(t: Inputs):
    orders = t.table("orders")
    config, version = {"threshold": 2, "window": 5}, 3
    key, other = (F.sha2(F.lit(stores.config_key(config, v)), 256) for v in (version, version - 1))
    stored = orders.select(C("o_custkey").alias("video_id"), F.when(C("o_orderstatus") == "F", key).otherwise(other).alias("config_hash"))
    videos = orders.select(C("o_custkey").alias("video_id")).distinct()
    return stores.pending(videos, stored, config, version)


@query("""
with f as (select l_orderkey, count(*) as n, max(1 - 5 * l_tax) as best from lineitem group by 1) select l_orderkey as video_id, n as objects, round(best, 6) as best from f""")
def flattened_frames(t: Inputs):
    item = t.table("lineitem")
    box = F.array("l_quantity", "l_discount", "l_quantity", "l_tax")
    # the line items of one order are the objects of one frame
    frames = item.groupBy(C("l_orderkey").alias("video_id")).agg(
        F.lit(0).alias("frame_index"),
        F.collect_list(F.struct(box.alias("b"), (1 - 5 * C("l_tax")).alias("s"), C("l_returnflag").alias("l"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount").alias("t"))).alias("o"),
    )
    nested = frames.select("video_id", "frame_index", C("o.b").alias("boxes"), C("o.s").alias("scores"), C("o.l").alias("labels"), C("o.t").alias("track_ids"), C("o.b").alias("positions_3d"))
    flat = readers.flatten_frames(nested)
    return rounded(flat.groupBy("video_id").agg(F.count("*").alias("objects"), F.max("score").alias("best")), "video_id", "objects", "best")


@query("""
select 'orders' as collection, count(*) as n, count(*) = 0 as missing from orders union all select 'events', count(*), count(*) = 0 from events union all select 'clicks_below_zero', count(*) filter (where event_type = 'click' and value < 0), count(*) filter (where event_type = 'click' and value < 0) = 0 from events""")
def required_collections(t: Inputs):
    from trackloom.operators.quality_checks import require_rows

    tables = {"orders": t.table("orders"), "events": t.table("events"), "clicks_below_zero": t.table("events").filter("event_type = 'click' and value < 0")}
    return require_rows(tables, t.spark)


@query("""
with a as (select distinct 'orders' as stage, o_custkey as id from orders union all select distinct 'customers', c_custkey from customer union all select distinct 'events', user_id from events)
select id, string_agg(stage, ',' order by stage) as stages from a group by 1""")
def traceability(t: Inputs):
    stage = lambda name, table, column: t.table(table).select(F.lit(name).alias("stage"), C(column).alias("id")).distinct()
    every = stage("orders", "orders", "o_custkey").unionByName(stage("customers", "customer", "c_custkey")).unionByName(stage("events", "events", "user_id"))
    # one row per stage and id: at most as many rows per id as there are stages
    return every.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("stage")), ",").alias("stages"))


@query("""
with v as (select event_id, event_type, value, row_number() over (partition by event_type order by sha256('5:' || event_id), event_id) as k from events) select event_type, event_id, cast(k as int) as place from v where k <= 5""")
def review_samples(t: Inputs):
    from trackloom.operators.selection import best_in_group

    order = [F.sha2(F.concat(F.lit("5:"), C("event_id").cast("string")), 256), C("event_id")]
    out = best_in_group(t.table("events"), ["event_type"], order, 5)
    return out.select("event_type", "event_id", C("rank_in_group").alias("place"))


@query("""
with e as (select l_returnflag || '>' || l_linestatus as variable, l_tax as p from lineitem)
select variable, split_part(variable, '>', 1) as object, count(*) as edges, round(avg(least(1.0, 1 - p + case when p < 0.01 then 0.2 when p < 0.05 then 0.1 else 0 end)), 6) as confidence, count_if(p < 0.05) as rules from e group by 1, 2""")
def causal_edge_facts(t: Inputs):
    from trackloom.operators.reports import causal_facts

    edges = t.table("lineitem").select(F.concat_ws(">", "l_returnflag", "l_linestatus").alias("variable"), C("l_tax").alias("p_value"))
    out = causal_facts(edges).groupBy("variable", "object").agg(
        F.count("*").alias("edges"), F.avg("confidence").alias("confidence"), F.count_if(C("rule_confidence").isNotNull()).alias("rules")
    )
    return rounded(out, "variable", "object", "edges", "confidence", "rules")
