"""Stored forms: label files, and the keyed tables of a sensor data set with their star joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators.lineage import new_path
from trackloom.plans.catalog import query
from trackloom.plans.views import Inputs
from trackloom.sources import readers

C = F.col
CHANNELS = ["FRONT", "FRONT_LEFT", "FRONT_RIGHT"]


@query("""
select cast(l_suppkey as varchar) as video_id, cast(l_orderkey as int) as frame_index, l_quantity as x1, cast(l_linenumber as double) as y1, l_quantity + 20 as x2, cast(l_linenumber + 9 as double) as y2, case l_returnflag when 'R' then 'car' when 'A' then 'bus' else 'person' end as label, l_partkey as track_id
from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'P')""")
def stored_labels(t: Inputs):
    """Labels are written as text files and read back; rows of frames that do not exist are left out."""
    name = F.when(C("l_returnflag") == "R", " Car").when(C("l_returnflag") == "A", "BUS").otherwise("person ")
    rows = t.table("lineitem").select(
        C("l_suppkey").alias("videoName"), C("l_orderkey").alias("frameIndex"), C("l_quantity").alias("x1"), C("l_linenumber").cast("double").alias("y1"),
        (C("l_quantity") + 20).alias("x2"), (C("l_linenumber") + 9).cast("double").alias("y2"), name.alias("category"), C("l_partkey").alias("id"),
    )
    path = new_path(t.spark, "labels")
    rows.write.option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path, header=True)
    frames = t.table("orders").filter("o_orderstatus <> 'P'").join(
        t.table("lineitem").select("l_orderkey", "l_suppkey").distinct(), C("o_orderkey") == C("l_orderkey")
    ).select(C("l_suppkey").cast("string").alias("video_id"), C("l_orderkey").cast("int").alias("frame_index"))
    return readers.read_labels(t.spark, path, frames)


def keyed_tables(t: Inputs):
    """The given tables as the keyed tables of a sensor data set; instances are parts, samples orders, sensors suppliers' nations."""
    item, part = t.table("lineitem"), t.table("part")
    token = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C("l_quantity").cast("int"))
    of_status = F.when(C("l_linestatus") == "F", F.array(F.lit("a0"), F.concat(F.lit("a"), C("l_linenumber").cast("string")))).otherwise(F.array(F.lit("a9")))
    numbers = t.spark.range(0, 10).select(F.concat(F.lit("a"), C("id").cast("string")).alias("token"), F.concat(F.lit("attribute "), C("id").cast("string")).alias("name"))
    levels = item.select(C("l_returnflag").alias("token")).distinct().filter("token <> 'N'").withColumn("level", F.concat(F.lit("v"), C("token")))
    annotations = item.select(token.alias("token"), C("l_partkey").alias("instance_token"), C("l_returnflag").alias("visibility_token"), F.array_distinct(of_status).alias("attribute_tokens"))
    supplier = t.table("supplier")
    sensors = t.table("nation").select(C("n_nationkey").alias("token"), F.element_at(F.array(*map(F.lit, [*CHANNELS, "BACK"])), (C("n_nationkey") % 4 + 1).cast("int")).alias("channel"))
    return {
        "sample_annotation": annotations, "attribute": numbers, "visibility": levels,
        "instance": part.select(C("p_partkey").alias("token"), C("p_type").alias("category_token")),
        "category": part.select(C("p_type").alias("token"), F.lower("p_type").alias("name")).distinct(),
        "sample_data": item.select(token.alias("token"), C("l_orderkey").alias("sample_token"), C("l_suppkey").alias("calibrated_sensor_token"), C("l_partkey").alias("ego_pose_token")),
        "calibrated_sensor": supplier.select(C("s_suppkey").alias("token"), C("s_nationkey").alias("sensor_token")), "sensor": sensors,
        "ego_pose": part.select(C("p_partkey").alias("token"), F.array(C("p_size").cast("double"), F.lit(0.0), F.lit(1.0)).alias("translation"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("rotation")),
    }


ANNOTATED = """a as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_quantity as int) as token, l_orderkey as sample, lower(p_type) as category, case when l_returnflag = 'N' then null else 'v' || l_returnflag end as visibility,
  case when l_linestatus = 'F' then 'attribute 0,attribute ' || l_linenumber else 'attribute 9' end as attributes from lineitem join part on p_partkey = l_partkey)"""
MEDIA = """m as (select l_orderkey as sample_token, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_quantity as int) as token, case n_nationkey % 4 when 0 then 'FRONT' when 1 then 'FRONT_LEFT' when 2 then 'FRONT_RIGHT' else 'BACK' end as channel, case when n_nationkey % 4 = 3 then 3 else n_nationkey % 4 end as k, cast(p_size as double) as forward
  from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join part on p_partkey = l_partkey),
me as (select * from (select *, row_number() over (partition by sample_token order by k, token) as z from m) q where z = 1)"""


@query(f"""
with {ANNOTATED} select token, category, visibility, attributes from a""")
def annotation_star(t: Inputs):
    out = readers.annotation_records(keyed_tables(t))
    return out.select("token", "category", "visibility", F.array_join("attributes", ",").alias("attributes"))


@query(f"""
with {MEDIA} select sample_token, token, channel, forward from me""")
def media_star(t: Inputs):
    out = readers.media_records(keyed_tables(t), CHANNELS)
    return out.select("sample_token", "token", "channel", F.element_at("translation", 1).alias("forward"))


@query(f"""
with {ANNOTATED}, {MEDIA}, n as (select sample, count(*) as annotations, string_agg(category, ',' order by token) as categories from a group by 1)
select me.sample_token, me.channel, me.forward, coalesce(annotations, 0) as annotations, coalesce(categories, '') as categories from me left join n on n.sample = me.sample_token""")
def sample_records(t: Inputs):
    """One nested record per sample: the chosen camera with its pose, and the annotations; written flat for the check."""
    tables = keyed_tables(t)
    sample = F.split("token", "-")[0].cast("long")
    # a sample has the few annotations of one frame
    notes = readers.annotation_records(tables).groupBy(sample.alias("sample_token")).agg(
        F.array_sort(F.collect_list(F.struct("token", "category", "visibility", "attributes"))).alias("annotations")
    )
    media = readers.media_records(tables, CHANNELS).select("sample_token", F.struct("channel", "translation", "rotation").alias("camera"))
    record = media.join(notes, "sample_token", "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(notes.schema["annotations"].dataType)))
    return record.select(
        "sample_token", C("camera.channel").alias("channel"), F.element_at("camera.translation", 1).alias("forward"), F.size("annotations").alias("annotations"),
        F.array_join("annotations.category", ",").alias("categories"),
    )
