"""Rules extended in rounds from kept parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import extension
from trackloom.plans.catalog import query, rounded
from trackloom.plans.rulebook import HEAD
from trackloom.plans.views import Inputs

C = F.col
TERMS = extension.Terms()
KEPT = ["round", "clause", "parent", "category", "positive_support", "negative_support", "confidence", "gain", "score"]


def sourced_facts(t: Inputs):
    """Facts of labelled examples with the sources of the objects that carry them."""
    source = extension.sources_of(C("source"))
    atom = lambda name, value: F.concat(F.lit(f"{name}(S,O,"), value, F.lit(")."))
    templates = F.array(atom("object_class", F.lower("object_class")), atom("object_distance_state", C("distance_state")), atom("object_x_position_state", C("x_state")))
    example = (C("video_id") * 100000 + C("segment_index")).alias("example_id")
    of_objects = t.objects().select(example, F.explode(templates).alias("template"), C("track_id").cast("int").alias("o"), source.alias("sources"))
    of_segments = t.segments().select(
        example, F.concat(F.lit("segment_forward_state(S,"), "forward_label", F.lit(").")).alias("template"), F.lit(None).cast("int").alias("o"), F.lit(0).alias("sources")
    )
    return of_objects.unionByName(of_segments).join(t.examples().select("example_id", "label"), "example_id")


def sourced_scenes(t: Inputs):
    """The examples of ``sourced_facts`` in one row each, spread by the order.

    Objects without number belong to the segment, and videos of 100,000 segments share examples with others; with any of these the
    examples are gathered from the facts.
    """
    return sourced_facts(t) if from_facts(t) else t.scenes(sourced=True)


def from_facts(t: Inputs) -> bool:
    crowded = t.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter(C("n") > 100_000)
    return not (t.table("lineitem").filter("l_linenumber is null").isEmpty() and crowded.isEmpty())


def grown(t: Inputs, stop_after: int | None = None):
    """The rounds over the examples in tokens, or from the facts where ``sourced_scenes`` does so."""
    scenes, names = (sourced_facts(t), None) if from_facts(t) else t.coded_scenes()
    return extension.extension_rounds(scenes, HEAD, TERMS, stop_after=stop_after, names=names)


RANK = "round(score, 9) desc, positive_support desc, negative_support, semantic desc, ratio, clause, parent"
BUDGET = " or ".join(f"(category = '{c}' and place <= {n})" for c, n in TERMS.budgets[0].items())


@query(f"""
with oa as (select video_id * 100000 + segment_index as example_id, track_id as o, source, unnest(['object_class(S,O,' || lower(object_class) || ').', 'object_distance_state(S,O,' || distance_state || ').', 'object_x_position_state(S,O,' || x_state || ').']) as template from v_objects),
fx as (select example_id, template, o, max(case when source = 'A' then 1 else 0 end) as acc, max(case when source = 'R' then 1 else 0 end) as cand from oa group by 1, 2, 3
  union all select video_id * 100000 + segment_index, 'segment_forward_state(S,' || forward_label || ').', null, 0, 0 from v_segments),
ff as (select fx.*, e.label from fx join v_examples e on e.example_id = fx.example_id),
un as (select template, count(distinct case when label then example_id end) as p_ps, count(distinct case when not label then example_id end) as p_ns from ff group by 1),
pe as (select a.example_id, a.label, a.template as t1, b.template as t2, count(*) as n, max(a.cand) as c1, max(b.cand) as c2, max(greatest(a.acc, b.acc)) as acc from ff a join ff b on a.example_id = b.example_id and a.template < b.template and (a.o = b.o or a.o is null or b.o is null) group by 1, 2, 3, 4),
pa as (select t1, t2, count_if(label) as positive_support, count_if(not label) as negative_support, coalesce(sum(n) filter (where label), 0) as pf, coalesce(sum(n) filter (where not label), 0) as nf, max(c1) + max(c2) as nc, max(acc) as acc,
  md5(string_agg(example_id || ':' || n, ',' order by example_id)) as sig, md5(string_agg(cast(example_id as varchar), ',' order by example_id) filter (where label)) as cov from pe group by 1, 2),
pb as (select *, pf / (pf + nf) as confidence, nc / 2.0 as ratio, case when nc > 0 and acc > 0 then 'accepted_candidate' when nc = 0 then 'accepted_only' when nc = 2 then 'candidate_candidate' else 'candidate_only' end as category,
  case when t1 like 'object%' then 1 else 0 end + case when t2 like 'object%' then 1 else 0 end as semantic, '{HEAD}(S) :- ' || rtrim(t1, '.') || ', ' || rtrim(t2, '.') || '.' as clause from pa where pf > 0 and not (t1 like 'segment%' and t2 like 'segment%')),
ch as (select pb.*, template, p_ps, p_ns, p_ps / greatest(1, p_ps + p_ns) as p_conf, '{HEAD}(S) :- ' || rtrim(template, '.') || '.' as parent from pb join un on template in (t1, t2) where p_ps >= {TERMS.least_support}),
g as (select *, confidence - p_conf as dp, p_ns - nf as df, p_ns - negative_support as ds, positive_support - p_ps as rg from ch),
d as (select *, greatest(0, dp) * 100 + greatest(0, df) * 4 + greatest(0, ds) * 3 + case when dp >= 0 then 1 else 0 end as gain,
  confidence * 100 + positive_support * 10 + greatest(0, rg) * 6 - negative_support * 4 - 1 + semantic * 2 - ratio * 3 - case when category = 'candidate_candidate' then 4 else 0 end as score from g
  where category <> 'candidate_candidate' and not (pf = p_ps and nf = p_ns) and not (positive_support < 2 and negative_support = 0) and not (dp < 0 and rg <= 0) and not (ds < 0 and rg <= 0) and (dp >= 0 or df > 0 or ds > 0)),
pp as (select * from d qualify row_number() over (partition by template order by {RANK}) <= {TERMS.per_parent}),
bo as (select * from pp qualify row_number() over (partition by t1, t2 order by {RANK}) = 1),
si as (select * from bo qualify row_number() over (partition by sig order by {RANK}) <= {TERMS.per_signature}),
co as (select * from si qualify row_number() over (partition by cov order by {RANK}) <= {TERMS.per_coverage}),
ca as (select *, row_number() over (partition by category order by {RANK}) as place from co),
ke as (select * from ca where {BUDGET} order by {RANK} limit {TERMS.most[0]})
select 1 as round, clause, parent, category, positive_support, negative_support, round(confidence, 6) as confidence, round(gain, 6) as gain, round(score, 6) as score from ke""")
def first_extension_round(t: Inputs):
    found, _ = grown(t, stop_after=1)
    return rounded(found, *KEPT)


@query()
def extension_rounds(t: Inputs):
    found, _ = grown(t)
    return rounded(found, *KEPT, "is_parent")


@query()
def extension_outcomes(t: Inputs):
    _, history = grown(t)
    return t.spark.createDataFrame(history, "round int, outcome string, n long")
