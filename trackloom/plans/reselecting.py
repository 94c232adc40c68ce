"""Specialisations of selected rules, and reselection as rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import rounds
from trackloom.plans import rulebook
from trackloom.plans.catalog import query, rounded
from trackloom.plans.rulebook import RULESET, SELECTED
from trackloom.plans.views import Inputs

C = F.col
PARTS = ["precision_gain", "fp_reduction", "retention", "grounding_bonus", "rank_bonus", "length_penalty", "score"]


def pool(t: Inputs):
    return rulebook.rule_set(t).select(C("rule_id").cast("long").alias("rule_id"), "body", "positive_support", "negative_support")


@query(f"""
with {RULESET}, px as (select *, positive_support / greatest(1, positive_support + negative_support) as precision from rs), sz as (select count(*) as size from rs),
ds as (select p.rule_id as parent_id, c.rule_id, c.precision - p.precision as precision_gain, p.negative_support - c.negative_support as fp_reduction,
    least(1.0, c.positive_support / greatest(1, p.positive_support)) as retention, case when c.t1 like '%(S,O,%' or c.t2 like '%(S,O,%' then 0.25 else 0.0 end as grounding_bonus, (size - c.rule_id + 1) / size as rank_bonus
    from px p join px c on p.t2 is null and c.t2 is not null and p.t1 in (c.t1, c.t2), sz where c.positive_support > 0)
select parent_id, rule_id, round(precision_gain, 6) as precision_gain, fp_reduction, round(retention, 6) as retention, round(grounding_bonus, 6) as grounding_bonus, round(rank_bonus, 6) as rank_bonus, round(0.05, 6) as length_penalty,
    round(2.0 * precision_gain + fp_reduction + 0.75 * retention + grounding_bonus + 0.25 * rank_bonus - 0.05, 6) as score from ds""")
def rule_descendants(t: Inputs):
    return rounded(rounds.descendants(pool(t), pool(t)), "parent_id", "rule_id", *PARTS)


def broadest(t: Inputs) -> list[int]:
    """The rules with most positive support, where removal and specialisation have something to do."""
    first = pool(t).orderBy(F.desc("positive_support"), "rule_id").limit(SELECTED)
    return sorted(r["rule_id"] for r in first.collect())


def rounds_of(t: Inputs):
    rows = rulebook.alike_firings(t).crossJoin(F.broadcast(rulebook.confidences(t)))
    one = lambda r: F.struct(rulebook.confidence_of(r).alias("confidence"), r.cast("long").alias("rule_id"))
    fired = rows.select("label", F.transform("fired", one).alias("fired"), "n")
    return rounds.reselection_rounds(pool(t), fired, rulebook.positives(t), broadest(t), rounds.Terms(k=SELECTED, mode="aggressive"))


@query()
def reselection_rounds(t: Inputs):
    history, _ = rounds_of(t)
    kinds = "round int, status string, tp long, fp long, fn long, precision double, recall double, f1 double, removed int, swapped int, added int"
    return rounded(t.spark.createDataFrame(history, kinds), *[k.split()[0] for k in kinds.split(", ")])
