"""Causal class of rules from their masking summary, removal, refill and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.masking import INFLUENCES
from trackloom.operators.selection import best_overall


def causal_class(weak: Column) -> Column:
    """Class of a rule with columns triggers, flips, helpful, harmful, necessary_tp, causal_fp, dominant."""
    c = F.col
    return (
        F.when(c("triggers").isNull(), "causal_effect_missing")
        .when((c("helpful") == 0) & (c("harmful") > 0), "harmful_false_positive_rule")
        .when((c("helpful") > 0) & (c("harmful") > 0), "mixed_rule")
        .when((c("necessary_tp") > 0) & (c("causal_fp") > 0), "mixed_rule")
        .when((c("necessary_tp") > 0) & (c("harmful") == 0), "necessary_positive_rule")
        .when(weak, "weak_causal_grounding_rule")
        .when((c("flips") == 0) | (c("dominant") == INFLUENCES[3]), "redundant_rule")
        .when(c("helpful") > 0, "necessary_positive_rule")
        .otherwise("mixed_rule")
    )


def reselection_score(original: Column, object_support: Column, weak: Column) -> Column:
    c = F.col
    return (
        original
        + 1.0 * c("helpful")
        + 3.0 * c("necessary_tp")
        - 3.0 * c("harmful")
        - 2.0 * c("causal_fp")
        + F.when(object_support, 0.5).otherwise(0.0)
        - F.when(weak, 1.5).otherwise(0.0)
    )


def removal_reason(mode: str) -> Column:
    """Why a rule goes under a removal mode (strict, moderate, aggressive), empty when it stays."""
    c = F.col
    no_need = c("necessary_tp") == 0
    reason = F.when((c("helpful") == 0) & (c("harmful") > 0) & no_need, "pure_harmful")
    if mode in ("moderate", "aggressive"):
        dominant = (c("harmful") > 0) & (c("harmful") >= 2 * F.greatest(F.lit(1), c("helpful"))) & no_need
        reason = reason.when(dominant, "harmful_dominant")
    if mode == "aggressive":
        reason = reason.when((c("net") < 0) & no_need, "net_harmful")
    return reason.otherwise("")


def refill(selected: DataFrame, ranked: DataFrame, removed: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Selected rules without the removed ones, refilled from the ranked pool up to k."""
    kept = selected.join(removed.select("rule_id"), "rule_id", "left_anti")
    fresh = (
        ranked.join(selected.select("rule_id"), "rule_id", "left_anti")
        .join(removed.select("rule_id"), "rule_id", "left_anti")
        .filter("positive_support > 0")
    )
    missing = best_overall(fresh, order, k, "pool_rank")
    free = kept.agg((F.lit(k) - F.count("*")).alias("free"))
    # one row with the number of free places
    added = missing.withColumn("one", F.lit(1)).join(F.broadcast(free.withColumn("one", F.lit(1))), "one").filter("pool_rank <= free")
    return kept.select("rule_id").withColumn("origin", F.lit("kept")).unionByName(
        added.select("rule_id").withColumn("origin", F.lit("refill"))
    )


def accept_round(before: dict, after: dict, f1_tolerance: float, recall_tolerance: float, tp_tolerance: int) -> bool:
    return (
        after["f1"] >= before["f1"] - f1_tolerance
        and after["recall"] >= before["recall"] - recall_tolerance
        and after["tp"] >= before["tp"] - tp_tolerance
    )
