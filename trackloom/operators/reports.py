"""Small report tables: causal facts, metric comparisons, verdicts and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.ordered import by_step, previous


def causal_facts(edges: DataFrame) -> DataFrame:
    """Object, property and confidence of causal edges (variable, p_value); a rule needs p below 0.05."""
    p = F.col("p_value")
    bonus = F.when(p < 0.01, 0.2).when(p < 0.05, 0.1).otherwise(0.0)
    confidence = F.least(F.lit(1.0), 1 - p + bonus)
    return edges.select(
        "*",
        F.regexp_extract("variable", r"^([^>]*)>", 1).alias("object"),
        F.regexp_extract("variable", r">(.*)$", 1).alias("property"),
        confidence.alias("confidence"),
        F.when(p < 0.05, confidence * 0.9).alias("rule_confidence"),
    )


def compare_metrics(before: DataFrame, after: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Old and new value and difference of each metric, side by side."""
    a = before.select(*keys, *[F.col(n).alias(f"{n}_before") for n in names])
    b = after.select(*keys, *[F.col(n).alias(f"{n}_after") for n in names])
    joined = a.join(b, list(keys), "full_outer")
    return joined.select("*", *[(F.col(f"{n}_after") - F.col(f"{n}_before")).alias(f"{n}_delta") for n in names])


def impact(delta_f1: Column, delta_precision: Column, delta_recall: Column) -> Column:
    return (
        F.when((delta_f1 > 0) & (delta_precision >= 0), "improves")
        .when((delta_f1 > 0) & (delta_precision < 0), "recall_for_precision")
        .when((delta_f1 == 0) & (delta_recall == 0), "no_effect")
        .otherwise("harms")
    )


def gate(protected: Column, f1_before: Column, f1_after: Column, tolerance: float) -> Column:
    return F.when(protected, "keep_baseline").when(f1_after + tolerance < f1_before, "reject").otherwise("accept")


def loop_decisions(iterations: DataFrame, key: str, tolerance: float, most: int) -> DataFrame:
    """Continue while F1 grows by more than the tolerance and iterations remain; every iteration is judged."""
    seen = by_step([key], "iteration", 4096).scan(iterations, before=previous(F.col("f1")))
    gain = F.col("f1") - F.col("before")
    decision = F.when(F.col("iteration") >= most, "stop_limit").when(gain <= tolerance, "stop_no_gain").otherwise("continue")
    return seen.withColumn("decision", decision).drop("before")


def bottleneck(best_single: Column, oracle: Column, actual: Column, gap: float = 0.05, low: float = 0.5) -> Column:
    """Where the loss is: in the pool, in the selection, or nowhere."""
    return (
        F.when(oracle < low, "rule_pool_too_weak")
        .when(oracle - actual > gap, "selection_gap")
        .when(oracle - best_single <= gap, "single_rule_suffices")
        .otherwise("near_upper_bound")
    )
