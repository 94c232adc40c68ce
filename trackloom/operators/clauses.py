"""Clauses body -> head learned from transitions; predicates are named column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-6


def observe_clauses(transitions: DataFrame, bodies: dict[str, Column], heads: dict[str, Column]) -> DataFrame:
    """Truth table of every body and head pair.

    The table of one pair follows from four counts, so each row is read once and nothing is multiplied by the pairs.
    """
    both = {(b, h): F.count_if(bc & hc) for b, bc in bodies.items() for h, hc in heads.items()}
    single = {("body", b): F.count_if(c) for b, c in bodies.items()} | {("head", h): F.count_if(c) for h, c in heads.items()}
    counted = transitions.agg(
        F.count("*").alias("n"),
        *[c.alias(f"{k[0]}:{k[1]}") for k, c in {**both, **single}.items()],
    )
    n = lambda name: F.col(f"`{name}`")
    rows = []
    for b, h in both:
        tp, fired, true = n(f"{b}:{h}"), n(f"body:{b}"), n(f"head:{h}")
        rows.append(
            F.struct(
                F.lit(h).alias("head"),
                F.lit(b).alias("body"),
                tp.alias("tp"),
                (fired - tp).alias("fp"),
                (true - tp).alias("fn"),
                (F.col("n") - fired - true + tp).alias("tn"),
            )
        )
    table = counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return with_scores(table)


def with_scores(table: DataFrame) -> DataFrame:
    c = F.col
    fired = c("tp") + c("fp")
    return (
        table.withColumn("confidence", c("tp") / (fired + TINY))
        .withColumn("coverage", fired / (fired + c("fn") + c("tn") + TINY))
        .withColumn("violation_rate", c("fp") / F.greatest(F.lit(1), fired))
    )


def accepted(table: DataFrame, confidence: float, coverage: float) -> DataFrame:
    return table.filter((F.col("confidence") >= confidence) & (F.col("coverage") >= coverage))
