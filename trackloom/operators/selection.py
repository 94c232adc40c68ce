"""Top-k, budgets and cluster limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def best_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most k rows per group; Spark limits each group before the shuffle, so a hot group stays small."""
    ranked = df.withColumn("rank_in_group", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank_in_group") <= k)


def best_overall(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows with their rank; only k rows meet in one task."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn(rank, F.row_number().over(W.orderBy(*order)))


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """All rows with their place.  For rule pools: their size is bounded by the vocabulary of templates, not by the examples."""
    return df.withColumn(rank, F.row_number().over(W.orderBy(*order)))


def budgeted(df: DataFrame, category: str, budgets: dict[str, int], order: Sequence[Column], k: int) -> DataFrame:
    """Top k under a budget per category (a category without budget is free).

    Taking the best of each category first and the best overall second equals the greedy scan.
    """
    free = df.filter(~F.col(category).isin(list(budgets)))
    kept = free
    for name, budget in budgets.items():
        kept = kept.unionByName(df.filter(F.col(category) == name).orderBy(*order).limit(budget))
    return best_overall(kept, order, k)


def limit_per_signature(df: DataFrame, signature: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    return best_in_group(df, signature, order, most).drop("rank_in_group")


def round_robin(df: DataFrame, cluster: str, order: Sequence[Column], per_cluster: int, k: int) -> DataFrame:
    """Best of every cluster first, then every second best, and so on."""
    ranked = best_in_group(df, [cluster], order, per_cluster)
    return best_overall(ranked, [F.col("rank_in_group"), *order], k)
