"""Exact linear-interpolated quantiles and weighted medians for groups of any size.

Values are counted per (group, value) first, so ties collapse before the shuffle, and ranks come from a
chunked running count; no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.numbers import settled
from trackloom.operators.ordered import Ordered, running_sum, total, value_bucket


def _ranked(df: DataFrame, keys: Sequence[str], value: str, weight) -> DataFrame:
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(weight.alias("__n"))
    )
    by_value = Ordered(keys, ["__v"], value_bucket(F.col("__v")))
    return by_value.scan(counts, __cum=running_sum(F.col("__n")), __total=total(F.col("__n")))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, **probs: float) -> DataFrame:
    """One row per group with a column per named probability."""
    ranked = _ranked(df, keys, value, F.count(F.lit(1)))
    aggs = []
    for name, p in probs.items():
        rank = (F.col("__total") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("__cum") > F.floor(rank), F.col("__v")))
        high = F.min(F.when(F.col("__cum") > F.ceil(rank), F.col("__v")))
        share = F.max(rank - F.floor(rank))
        aggs.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def median_of(values: Column) -> Column:
    """The same quantile of 0.5 of a sorted array of doubles, for groups that fit in a row."""
    rank = (F.size(values) - 1) / 2
    low, high = F.get(values, F.floor(rank).cast("int")), F.get(values, F.ceil(rank).cast("int"))
    return low + (high - low) * (rank - F.floor(rank))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str, digits: int | None = None) -> DataFrame:
    """First value whose cumulative weight reaches half of the total; weights must be positive.

    With ``digits`` the weights are compared to so many decimals, so that an exact half doesn't hang on the order of a sum.
    """
    ranked = _ranked(df.filter(F.col(weight) > 0), keys, value, F.sum(weight))
    over = F.col("__cum") * 2 - F.col("__total")
    reached = F.col("__cum") * 2 >= F.col("__total") if digits is None else settled(over, digits) >= 0
    return ranked.groupBy(*keys).agg(F.min(F.when(reached, F.col("__v"))).alias(name))
