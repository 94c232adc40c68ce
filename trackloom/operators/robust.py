"""Robust location and scale per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.quantiles import quantiles

# Fixed values
MAD_TO_SIGMA = 1.4826
IQR_TO_SIGMA = 1.349


def robust_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Moments, quartiles, deviation from the median, and the first positive scale of a fixed chain."""
    keys = list(keys)
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    center = quantiles(df, keys, value, med=0.5, q25=0.25, q75=0.75)
    off = df.join(center.select(*keys, "med"), keys).withColumn("off", F.abs(F.col(value) - F.col("med")))
    mad = quantiles(off, keys, "off", mad=0.5)
    c = F.col
    chain = [
        (MAD_TO_SIGMA * c("mad"), "scaled_mad"),
        ((c("q75") - c("q25")) / IQR_TO_SIGMA, "iqr_scale"),
        (F.greatest(F.abs("med"), c("std")), "median_or_std_scale"),
    ]
    scale, method = F.lit(1.0), F.lit("degenerate_unit_scale")
    for size, name in reversed(chain):
        scale = F.when(size > 0, size).otherwise(scale)
        method = F.when(size > 0, name).otherwise(method)
    return (
        moments.join(center, keys).join(mad, keys).withColumn("scale", scale).withColumn("scale_method", method)
    )
