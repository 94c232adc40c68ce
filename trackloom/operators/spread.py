"""Partitioning for grouped Python work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash the groups over the configured number of shuffle partitions.

    Adaptive execution merges partitions by their bytes, which are few before Python work that is heavy per row; a
    stated number is kept, and the grouping that follows needs no shuffle of its own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
