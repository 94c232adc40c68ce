"""Checks of annotation tables, one row per problem kind and video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.ordered import by_step, previous


def segment_problems(segments: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Inverted segments, gaps and overlaps with the segment before, unknown labels, with how often each occurs."""
    seen = by_step(keys, "start_frame", 8192, "end_frame").scan(segments, before=previous(F.col("end_frame")))
    c = F.col
    found = F.array_compact(
        F.array(
            F.when(c("end_frame") < c("start_frame"), "inverted"),
            F.when(c("start_frame") > c("before") + 1, "gap"),
            F.when(c("start_frame") <= c("before"), "overlap"),
            F.when(~c("label").isin(list(labels)), "unknown_label"),
        )
    )
    return seen.select(*keys, F.explode(found).alias("problem")).groupBy(*keys, "problem").agg(F.count("*").alias("n"))


def require_rows(counts: dict[str, DataFrame], spark) -> DataFrame:
    """One row per collection with its row count and whether it is empty."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n") for name, df in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("missing", F.col("n") == 0)
