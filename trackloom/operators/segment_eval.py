"""Segmentations scored against human annotation."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.spread import spread

# Fixed values
CLASSES = ["forward", "backward", "left", "right", "static"]


def class_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class from (truth, prediction, n); a null prediction is a missed frame."""
    c = F.col
    roles = F.explode(F.array(*[F.lit(k) for k in CLASSES]))
    agg = (
        counts.withColumn("cls", roles)
        .groupBy("cls")
        .agg(
            F.coalesce(F.sum(F.when((c("truth") == c("cls")) & (c("prediction") == c("cls")), c("n"))), F.lit(0)).alias("tp"),
            F.coalesce(F.sum(F.when((c("truth") != c("cls")) & (c("prediction") == c("cls")), c("n"))), F.lit(0)).alias("fp"),
            F.coalesce(F.sum(F.when(c("truth") == c("cls"), c("n"))), F.lit(0)).alias("support"),
        )
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return (
        agg.withColumn("precision", ratio(c("tp"), c("tp") + c("fp")))
        .withColumn("recall", ratio(c("tp"), c("support")))
        .withColumn("f1", ratio(2.0 * c("tp"), c("tp") + c("fp") + c("support")))
    )


def match_boundaries(truth: DataFrame, predicted: DataFrame, keys: Sequence[str], tolerance: int, block: int = 4096) -> DataFrame:
    """One-to-one matches of ordered boundaries within a tolerance, counted per video.

    Boundaries further apart than the tolerance never interact, so each chain of close boundaries is independent;
    within it the earliest unmatched partner in reach is the best choice.  Whole chains are packed by position, so
    a long video is many groups.
    """
    from trackloom.operators.ordered import by_step, carried, previous

    keys = list(keys)
    side = lambda df, s: df.select(*keys, F.col("frame").cast("bigint").alias("frame"), F.lit(s).alias("side"))
    both = side(truth, 0).unionByName(side(predicted, 1))
    scan = by_step(keys, "frame", block, "side")
    chained = scan.scan(both, before=previous(F.col("frame")))
    far = F.coalesce(F.col("frame") - F.col("before") > tolerance, F.lit(True))
    heads = chained.withColumn("head", F.when(far, F.col("frame"))).drop("before")
    packed = scan.scan(heads, chain=carried(F.col("head"))).withColumn("pack", F.floor(F.col("chain") / block))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "side"])
        t = pdf.loc[pdf["side"] == 0, "frame"].tolist()
        p = pdf.loc[pdf["side"] == 1, "frame"].tolist()
        i = j = hits = 0
        while i < len(t) and j < len(p):
            if abs(t[i] - p[j]) <= tolerance:
                hits, i, j = hits + 1, i + 1, j + 1
            elif t[i] < p[j]:
                i += 1
            else:
                j += 1
        row = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**row, "truth": [len(t)], "predicted": [len(p)], "matched": [hits]})

    types = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "truth bigint", "predicted bigint", "matched bigint"])
    found = spread(packed.select(*keys, "pack", "frame", "side"), *keys, "pack").groupBy(*keys, "pack").applyInPandas(work, schema)
    return found.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("truth", "predicted", "matched")])


def boundary_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; with nothing expected and nothing predicted all three are one."""
    c = F.col
    empty = (c("truth") == 0) & (c("predicted") == 0)
    ratio = lambda a, b: F.when(empty, 1.0).when(b > 0, a / b).otherwise(0.0)
    return (
        counts.withColumn("precision", ratio(c("matched"), c("predicted")))
        .withColumn("recall", ratio(c("matched"), c("truth")))
        .withColumn("f1", ratio(2.0 * c("matched"), c("truth") + c("predicted")))
    )
