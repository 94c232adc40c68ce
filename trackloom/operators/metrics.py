"""Scores of binary predictions and of ranked scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.ordered import Ordered, row_number, running_sum, total, upcoming, value_bucket


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column, label: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(predicted & label).alias("tp"),
        F.count_if(predicted & ~label).alias("fp"),
        F.count_if(~predicted & label).alias("fn"),
        F.count_if(~predicted & ~label).alias("tn"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy; empty denominators give zero."""
    c, one = F.col, F.lit(1)
    return (
        counts.withColumn("precision", c("tp") / F.greatest(one, c("tp") + c("fp")))
        .withColumn("recall", c("tp") / F.greatest(one, c("tp") + c("fn")))
        .withColumn("f1", 2.0 * c("tp") / F.greatest(one, 2 * c("tp") + c("fp") + c("fn")))
        .withColumn("accuracy", (c("tp") + c("tn")) / F.greatest(one, c("tp") + c("fp") + c("fn") + c("tn")))
    )


def binary_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return with_rates(confusion(df, keys, F.col("predicted"), F.col("label")))


def score_counts(df: DataFrame, keys: Sequence[str], weight: Column | int = 1) -> DataFrame:
    """Positives and rows per distinct score with running counts from the highest score down; a row counts ``weight`` times."""
    times = F.lit(weight) if isinstance(weight, int) else weight
    per_score = df.groupBy(*keys, "score").agg(F.sum(F.col("label") * times).alias("pos"), F.sum(times).alias("n"))
    down = per_score.withColumn("down", -F.col("score"))
    order = Ordered(keys, ["down"], value_bucket(F.col("down")))
    return order.scan(
        down,
        tp=running_sum(F.col("pos")),
        rows=running_sum(F.col("n")),
        positives=total(F.col("pos")),
        total_rows=total(F.col("n")),
    )


def roc_auc(df: DataFrame, keys: Sequence[str], weight: Column | int = 1) -> DataFrame:
    """Area under the ROC curve by average ranks; equal scores share their mean rank."""
    s = score_counts(df, keys, weight)
    c = F.col
    # rank from the lowest score: rows at or below, minus half of the tied ones
    mean_rank = c("total_rows") - c("rows") + (c("n") + 1) / 2.0
    agg = s.groupBy(*keys).agg(
        F.sum(c("pos") * mean_rank).alias("rank_sum"), F.max("positives").alias("p"), F.max("total_rows").alias("n")
    )
    negatives = c("n") - c("p")
    area = (c("rank_sum") - c("p") * (c("p") + 1) / 2.0) / (c("p") * negatives)
    return agg.withColumn("auc", F.when((c("p") > 0) & (negatives > 0), area))


def average_precision(df: DataFrame, keys: Sequence[str], span: int = 65536) -> DataFrame:
    """Mean precision at each positive, rows ordered by (score descending, example id).

    The running counts before a score come from the distinct scores; within one score, however many rows share
    it, rows are numbered in chunks of the example id.
    """
    keys = list(keys)
    c = F.col
    before = score_counts(df, keys).select(
        *keys, "score", (c("tp") - c("pos")).alias("tp0"), (c("rows") - c("n")).alias("rows0"), "positives"
    )
    within = Ordered([*keys, "score"], ["example_id"], F.floor(c("example_id") / span))
    placed = within.scan(df.select(*keys, "score", "example_id", "label"), tp1=running_sum(c("label")), at=row_number())
    joined = placed.filter("label = 1").join(before, [*keys, "score"])
    precision = (c("tp0") + c("tp1")) / (c("rows0") + c("at"))
    return joined.groupBy(*keys).agg((F.sum(precision) / F.max("positives")).alias("average_precision"))


def threshold_table(df: DataFrame, keys: Sequence[str], extra: Sequence[float] = (0.0, 0.5, 1.0), beside: float = 1e-8) -> DataFrame:
    """Confusion at every distinct score taken as threshold, just above and just below it, and at a few fixed ones.

    A threshold has the counts of the smallest score that reaches it, so thresholds and scores are put in one order and each
    threshold takes what comes next; no row is compared with a threshold.
    """
    keys = list(keys)
    c = F.col
    s = score_counts(df, keys)
    near = F.array(c("score"), F.least(F.lit(1.0), c("score") + beside), F.greatest(F.lit(0.0), c("score") - beside), *[F.lit(float(v)) for v in extra])
    wanted = s.select(*keys, F.explode(near).alias("value")).distinct().withColumn("at", F.lit(0)).withColumn("found", F.lit(None).cast("struct<tp:bigint,rows:bigint>"))
    counts = F.struct(c("tp").cast("bigint").alias("tp"), c("rows").cast("bigint").alias("rows"))
    marks = s.select(*keys, c("score").cast("double").alias("value"), F.lit(1).alias("at"), counts.alias("found"))
    order = Ordered(keys, ["value", "at"], F.floor(c("value") * 1024))
    placed = order.scan(wanted.unionByName(marks), reached=upcoming(c("found"))).filter("at = 0")
    totals = s.groupBy(*keys).agg(F.max("positives").alias("positives"), F.max("total_rows").alias("total_rows"))
    tp, rows = F.coalesce(c("reached.tp"), F.lit(0)), F.coalesce(c("reached.rows"), F.lit(0))
    every = placed.join(totals, keys).select(*keys, c("value").alias("threshold"), tp.alias("tp"), (rows - tp).alias("fp"), "positives", "total_rows")
    return with_rates(
        every.withColumn("fn", c("positives") - c("tp")).withColumn("tn", c("total_rows") - c("positives") - c("fp"))
    )


def best_threshold(df: DataFrame, keys: Sequence[str], default: float = 0.5) -> DataFrame:
    """Threshold with the best F1, then precision, then recall, then nearest to the default, then the lower one."""
    table = threshold_table(df, keys)
    r = lambda name: F.round(name, 9)
    order = F.struct(r("f1"), r("precision"), r("recall"), -F.round(F.abs(F.col("threshold") - default), 9), -F.col("threshold"))
    cols = ["threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1"]
    return table.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in cols])
