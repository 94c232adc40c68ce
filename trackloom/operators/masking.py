"""Predictions of a rule set and the effect of leaving one rule out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

INFLUENCES = ["helpful_for_correct_prediction", "harmful_causal_source", "non_decisive_contribution", "redundant_trigger"]


def predict(examples: DataFrame, fired: DataFrame) -> DataFrame:
    """An example is positive when any rule fires; its score is the highest confidence.

    ``fired`` has (example_id, rule_id, confidence), each pair once.
    """
    scores = fired.groupBy("example_id").agg(F.max("confidence").alias("score"), F.count("*").alias("rules"))
    return (
        examples.join(scores, "example_id", "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
        .withColumn("rules", F.coalesce("rules", F.lit(0)))
        .withColumn("predicted", F.col("rules") > 0)
    )


def influence(label: Column, before: Column, after: Column, delta: Column, epsilon: float) -> Column:
    helpful, harmful, minor, redundant = INFLUENCES
    return (
        F.when((before == label) & (after != label), helpful)
        .when((before != label) & (after == label), harmful)
        .when(F.abs(delta) > epsilon, minor)
        .otherwise(redundant)
    )


def mask_rules(fired: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Every fired (example, rule) with the prediction and score without that rule.

    No prediction is recomputed: without a rule the score is the best of the others, read off the two highest
    confidences of the example.  An example's rules are a bounded group (the size of the rule set).
    """
    by_confidence = W.partitionBy("example_id").orderBy(F.desc("confidence"), "rule_id")
    everything = W.partitionBy("example_id")
    ranked = (
        fired.withColumn("position", F.row_number().over(by_confidence))
        .withColumn("rules", F.count("*").over(everything))
        .withColumn("top", F.max("confidence").over(everything))
        .withColumn("second", F.max(F.when(F.col("position") == 2, F.col("confidence"))).over(everything))
    )
    rest = F.when(F.col("position") == 1, F.coalesce("second", F.lit(0.0))).otherwise(F.col("top"))
    after = F.col("rules") > 1
    delta = F.col("top") - F.col("masked_score")
    return (
        ranked.withColumn("masked_score", rest)
        .withColumn("delta", delta)
        .withColumn("masked_predicted", after)
        .withColumn("flipped", ~after)
        .withColumn("influence", influence(F.col("label"), F.lit(True), after, F.col("delta"), epsilon))
        .drop("position", "second")
    )


def _two_best(scenes: DataFrame) -> DataFrame:
    by_score = F.sort_array("fired", asc=False)
    second = F.when(F.size("fired") > 1, by_score[1]["confidence"]).otherwise(0.0)
    return scenes.withColumn("rules", F.size("fired").cast("bigint")).withColumn("second", second).withColumn("top", F.array_max("fired")["confidence"])


def mask_scenes(scenes: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """``mask_rules`` of examples in rows: ``fired`` lists (confidence, rule_id) of an example.

    The best rule leaves the second score behind, every other one the first; where two are best, these are equal.
    """
    own = [k for k in ("example_id", "n") if k in scenes.columns]
    rows = _two_best(scenes).select(*own, "label", "rules", "second", "top", F.explode("fired").alias("r"))
    rest = F.when(F.col("r.confidence") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    after = F.col("rules") > 1
    return (
        rows.select(*own, "label", "r.rule_id", "r.confidence", "rules", "top", rest.alias("masked_score"))
        .withColumn("delta", F.col("top") - F.col("masked_score"))
        .withColumn("masked_predicted", after)
        .withColumn("flipped", ~after)
        .withColumn("influence", influence(F.col("label"), F.lit(True), after, F.col("delta"), epsilon))
    )


def scene_summary(scenes: DataFrame, epsilon: float = 1e-9, many: float = 0.5) -> DataFrame:
    """``example_summary`` of examples in rows: only the best rule of several can change a score.

    Without a change the key rule is the one with the largest id, as all deltas are equal then.
    """
    c, n, delta = F.col, F.col("rules"), F.col("top") - F.col("second")
    changes = (n == 1) | (F.round(delta, 9) > 0)
    best = F.array_max("fired")["rule_id"]
    kind = influence(c("label"), F.lit(True), n > 1, F.when(changes, delta).otherwise(0.0), epsilon)
    redundant = F.when(n == 1, 0).when(F.abs(delta) > epsilon, n - 1).otherwise(n)
    out = _two_best(scenes.filter(F.size("fired") > 0)).select(
        "example_id",
        "label",
        n.alias("triggers"),
        F.when(n == 1, 1).otherwise(0).cast("bigint").alias("flips"),
        redundant.cast("bigint").alias("redundant"),
        delta.alias("delta_max"),
        F.when(changes, best).otherwise(F.array_max(F.transform("fired", lambda r: r["rule_id"]))).alias("key_rule"),
        kind.alias("key_influence"),
    )
    share = c("redundant") / c("triggers")
    return out.withColumn("redundant_share", share).withColumn("mostly_redundant", share >= many)


def rule_summary(masked: DataFrame) -> DataFrame:
    """Flips, helpful and harmful counts, score changes and the dominant influence of each rule.

    A row with ``n`` stands for so many examples.
    """
    kind = F.col("influence")
    times = F.col("n") if "n" in masked.columns else F.lit(1).cast("bigint")
    number = lambda test: F.sum(F.when(test, times).otherwise(0))
    counts = {name: number(kind == full) for name, full in zip(["helpful", "harmful", "minor", "redundant"], INFLUENCES)}
    agg = masked.groupBy("rule_id").agg(
        F.sum(times).alias("triggers"),
        number(F.col("flipped")).alias("flips"),
        *[c.alias(n) for n, c in counts.items()],
        number((kind == INFLUENCES[0]) & F.col("label")).alias("necessary_tp"),
        number((kind == INFLUENCES[1]) & ~F.col("label")).alias("causal_fp"),
        F.sum(F.col("delta") * times).alias("delta_sum"),
        F.max("delta").alias("delta_max"),
    )
    sizes = F.greatest(*counts)
    dominant = F.lit(INFLUENCES[-1])
    for name, full in reversed(list(zip(["helpful", "harmful", "minor", "redundant"], INFLUENCES))):
        dominant = F.when(F.col(name) == sizes, full).otherwise(dominant)
    return agg.withColumn("dominant", dominant).withColumn("net", F.col("helpful") - F.col("harmful"))


def example_summary(masked: DataFrame, many: float = 0.5) -> DataFrame:
    """Influence counts of each example with its key rule: a flipping one first, then the largest change."""
    kind = F.col("influence")
    order = F.struct("flipped", F.round("delta", 9), "rule_id")
    agg = masked.groupBy("example_id", "label").agg(
        F.count("*").alias("triggers"),
        F.count_if(F.col("flipped")).alias("flips"),
        F.count_if(kind == INFLUENCES[3]).alias("redundant"),
        F.max("delta").alias("delta_max"),
        F.max_by("rule_id", order).alias("key_rule"),
        F.max_by("influence", order).alias("key_influence"),
    )
    share = F.col("redundant") / F.col("triggers")
    return agg.withColumn("redundant_share", share).withColumn("mostly_redundant", share >= many)
