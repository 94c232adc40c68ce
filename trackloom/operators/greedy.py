"""Rules chosen one after the other by what they add; rounds are sequential, the work inside a round is not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.lineage import checkpointed

# What repetition and weakness of a rule cost in every utility
OVERLAP, FAMILY, NEGATIVE, WEAK = 0.35, 0.75, 0.1, 1.0


def cost() -> Column:
    weak = F.when(F.col("weak"), WEAK).otherwise(0.0)
    return OVERLAP * F.col("overlap_positive") + FAMILY * F.col("family_reuse") + NEGATIVE * F.col("negative_support") + weak


# Named utilities over new_positive, confidence, positives, family_reuse and the columns of the cost
UTILITIES: dict[str, Callable[[], Column]] = {
    "diverse": lambda: F.col("new_positive") + 0.25 * F.col("confidence") - cost(),
    "coverage": lambda: F.col("new_positive") + F.col("confidence") * F.log1p("positives") + 0.75 / (1 + F.col("family_reuse")) - cost(),
}


def alike(fired: DataFrame) -> DataFrame:
    """Examples in rows: label, the list ``fired`` of their rules and the number ``n`` of examples with both.

    Rows (rule_id, example_id, label) are gathered per example; lists are taken as they are.
    """
    if "fired" in fired.columns:
        return fired.select("label", "fired", "n")
    each = fired.groupBy("example_id", "label").agg(F.sort_array(F.collect_set("rule_id")).alias("fired"))
    return each.groupBy("label", "fired").agg(F.count("*").alias("n"))


def _without(rows: DataFrame, chosen: list[dict]) -> DataFrame:
    """Examples that none of the chosen rules covers."""
    ids = [c["rule_id"] for c in chosen]
    return rows.filter(~F.exists("fired", lambda r: r.isin(ids))) if ids else rows


def select_diverse(rules: DataFrame, fired: DataFrame, k: int, utility: str = "diverse") -> list[dict]:
    """Up to k rules by marginal positive coverage.

    ``rules``: rule_id, confidence, family, negative_support and, where rules can be weak candidates, weak; ``fired``:
    rule_id, example_id, label, or examples in rows (see ``alike``).  Each round counts the uncovered examples, scores every
    rule and brings back one row, the winner.
    """
    scoring = UTILITIES[utility]
    positives = checkpointed(alike(fired).filter("label"))
    counted = lambda rows, name: rows.select("n", F.explode("fired").alias("rule_id")).groupBy("rule_id").agg(F.sum("n").alias(name))
    sizes = counted(positives, "positives")
    known = rules if "weak" in rules.columns else rules.withColumn("weak", F.lit(False))
    pool = checkpointed(known.join(sizes, "rule_id", "left").na.fill(0, ["positives"]))
    chosen, families = [], {}
    for _ in range(k):
        gained = counted(_without(positives, chosen), "new_positive")
        reuse = F.lit(0)
        for family, n in families.items():
            reuse = F.when(F.col("family") == family, n).otherwise(reuse)
        scored = (
            pool.filter(~F.col("rule_id").isin([c["rule_id"] for c in chosen]) if chosen else F.lit(True))
            .join(gained, "rule_id", "left")
            .na.fill(0, ["new_positive"])
            .withColumn("overlap_positive", F.col("positives") - F.col("new_positive"))
            .withColumn("family_reuse", reuse)
            .withColumn("utility", F.round(scoring(), 9))
        )
        best = scored.orderBy(F.desc("utility"), F.desc("confidence"), "rule_id").limit(1).collect()
        if not best or best[0]["new_positive"] == 0:
            break
        row = best[0].asDict()
        chosen.append(row)
        families[row["family"]] = families.get(row["family"], 0) + 1
    return chosen


def oracle_curve(fired: DataFrame, total_positive: int, k: int) -> list[dict]:
    """Rule that lifts F1 most at each step, with the F1 reached; ``fired`` as in ``select_diverse``."""
    rows, chosen, tp, fp = checkpointed(alike(fired)), [], 0, 0
    number = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    for step in range(1, k + 1):
        each = _without(rows, chosen).select("label", "n", F.explode("fired").alias("rule_id"))
        gains = each.groupBy("rule_id").agg(number(F.col("label")).alias("dtp"), number(~F.col("label")).alias("dfp"))
        new_tp, new_fp = F.col("dtp") + tp, F.col("dfp") + fp
        f1 = 2.0 * new_tp / F.greatest(F.lit(1), new_tp + new_fp + total_positive)
        best = (
            gains.withColumn("f1", F.round(f1, 9))
            .orderBy(F.desc("f1"), F.desc("dtp"), "dfp", "rule_id")
            .limit(1)
            .collect()
        )
        if not best:
            break
        row = best[0]
        tp, fp = tp + row["dtp"], fp + row["dfp"]
        chosen.append({"step": step, "rule_id": row["rule_id"], "tp": tp, "fp": fp, "f1": row["f1"]})
    return chosen
