"""Reselection as rounds: harmful rules go, broad ones give way to specialisations, free places are refilled, and a round that
does not pay is taken back.

Evidence stays on Spark: firings of the whole pool, masking, containment of bodies and evaluation.  The driver holds the
selected set (``k`` rules at most), the rules it has given up, and a queue of specialisations whose length is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import masking, reselection
from trackloom.operators.lineage import checkpointed
from trackloom.operators.selection import best_in_group


# Tolerances of a round and weights of a specialisation must give the results that users know.
@dataclass(frozen=True)
class Terms:
    k: int = 10
    mode: str = "moderate"
    max_rounds: int = 5
    min_f1_improvement: float = 0.001
    max_recall_drop: float = 0.03
    max_tp_loss: int = 1
    low_precision: float = 0.5
    least_retention: float = 0.8
    parents: int = 3
    queue: int = 10
    replacements: int = 3


def descendants(parents: DataFrame, pool: DataFrame) -> DataFrame:
    """parent_id, rule_id and the parts of the score of every rule whose body holds all atoms of the parent's and more.

    Both sides have rule_id, body, positive_support and negative_support; rule_id is the place of a rule in the final order of
    the pool.  Candidates come from an index of the pool by atom, each parent looking under its rarest atom only.
    """
    index = pool.select(F.col("rule_id").alias("child"), F.explode(F.array_distinct("body")).alias("atom"))
    often = index.groupBy("atom").agg(F.count("*").alias("n"))
    wanted = parents.select(F.col("rule_id").alias("parent_id"), F.explode(F.array_distinct("body")).alias("atom"))
    rarest = wanted.join(often, "atom").groupBy("parent_id").agg(F.min(F.struct("n", "atom"))["atom"].alias("atom"))
    mine = parents.select(F.col("rule_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in ("body", "positive_support", "negative_support")])
    pairs = rarest.join(index, "atom").select("parent_id", F.col("child").alias("rule_id")).join(mine, "parent_id").join(pool.select("rule_id", "body", "positive_support", "negative_support"), "rule_id")
    more = (F.size(F.array_except("p_body", "body")) == 0) & (F.size(F.array_distinct("body")) > F.size(F.array_distinct("p_body")))
    precision = lambda p: F.col(f"{p}positive_support") / F.greatest(F.lit(1), F.col(f"{p}positive_support") + F.col(f"{p}negative_support"))
    size = pool.agg(F.count("*").alias("pool_size"))  # one row
    parts = pairs.filter(more & (F.col("positive_support") > 0)).crossJoin(F.broadcast(size)).select(
        "parent_id", "rule_id",
        (precision("") - precision("p_")).alias("precision_gain"),
        (F.col("p_negative_support") - F.col("negative_support")).alias("fp_reduction"),
        F.least(F.lit(1.0), F.col("positive_support") / F.greatest(F.lit(1), F.col("p_positive_support"))).alias("retention"),
        F.when(F.exists("body", lambda a: a.contains("(S,O,")), 0.25).otherwise(0.0).alias("grounding_bonus"),
        ((F.col("pool_size") - F.col("rule_id") + 1) / F.col("pool_size")).alias("rank_bonus"),
        (0.05 * (F.size("body") - F.size("p_body"))).alias("length_penalty"),
    )
    score = 2.0 * F.col("precision_gain") + F.col("fp_reduction") + 0.75 * F.col("retention") + F.col("grounding_bonus") + 0.25 * F.col("rank_bonus") - F.col("length_penalty")
    return parts.withColumn("score", score)


def parent_reasons(terms: Terms) -> Column:
    """Why a selected rule should give way to a specialisation, joined by bars; empty if it should not."""
    c = F.col
    mixed = (c("harmful") > 0) & (c("causal_class") == "mixed_rule")
    precision = c("positive_support") / F.greatest(F.lit(1), c("positive_support") + c("negative_support"))
    rules = {
        "broad_one_atom_object_rule": (F.size("body") == 1) & c("body")[0].contains("(S,O,"),
        "high_fp": c("causal_fp") > 0,
        "low_precision": precision < terms.low_precision,
        "mixed_harmful": mixed,
        "negative_support_gt_positive_support": c("negative_support") > c("positive_support"),
    }
    return F.concat_ws("|", *[F.when(condition, name) for name, condition in rules.items()])


def alike(fired: DataFrame) -> DataFrame:
    """Examples in rows: label, ``fired`` with (confidence, rule_id) of their rules, and the number ``n`` of examples with both.

    Rows (example_id, rule_id, label, confidence) are gathered per example; lists are taken as they are.
    """
    if "fired" in fired.columns:
        return fired.select("label", "fired", "n")
    each = fired.groupBy("example_id", "label").agg(F.sort_array(F.collect_set(F.struct("confidence", "rule_id"))).alias("fired"))
    return each.groupBy("label", "fired").agg(F.count("*").alias("n"))


def evaluated(fired: DataFrame, selected: list[int], positives: int) -> dict:
    """Counts of a rule set that calls an example positive if any of its rules fires."""
    hit = fired.filter(F.exists("fired", lambda r: r["rule_id"].isin(selected)))
    number = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    row = hit.agg(number(F.col("label")).alias("tp"), number(~F.col("label")).alias("fp")).first()
    tp, fp = row["tp"], row["fp"]
    return {
        "tp": tp, "fp": fp, "fn": positives - tp, "precision": tp / max(1, tp + fp), "recall": tp / max(1, positives),
        "f1": 2.0 * tp / max(1, 2 * tp + fp + positives - tp),
    }


def verdict(trial: dict, best: dict, terms: Terms) -> str:
    if trial["f1"] < best["f1"]:
        return "failed:f1_below_current_best"
    if best["recall"] - trial["recall"] > terms.max_recall_drop:
        return "failed:recall_drop_exceeds_tolerance"
    if best["tp"] - trial["tp"] > terms.max_tp_loss:
        return "failed:tp_loss_exceeds_tolerance"
    if trial["f1"] >= best["f1"] + terms.min_f1_improvement:
        return "accepted:f1_improved_within_tolerance"
    if trial["precision"] > best["precision"]:
        return "accepted:precision_improved_within_tolerance"
    return "failed:no_f1_or_precision_improvement"


@dataclass
class State:
    """What the driver remembers between rounds."""

    selected: list[int]
    given_up: set[int] = field(default_factory=set)  # removed for good, or tried in vain
    held: set[int] = field(default_factory=set)  # their removal failed
    failed_pairs: set[tuple[int, int]] = field(default_factory=set)


def judged(pool: DataFrame, fired: DataFrame, selected: list[int], terms: Terms) -> list:
    """The selected rules with their effect in this set: reason to remove (or empty) and reasons to specialise (or empty)."""
    mine = fired.withColumn("fired", F.filter("fired", lambda r: r["rule_id"].isin(selected))).filter(F.size("fired") > 0)
    effect = masking.rule_summary(masking.mask_scenes(mine))
    rows = pool.filter(F.col("rule_id").isin(selected)).drop("confidence").join(effect, "rule_id", "left")
    rows = rows.withColumn("causal_class", reselection.causal_class(F.lit(False)))
    rows = rows.fillna(0, ["helpful", "harmful", "necessary_tp", "causal_fp", "net"])
    return rows.select("rule_id", "body", "positive_support", "negative_support", "harmful", "causal_fp", reselection.removal_reason(terms.mode).alias("removal"), parent_reasons(terms).alias("reasons")).collect()


def swaps(pool: DataFrame, rows: list, state: State, terms: Terms) -> dict[int, int]:
    """parent: its specialisation.  Parents with the most harm come first; each rule is used once, best score first."""
    order = lambda r: (r["harmful"] + r["causal_fp"], r["negative_support"], -r["positive_support"] / max(1, r["positive_support"] + r["negative_support"]), r["rule_id"])
    parents = sorted((r for r in rows if r["reasons"]), key=order, reverse=True)[: terms.parents]
    if not parents:
        return {}
    given = pool.filter(F.col("rule_id").isin([r["rule_id"] for r in parents]))
    found = descendants(given, pool).filter((F.col("retention") >= terms.least_retention) & ~F.col("rule_id").isin([*state.selected, *state.given_up]))
    for parent, child in state.failed_pairs:
        found = found.filter(~((F.col("parent_id") == parent) & (F.col("rule_id") == child)))
    queued = best_in_group(found, ["parent_id"], [F.desc(F.round("score", 9)), F.col("rule_id")], terms.queue)
    chosen: dict[int, int] = {}
    # at most ``parents`` times ``queue`` rows
    for r in sorted(queued.collect(), key=lambda r: (-round(r["score"], 9), r["rule_id"], r["parent_id"])):
        if r["parent_id"] not in chosen and r["rule_id"] not in chosen.values() and len(chosen) < terms.replacements:
            chosen[r["parent_id"]] = r["rule_id"]
    return chosen


def reselection_rounds(pool: DataFrame, fired: DataFrame, positives: int, start: list[int], terms: Terms = Terms()) -> tuple[list[dict], list[int]]:
    """A row per round (round 0 is the start) and the rules of the best round.

    ``pool`` has rule_id (its place in the final order), body, positive_support and negative_support; ``fired`` has example_id,
    rule_id, label and confidence for the whole pool, or is made of the rows of ``alike``.  Each round removes rules by ``mode`` and specialises others, refills
    from the pool in its order, and is kept if F1, recall and true positives stay within the terms.  What failed isn't tried
    again.  Rounds end when nothing is left to change.  The best round has the highest F1, then precision, then fewest changes.
    """
    pool, fired = checkpointed(pool), checkpointed(alike(fired))
    state = State(list(start))
    best = evaluated(fired, state.selected, positives)
    history = [{"round": 0, "status": "start", **best, "removed": 0, "swapped": 0, "added": 0}]
    for n in range(1, terms.max_rounds + 1):
        rows = judged(pool, fired, state.selected, terms)
        gone = {r["rule_id"] for r in rows if r["removal"]} - state.held
        swapped = swaps(pool, [r for r in rows if r["rule_id"] not in gone], state, terms)
        if not gone and not swapped:
            break
        left = [swapped.get(r, r) for r in state.selected if r not in gone]
        taken = {*state.selected, *left, *state.given_up}
        fresh = pool.filter((F.col("positive_support") > 0) & ~F.col("rule_id").isin(list(taken))).orderBy("rule_id").limit(max(0, terms.k - len(left)))
        added = [r["rule_id"] for r in fresh.select("rule_id").collect()]
        trial = evaluated(fired, [*left, *added], positives)
        status = verdict(trial, best, terms)
        history.append({"round": n, "status": status, **trial, "removed": len(gone), "swapped": len(swapped), "added": len(added)})
        if status.startswith("accepted"):
            state.given_up |= gone | set(swapped)
            state.selected, best = [*left, *added], trial
        else:
            state.held |= gone
            state.given_up |= set(added)
            state.failed_pairs |= set(swapped.items())
    return history, state.selected
