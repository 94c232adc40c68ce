"""Rules grown atom by atom in rounds: candidates from kept parents, evidence, pruning, budgets, parents of the next round.

Evidence is never stored per rule.  The templates that hold for one object (with those of its segment) are a situation, and a body
fires on an object whose situation has all its templates.  Bodies are looked up once per distinct situation, under their rarest
template; examples with the same label and situations are one row.  Tables of rules and situations are bounded by the vocabulary
of templates and the budgets, not by the examples.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trackloom.functions import text
from trackloom.operators import rules, selection
from trackloom.operators.lineage import checkpointed
from trackloom.operators.rules import MARK

#: Categories of a body by the sources of its matched atoms, in the order in which they take turns.
CATEGORIES = ["accepted_only", "accepted_candidate", "candidate_only", "candidate_candidate"]
ACCEPTED, CANDIDATE = 1, 2
COUNTS = ["positive_support", "negative_support", "positive_firings", "negative_firings", "confidence"]
#: Bodies that one pass over the examples looks for; they are sent to every task (some 200 bytes each).
PASS = 50_000
#: Bodies of all situations (four bytes each) that are sent to every task; with more of them the situations are joined.
FIRED = 5_000_000


# Limits and budgets of a round must give the results that users know.
@dataclass(frozen=True)
class Terms:
    """A budget of None leaves a category free; ``most`` and ``budgets`` have an entry per round, the last one holds on."""

    rounds: int = 2
    strategies: Sequence[str] = tuple(rules.PRUNING)
    least_support: int = 2
    segment_atoms: int = 1
    candidate_pairs: bool = False
    per_parent: int = 25
    per_signature: int = 1
    per_coverage: int = 2
    most: Sequence[int] = (800, 200)
    budgets: Sequence[Mapping[str, int | None]] = field(
        default_factory=lambda: (
            {"accepted_only": 300, "accepted_candidate": 350, "candidate_only": 100, "candidate_candidate": 0},
            {"accepted_only": 80, "accepted_candidate": 100, "candidate_only": 20, "candidate_candidate": 0},
        )
    )
    parents: int = 300
    parent_budgets: Mapping[str, int | None] = field(
        default_factory=lambda: {"accepted_only": 120, "accepted_candidate": 150, "candidate_only": 30, "candidate_candidate": 0}
    )


def is_bound(template: Column) -> Column:
    return template.contains("(S,O,")


def in_segment(template: Column) -> Column:
    return text.atom_predicate(template).startswith("segment_")


def sources_of(source: Column) -> Column:
    return F.when(source == "A", ACCEPTED).when(source == "R", CANDIDATE).otherwise(0)


def sourced(template: Column, sources: Column) -> Column:
    """A template with its sources in one string, as a situation holds it."""
    return F.concat(F.coalesce(sources.cast("int"), F.lit(0)).cast("string"), F.lit("\t"), template)


def with_alone(own: Column, free: Column) -> Column:
    """The sorted situations of an example: its objects with the templates of the segment, and the segment alone, which begins with a mark.

    ``own`` lists the templates of each object, ``free`` has those of the segment (empty: none), all ``sourced`` and joined by marks.
    """
    alone = F.concat(F.lit(MARK), free)
    return F.sort_array(F.when(free == "", own).otherwise(F.concat(F.array(alone), F.transform(own, lambda x: F.concat(x, alone)))))


def scenes_of(facts: DataFrame) -> DataFrame:
    """example_id, label and situations of the examples of ``facts``; rows without example, label or template go."""
    c = F.col
    known = facts.filter("example_id is not null and label is not null and template is not null")
    held = known.groupBy("example_id", "label", "o").agg(F.array_join(F.sort_array(F.collect_set(sourced(c("template"), c("sources")))), MARK).alias("held"))
    own, free = F.collect_list(F.when(c("o").isNotNull(), c("held"))), F.coalesce(F.max(F.when(c("o").isNull(), c("held"))), F.lit(""))
    rows = held.groupBy("example_id", "label").agg(own.alias("own"), free.alias("free"))
    return rows.select("example_id", "label", with_alone(c("own"), c("free")).alias("situations"))


def alike(scenes: DataFrame) -> DataFrame:
    """Examples with the same label and situations as one row: scene (its number), n, and two XORs of hashes of the examples."""
    known = scenes.filter("example_id is not null and label is not null")
    hashes = [F.bit_xor(F.xxhash64(F.lit(s), "example_id", "label")).alias(f"h{i}") for i, s in enumerate((17, 92821))]
    rows = known.groupBy("label", "situations").agg(F.count("*").alias("n"), *hashes)
    return checkpointed(rows.withColumn("scene", F.monotonically_increasing_id()))


def kinds_of(scenes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The distinct situations: whether an object has it, whether a positive example does, in how many rows, and ``held``: template -> sources.

    Where the situations are written in tokens, ``names`` has the ``sourced`` templates (a list) of each ``token``.
    """
    rows = scenes.select("label", F.explode(F.array_distinct("situations")).alias("situation"))
    found = rows.groupBy("situation").agg(F.max("label").alias("positive"), F.count("*").alias("n"))
    parts = F.filter(F.split("situation", MARK), lambda x: x != "")
    if names is not None:
        found = checkpointed(found)
        tokens = found.select("situation", F.explode(parts).alias("token")).join(names, "token")
        found = found.join(tokens.groupBy("situation").agg(F.flatten(F.collect_list("sourced")).alias("parts")), "situation")
        parts = F.col("parts")
    atoms = F.transform(parts, lambda x: F.struct(F.substring_index(x, "\t", 1).cast("int").alias("sources"), F.substring(x, F.instr(x, "\t") + 1, F.length(x)).alias("template")))
    return checkpointed(found.withColumn("needs_object", ~F.col("situation").startswith(MARK)).withColumn("held", _held(atoms)).drop("parts"))


def _held(atoms: Column) -> Column:
    names = F.array_distinct(F.transform(atoms, lambda a: a["template"]))
    of = lambda t: F.aggregate(F.filter(atoms, lambda a: a["template"] == t), F.lit(0), lambda x, a: x.bitwiseOR(a["sources"]))
    return F.map_from_arrays(names, F.transform(names, of))


def summary(tallies: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts, signature of all firings, coverage of positive examples, and sources of a body.

    ``tallies`` has, in parts, for body_id and ``times`` that it fires in an example the number of such examples (p of positive ones, q
    of others) and the XORs of their hashes (p_h0 and p_h1 of positive ones), ``sources`` by position in the body the bits of matched
    candidate and accepted atoms.  A signature is the hashes for each number of firings.
    """
    c = F.col
    by_times = tallies.groupBy("body_id", "times").agg(
        *[F.sum(k).alias(k) for k in ("p", "q")], *[F.bit_xor(k).alias(k) for k in ("h0", "h1", "p_h0", "p_h1")]
    )
    firings = F.sort_array(F.collect_list(F.struct("times", "h0", "h1")))
    out = by_times.groupBy("body_id").agg(
        F.sum("p").alias("positive_support"),
        F.sum("q").alias("negative_support"),
        F.sum(c("p") * c("times")).alias("positive_firings"),
        F.sum(c("q") * c("times")).alias("negative_firings"),
        F.array_join(F.transform(firings, lambda f: F.concat_ws(":", f["times"], f["h0"], f["h1"])), ",").alias("signature"),
        F.concat_ws(":", F.sum("p"), F.bit_xor("p_h0"), F.bit_xor("p_h1")).alias("coverage"),
    ).join(sources, "body_id")
    fired = c("positive_firings") + c("negative_firings")
    category = (
        F.when((c("candidate") > 0) & (c("accepted") > 0), CATEGORIES[1])
        .when(c("candidate") == 0, CATEGORIES[0])
        .when(F.bit_count("candidate") >= 2, CATEGORIES[3])
        .otherwise(CATEGORIES[2])
    )
    return out.withColumn("confidence", c("positive_firings") / F.greatest(F.lit(1), fired)).withColumn("category", category)


def living_pairs(kinds: DataFrame) -> DataFrame:
    """Pairs of templates (both ways) that fire together on some positive example.

    A body with any other pair in it can't fire positively.  Two templates of the segment are paired on the example's own row.
    """
    names = F.array_sort(F.map_keys("held"))
    pairs = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: b != a), lambda b: F.struct(a.alias("atom"), b.alias("other")))))
    return kinds.filter("positive").select(F.explode(pairs).alias("p")).select("p.*").distinct()


def offspring(parents: DataFrame, pairs: DataFrame, terms: Terms) -> tuple[DataFrame, DataFrame]:
    """(parent_id, template) that share a living pair with the parent, and those of them whose every pair lives.

    Provenance templates never extend a rule; templates of the segment do up to a number.
    """
    open_to = pairs.filter(~text.atom_predicate(F.col("other")).isin(rules.PROVENANCE_PREDICATES))
    met = parents.select("parent_id", "body", F.explode("body").alias("atom")).join(open_to, "atom")
    linked = met.groupBy("parent_id", "body", F.col("other").alias("template")).agg(F.count("*").alias("links"))
    linked = linked.filter(~F.array_contains("body", F.col("template")))
    full = in_segment(F.col("template")) & (F.size(F.filter("body", in_segment)) >= terms.segment_atoms)
    grown = F.array_sort(F.concat("body", F.array("template")))
    alive = linked.filter((F.col("links") == F.size("body")) & ~full).select("parent_id", "template", grown.alias("body"))
    return linked, alive.filter(rules.grounded(F.col("body")))


def evidence(bodies: DataFrame, kinds: DataFrame, scenes: DataFrame, often: DataFrame, once: bool = False) -> DataFrame:
    """Summary per body_id of all bodies, found in one pass over the examples for every ``PASS`` of them.

    ``bodies`` has body_id (from 0, without gaps) and body, ``often`` template and n, its number of situations.  ``once`` counts the
    first object of an example only, or its segment.  Examples are spread by scene and stay there until only bodies are counted.
    """
    rarest = bodies.select("body_id", F.explode("body").alias("template")).join(often, "template").groupBy("body_id").agg(F.min(F.struct("n", "template"))["template"].alias("atom"))
    keyed = checkpointed(bodies.join(rarest, "body_id").withColumn("needs_object", F.exists("body", is_bound)))
    rows = kinds.select("situation", "needs_object", "held", F.explode(F.map_keys("held")).alias("atom"))
    bits = lambda source: F.aggregate(
        F.transform("body", lambda t, i: F.when(F.element_at("held", t).bitwiseAND(source) > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda a, b: a.bitwiseOR(b)
    )
    on = ["atom"] if once else ["atom", "needs_object"]
    passes = max(1, -(-keyed.count() // PASS))
    found = []
    for part in range(passes):
        chosen = keyed.filter(F.col("body_id") % passes == part).select("body_id", "body", *on)
        hits = rows.join(F.broadcast(chosen), on).filter(F.forall("body", lambda t: F.map_contains_key(F.col("held"), t)))
        fired = checkpointed(hits.select("situation", F.col("body_id").cast("int").alias("body_id"), bits(CANDIDATE).alias("candidate"), bits(ACCEPTED).alias("accepted")))
        # every situation is that of some example, so sources need no examples
        sources = fired.groupBy("body_id").agg(*[F.bit_or(x).alias(x) for x in ("candidate", "accepted")])
        known = fired.groupBy("situation").agg(F.collect_list("body_id").alias("fired"))
        if fired.count() <= FIRED:
            known = F.broadcast(known)
        spread = scenes.repartition("scene").select("scene", "label", "n", "h0", "h1", F.explode("situations").alias("situation"))
        met = spread.join(known, "situation").groupBy("scene", "label", "n", "h0", "h1").agg(F.flatten(F.collect_list("fired")).alias("ids"))
        found.append(summary(tallied(met, once), sources))
    return reduce(DataFrame.unionByName, found)


def tallied(rows: DataFrame, once: bool) -> DataFrame:
    """Sums and XORs per body_id and ``times`` that it is among the ``ids`` of an example (``once``: at all), one row per Arrow batch.

    Counted in the batch, so that a row per example and body is never kept, moved or spilled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            row = np.repeat(np.arange(len(ids), dtype=np.int64), ids.value_lengths().to_numpy())
            pairs, times = np.unique(row << 32 | ids.flatten().to_numpy().astype(np.int64), return_counts=True)
            row, body, times = pairs >> 32, pairs & 0xFFFFFFFF, np.ones_like(times) if once else times
            if not len(row):
                continue
            order = np.lexsort((times, body))
            row, body, times = row[order], body[order], times[order]
            starts = np.flatnonzero(np.r_[True, (body[1:] != body[:-1]) | (times[1:] != times[:-1])])
            label, n, h0, h1 = (batch.column(k).to_numpy(zero_copy_only=False)[row].astype(np.int64) for k in ("label", "n", "h0", "h1"))
            sums = {"p": n * label, "q": n * (1 - label)}
            marks = {"h0": h0, "h1": h1, "p_h0": h0 * label, "p_h1": h1 * label}
            out = {"body_id": body[starts], "times": times[starts]}
            out |= {k: np.add.reduceat(v, starts) for k, v in sums.items()} | {k: np.bitwise_xor.reduceat(v, starts) for k, v in marks.items()}
            yield pa.record_batch([pa.array(v.astype(np.int64)) for v in out.values()], [*out])

    kept = rows.select("label", "n", "h0", "h1", "ids")
    return kept.mapInArrow(run, ", ".join(f"{k} long" for k in ("body_id", "times", "p", "q", "h0", "h1", "p_h0", "p_h1")))


def first_rules(kinds: DataFrame, scenes: DataFrame, often: DataFrame) -> DataFrame:
    """Rules with one atom; an example counts the first object of a template only."""
    place = (F.col("place") - 1).cast("long").alias("body_id")
    bodies = checkpointed(selection.ranked(often, [F.col("template")], "place").select(place, F.array("template").alias("body")))
    return evidence(bodies, kinds, scenes, often, once=True).join(bodies, "body_id").drop("body_id")


def rank_order() -> list[Column]:
    c = F.col
    return [F.round("score", 9).desc(), F.desc("positive_support"), c("negative_support"), F.size("body"), rules.semantic_strength(c("body")).desc(), c("candidate_ratio"), c("clause"), c("parent")]


def parent_order() -> list[Column]:
    c = F.col
    return [F.round("confidence", 9).desc(), F.desc("positive_support"), c("negative_support"), F.round("gain", 9).desc(), F.size("body"), c("clause")]


def judged(children: DataFrame, parents: DataFrame, counts: DataFrame, head: str, last: bool, terms: Terms) -> DataFrame:
    """Every (parent, child) with the first reason to drop it (empty: it stays), gain and score."""
    c = F.col
    before = parents.select("parent_id", F.col("clause").alias("parent"), F.col("signature").alias("p_signature"), *[c(k).alias(f"p_{k}") for k in COUNTS])
    rows = rules.with_clause(children.join(counts, "body_id").join(before, "parent_id"), head)
    no_gain, gain = rules.marginal_gain(c("signature") == c("p_signature"), F.lit(0))
    pruned = rules.prune_reason(list(terms.strategies), last)
    barred = (c("category") == CATEGORIES[3]) & ~F.lit(terms.candidate_pairs)
    reason = F.when(barred, "candidate_pairs_barred").when(pruned != "", pruned).otherwise(no_gain)
    rows = rows.withColumn("reason", reason).withColumn("gain", gain).withColumn("candidate_ratio", F.bit_count("candidate") / F.size("body"))
    improvement = c("positive_support") - c("p_positive_support")
    return rows.withColumn("score", rules.extension_score(c("candidate_ratio"), c("category") == CATEGORIES[3], improvement))


def within_budgets(df: DataFrame, budgets: Mapping[str, int | None], most: int) -> DataFrame:
    """What a scan in rank order takes that skips categories without room: the best of each category, then the best of all."""
    place = F.row_number().over(W.partitionBy("category").orderBy(*rank_order()))
    room = F.lit(True)
    for name, budget in budgets.items():
        if budget is not None:
            room = room & ~((F.col("category") == name) & (F.col("place") > budget))
    return selection.best_overall(df.withColumn("place", place).filter(room).drop("place"), rank_order(), most)


def in_turns(ranked: Mapping[str, Sequence], most: int, budgets: Mapping[str, int | None]) -> list:
    """Rules taken by turns of the categories, each time the first with a coverage not seen yet, else the first.

    Each rule has a ``coverage``.  A first rule that is passed over changes places with the one taken.
    """
    waiting, taken, seen, chosen = {c: list(ranked.get(c, ())) for c in CATEGORIES}, Counter(), set(), []
    while True:
        before = len(chosen)
        for category in CATEGORIES:
            line = waiting[category]
            if not line or len(chosen) >= most or taken[category] == budgets.get(category):
                continue
            fresh = next((i for i, r in enumerate(line) if r["coverage"] not in seen), 0)
            rule, line[fresh] = line[fresh], line[0]
            del line[0]
            chosen.append(rule)
            taken[category] += 1
            seen.add(rule["coverage"])
        if len(chosen) == before:
            return chosen


def extension_rounds(
    facts: DataFrame, head: str, terms: Terms = Terms(), stop_after: int | None = None, names: DataFrame | None = None
) -> tuple[DataFrame, list[dict]]:
    """The kept rules of all rounds, and a count per round and outcome.

    ``facts`` has example_id, label, template, o (null: of the segment) and sources (bit 1 accepted, bit 2 candidate); repeated
    rows merge, rows without example, label or template are left out, further columns are ignored, and no facts give no rules.
    Templates have no line break.  Instead of facts, one row per example with its ``situations`` (``with_alone``) will do, also in
    tokens with ``names`` (``kinds_of``).
    Round 1 extends the rules with one atom, each later round the parents chosen from the round before.  A child stays if some
    parent keeps it; of equal bodies, firings and coverages the best stay, then the budgets of the categories decide.
    ``stop_after`` ends early without making that round the last one of the terms.
    Rules: round, body, clause, parent, category, the counts, gain, score and is_parent.  The driver sees the kept rules of a
    round (``most`` at most) to choose parents; all else is on Spark.
    """
    scenes = alike(facts if "situations" in facts.columns else scenes_of(facts))
    kinds = kinds_of(scenes, names)
    pairs = checkpointed(living_pairs(kinds))
    often = checkpointed(kinds.select(F.explode(F.map_keys("held")).alias("template"), "n").groupBy("template").agg(F.sum("n").alias("n")))
    current = checkpointed(rules.with_clause(first_rules(kinds, scenes, often), head))
    kept_rounds, history = [], []
    for n in range(1, min(terms.rounds, stop_after or terms.rounds) + 1):
        last = n == terms.rounds
        parents = current.filter(F.col("positive_support") >= terms.least_support).withColumn("parent_id", F.xxhash64("clause"))
        linked, children = offspring(parents, pairs, terms)
        bodies = checkpointed(selection.ranked(children.select("body").distinct(), [F.col("body")], "place").select((F.col("place") - 1).cast("long").alias("body_id"), "body"))
        outcome = checkpointed(judged(children.join(bodies, "body"), parents, evidence(bodies, kinds, scenes, often), head, last, terms))
        good = outcome.filter("reason = ''")
        of_parent = checkpointed(selection.best_in_group(good, ["parent_id"], rank_order(), terms.per_parent).drop("rank_in_group"))
        once = selection.limit_per_signature(of_parent, ["body_id"], rank_order(), 1)
        distinct = selection.limit_per_signature(once, ["signature"], rank_order(), terms.per_signature)
        spread = checkpointed(selection.limit_per_signature(distinct, ["coverage"], rank_order(), terms.per_coverage))
        at = lambda per_round: per_round[min(n, len(per_round)) - 1]
        kept = checkpointed(within_budgets(spread, at(terms.budgets), at(terms.most)))
        chosen = []
        if not last:
            first = selection.limit_per_signature(kept, ["signature"], parent_order(), 1)
            ranked: dict[str, list] = {}
            for r in first.orderBy(*parent_order()).select("body_id", "category", "coverage").collect():
                ranked.setdefault(r["category"], []).append(r)
            chosen = [r["body_id"] for r in in_turns(ranked, terms.parents, terms.parent_budgets)]
        steps = {"parents": parents, "linked": linked, "generated": children, "bodies": bodies, "kept_by_parent": of_parent, "distinct": spread, "kept": kept}
        tallies = [(name, df.count()) for name, df in steps.items()]
        reasons = outcome.filter("reason <> ''").groupBy("reason").count().orderBy("reason").collect()
        history += [{"round": n, "outcome": k, "n": v} for k, v in [*tallies, *[(f"dropped:{r['reason']}", r["count"]) for r in reasons], ("next_parents", len(chosen))]]
        is_parent = F.col("body_id").isin(chosen) if chosen else F.lit(False)
        kept_rounds.append(kept.select(F.lit(n).alias("round"), "body", "clause", "parent", "category", *COUNTS, "signature", "coverage", "gain", "score", is_parent.alias("is_parent")))
        current = kept_rounds[-1].filter("is_parent")
        if not chosen:
            break
    return reduce(DataFrame.unionByName, kept_rounds), history
