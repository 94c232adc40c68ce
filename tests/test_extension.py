"""Extension rounds against a plain-Python version, turns of the categories, and odd input."""

import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackloom.operators import extension
from trackloom.operators.extension import CATEGORIES, Terms, in_turns

SCHEMA = "example_id long, label boolean, template string, o int, sources int"
HEAD = "h"


def made_up(seed, examples=90):
    rng = random.Random(seed)
    classes = [f"object_class(S,O,c{n})." for n in range(4)]
    places = [f"object_x_position_state(S,O,x{n})." for n in range(3)]
    speeds = [f"object_vz_state(S,O,v{n})." for n in range(2)]
    rows = []
    for e in range(examples):
        state = rng.randrange(2)
        good = rng.random() < 0.3
        if rng.random() < 0.9:
            rows.append((e, None, f"segment_forward_state(S,s{state}).", None, 0))
        for o in range(rng.randrange(5)):
            kind, place, source = rng.randrange(4), rng.randrange(3), rng.choice([0, 1, 1, 2])
            good = good or (kind == 1 and place == 0 and rng.random() < 0.7)
            rows.append((e, None, classes[kind], o, source))
            rows.append((e, None, places[place], o, source))
            if rng.random() < 0.5:
                rows.append((e, None, speeds[rng.randrange(2)], o, source if kind else 3))
            if kind == 3:
                rows.append((e, None, "object_matched_prior(S,O,p).", o, source))
        rows = [(e, good, *r[2:]) if r[0] == e else r for r in rows]
    return rows


def name(body):
    return f"{HEAD}(S) :- " + ", ".join(a.rstrip(".") for a in sorted(body)) + "."


def by_hand(rows, terms):
    """Kept rules as (round, clause, parent, category, positive, negative, gain, score, is_parent)."""
    labels = {e: y for e, y, *_ in rows}
    held = {}
    for e, _, t, o, s in rows:
        held.setdefault((e, o), {}).setdefault(t, 0)
        held[e, o][t] |= s
    for (e, o), own in held.items():
        if o is not None:
            own.update(held.get((e, None), {}))

    def fired(body):
        needs = any("(S,O," in a for a in body)
        return [k for k, own in held.items() if (k[1] is not None) == needs and all(a in own for a in body)]

    def stats(body, once=False):
        n = Counter(e for e, _ in fired(body))
        if once:
            n = Counter(dict.fromkeys(n, 1))
        candidate = {a for k in fired(body) for a in body if held[k][a] & 2}
        accepted = {a for k in fired(body) for a in body if held[k][a] & 1}
        category = "accepted_only" if not candidate else "accepted_candidate" if accepted else "candidate_candidate" if len(candidate) > 1 else "candidate_only"
        p, q = sum(v for e, v in n.items() if labels[e]), sum(v for e, v in n.items() if not labels[e])
        return {
            "body": tuple(sorted(body)), "clause": name(body), "ps": sum(labels[e] for e in n), "ns": sum(not labels[e] for e in n), "pf": p, "nf": q, "conf": p / max(1, p + q),
            "sig": tuple(sorted(n.items())), "cov": tuple(sorted(e for e in n if labels[e])), "category": category, "ratio": len(candidate) / len(body),
            "semantic": sum(a.startswith(("object_class", "object_x_position_state")) for a in body), "gain": 0.0,
        }

    pool = sorted({r[2] for r in rows})
    current = [stats((a,), once=True) for a in pool]
    out = []
    for n in range(1, terms.rounds + 1):
        last, children = n == terms.rounds, {}
        for parent in current:
            mine = []
            if parent["ps"] < terms.least_support:
                continue
            for atom in pool:
                segments = sum(a.startswith("segment") for a in parent["body"])
                if atom in parent["body"] or atom.startswith("object_matched_prior") or (atom.startswith("segment") and segments >= 1):
                    continue
                c = stats((*parent["body"], atom))
                if any(a.startswith("object_matched_prior") for a in c["body"]) and not c["semantic"]:
                    continue
                if c["category"] == "candidate_candidate" or not c["pf"] or (c["pf"], c["nf"]) == (parent["pf"], parent["nf"]):
                    continue
                if last and c["conf"] == parent["conf"] and c["pf"] + c["nf"] < parent["pf"] + parent["nf"]:
                    continue
                if c["ps"] < 2 and not c["ns"]:
                    continue
                dp, more = c["conf"] - parent["conf"], c["ps"] - parent["ps"]
                df, ds = parent["nf"] - c["nf"], parent["ns"] - c["ns"]
                if (more <= 0 and (dp < 0 or ds < 0)) or not (dp >= 0 or df > 0 or ds > 0):
                    continue
                c["gain"] = max(0, dp) * 100 + max(0, df) * 4 + max(0, ds) * 3 + (dp >= 0)
                c["score"] = c["conf"] * 100 + c["ps"] * 10 + max(0, more) * 6 - c["ns"] * 4 - len(c["body"]) * 0.5 + c["semantic"] * 2 - c["ratio"] * 3
                c["key"] = (-round(c["score"], 9), -c["ps"], c["ns"], len(c["body"]), -c["semantic"], c["ratio"], c["clause"], parent["clause"])
                mine.append(c | {"parent": parent["clause"]})
            for c in sorted(mine, key=lambda c: c["key"])[: terms.per_parent]:
                if c["body"] not in children or c["key"] < children[c["body"]]["key"]:
                    children[c["body"]] = c
        kept, signatures, coverages = [], Counter(), Counter()
        for c in sorted(children.values(), key=lambda c: c["key"]):
            signatures[c["sig"]] += 1
            if signatures[c["sig"]] <= terms.per_signature:
                coverages[c["cov"]] += 1
                if coverages[c["cov"]] <= terms.per_coverage:
                    kept.append(c)
        at = lambda per_round: per_round[min(n, len(per_round)) - 1]
        taken, survivors = Counter(), []
        for c in kept:
            budget = at(terms.budgets).get(c["category"])
            if len(survivors) < at(terms.most) and (budget is None or taken[c["category"]] < budget):
                taken[c["category"]] += 1
                survivors.append(c)
        chosen, seen, taken = [], set(), Counter()
        order = sorted(survivors, key=lambda c: (-round(c["conf"], 9), -c["ps"], c["ns"], -round(c["gain"], 9), len(c["body"]), c["clause"]))
        lines = {k: [c for c in order if c["category"] == k] for k in CATEGORIES}
        turn = 0
        while not last and len(chosen) < terms.parents and any(lines[k] and taken[k] != terms.parent_budgets.get(k) for k in CATEGORIES):
            k = CATEGORIES[turn % 4]
            turn += 1
            if lines[k] and taken[k] != terms.parent_budgets.get(k):
                i = next((i for i, c in enumerate(lines[k]) if c["cov"] not in seen), 0)
                lines[k][0], lines[k][i] = lines[k][i], lines[k][0]
                c = lines[k].pop(0)
                chosen.append(c)
                seen.add(c["cov"])
                taken[k] += 1
        names = {c["clause"] for c in chosen}
        out += [(n, c["clause"], c["parent"], c["category"], c["ps"], c["ns"], round(c["gain"], 6), round(c["score"], 6), c["clause"] in names) for c in survivors]
        current = chosen
        if not chosen:
            break
    return sorted(out)


def collected(found):
    return sorted((r["round"], r["clause"], r["parent"], r["category"], r["positive_support"], r["negative_support"], round(r["gain"], 6), round(r["score"], 6), r["is_parent"]) for r in found.collect())


def test_rounds_against_plain_python(spark):
    tight = {"accepted_only": 5, "accepted_candidate": 12, "candidate_only": 2, "candidate_candidate": 0}
    small = Terms(rounds=3, per_parent=4, most=(14, 9), budgets=(tight,), parents=8, parent_budgets={"accepted_only": 2, "accepted_candidate": 5, "candidate_only": 1})
    later, categories = 0, set()
    for seed, terms in ((1, Terms()), (2, small)):
        rows = made_up(seed)
        found, history = extension.extension_rounds(spark.createDataFrame(rows, SCHEMA).repartition(4), HEAD, terms)
        got = collected(found)
        assert got == by_hand(rows, terms)
        later += sum(r[0] > 1 for r in got)
        categories |= {r[3] for r in got}
        counts = {(h["round"], h["outcome"]): h["n"] for h in history}
        assert counts[1, "kept"] == sum(r[0] == 1 for r in got)
        assert counts[2, "generated"] < counts[2, "linked"] and counts[2, "parents"] == counts[1, "next_parents"]
    assert later > 10 and len(categories) > 1


def test_many_passes_give_the_same_rules(spark, monkeypatch):
    rows = made_up(4, 40)
    facts = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    whole = collected(extension.extension_rounds(facts, HEAD)[0])
    monkeypatch.setattr(extension, "PASS", 11)
    assert collected(extension.extension_rounds(facts, HEAD)[0]) == whole == by_hand(rows, Terms())


def test_odd_input(spark):
    rows = made_up(5, 40)
    odd = [*rows, *rows[:20], (None, True, "object_class(S,O,c1).", 1, 1), (3, None, "object_class(S,O,c1).", 1, 1), (3, rows[0][1], None, 1, 1)]
    facts = spark.createDataFrame(odd, SCHEMA).withColumn("body", F.lit("x")).withColumn("signature", F.lit(1)).coalesce(2)
    assert collected(extension.extension_rounds(facts, HEAD)[0]) == by_hand(rows, Terms())
    found, history = extension.extension_rounds(spark.createDataFrame([], SCHEMA), HEAD)
    assert found.count() == 0 and all(h["n"] == 0 for h in history)


def test_turns_prefer_coverage_not_seen():
    rules = lambda *covers: [{"id": f"{i}{c}", "coverage": c} for i, c in enumerate(covers)]
    ranked = {"accepted_only": rules("a", "a", "b", "a"), "candidate_only": rules("a", "c")}
    ids = lambda most, budgets: [r["id"] for r in in_turns(ranked, most, budgets)]
    assert ids(9, {}) == ["0a", "1c", "2b", "0a", "1a", "3a"]
    assert ids(3, {}) == ["0a", "1c", "2b"]
    assert ids(9, {"accepted_only": 1, "candidate_only": 0}) == ["0a"]


def test_queries_agree(spark):
    data = "/root/testdata/sf0.001"
    queries = entry.queries()
    kept = queries["extension_rounds"](spark, data).collect()
    outcomes = {(r["round"], r["outcome"]): r["n"] for r in queries["extension_outcomes"](spark, data).collect()}
    for n in (1, 2):
        assert outcomes[n, "kept"] == sum(r["round"] == n for r in kept)
    assert outcomes[2, "parents"] <= outcomes[1, "next_parents"] == sum(r["is_parent"] for r in kept)
    assert {r["parent"] for r in kept if r["round"] == 2} <= {r["clause"] for r in kept if r["is_parent"]}
    spark.catalog.clearCache()
