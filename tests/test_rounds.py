"""Reselection rounds against a plain-Python version, and what a round may cost."""

import random
from itertools import combinations

import __spark_entry__ as entry
from trackloom.operators.rounds import Terms, reselection_rounds, verdict
from trackloom.plans import reselecting
from trackloom.plans.views import Inputs

SCHEMAS = "rule_id long, body array<string>, positive_support long, negative_support long", "example_id long, rule_id long, label boolean, confidence double"


def score(parent, child, size):
    (pb, pp, pn), (cb, cp, cn), place = parent, child[1:], child[0]
    gain = cp / max(1, cp + cn) - pp / max(1, pp + pn)
    bonus = 0.25 if any("(S,O," in a for a in cb) else 0.0
    return 2 * gain + pn - cn + 0.75 * min(1.0, cp / max(1, pp)) + bonus + 0.25 * (size - place + 1) / size - 0.05 * (len(cb) - len(pb))


def rounds_by_hand(pool, fired, positives, start, terms):
    """``pool``: rule -> (body, positive, negative); ``fired``: rule -> set of (example, label)."""

    def evaluated(chosen):
        hit = set().union(*[fired.get(r, set()) for r in chosen])
        tp = sum(label for _, label in hit)
        fp = len(hit) - tp
        return {"tp": tp, "fp": fp, "fn": positives - tp, "precision": tp / max(1, tp + fp), "recall": tp / max(1, positives), "f1": 2 * tp / max(1, tp + fp + positives)}

    selected, given_up, held, failed = list(start), set(), set(), set()
    best = evaluated(selected)
    out = [("start", best["tp"], best["fp"], 0, 0, 0)]
    for _ in range(terms.max_rounds):
        effect = {}
        for r in selected:
            alone = [label for e, label in fired.get(r, ()) if not any((e, label) in fired.get(q, ()) for q in selected if q != r)]
            effect[r] = (sum(alone), len(alone) - sum(alone))  # helpful (and needed), harmful (and a false positive)
        def why(r):
            good, bad = effect[r]
            return not good and bad > 0
        gone = {r for r in selected if why(r)} - held
        parents = []
        for r in selected:
            body, p, n = pool[r]
            good, bad = effect[r]
            if r not in gone and ((len(body) == 1 and "(S,O," in body[0]) or bad or p / max(1, p + n) < terms.low_precision or n > p):
                parents.append(r)
        parents.sort(key=lambda r: (2 * effect[r][1], pool[r][2], -pool[r][1] / max(1, pool[r][1] + pool[r][2]), r), reverse=True)
        queue = []
        for r in parents[: terms.parents]:
            options = [
                (-round(score(pool[r], (c, *pool[c]), len(pool)), 9), c, r) for c in pool
                if set(pool[r][0]) < set(pool[c][0]) and pool[c][1] > 0 and pool[c][1] >= terms.least_retention * pool[r][1] and c not in selected and c not in given_up and (r, c) not in failed
            ]
            queue += sorted(options)[: terms.queue]
        swapped = {}
        for _, c, r in sorted(queue):
            if r not in swapped and c not in swapped.values() and len(swapped) < terms.replacements:
                swapped[r] = c
        if not gone and not swapped:
            break
        left = [swapped.get(r, r) for r in selected if r not in gone]
        added = [c for c in sorted(pool) if pool[c][1] > 0 and c not in {*selected, *left, *given_up}][: max(0, terms.k - len(left))]
        trial = evaluated(left + added)
        status = verdict(trial, best, terms)
        out.append((status, trial["tp"], trial["fp"], len(gone), len(swapped), len(added)))
        if status.startswith("accepted"):
            given_up |= gone | set(swapped)
            selected, best = left + added, trial
        else:
            held |= gone
            given_up |= set(added)
            failed |= set(swapped.items())
    return out, selected


def made_up(seed):
    rng = random.Random(seed)
    atoms = [f"near(S,O,{n})." for n in range(5)] + [f"ahead(S,{n})." for n in range(3)]
    holds = {e: {a for a in atoms if rng.random() < 0.45} for e in range(120)}
    label = {e: rng.random() < 0.25 + 0.5 * (atoms[0] in holds[e] and atoms[6] in holds[e]) for e in holds}
    bodies = [c for n in (1, 2, 3) for c in combinations(atoms, n)]
    rows = []
    for body in bodies:
        hit = {(e, label[e]) for e in holds if set(body) <= holds[e]}
        p = sum(y for _, y in hit)
        if p:
            rows.append((-p / len(hit), -p, body, hit))
    rows.sort()
    pool = {n: (list(body), -p, len(hit) + p) for n, (_, p, body, hit) in enumerate(rows, 1)}
    fired = {n: hit for n, (*_, hit) in enumerate(rows, 1)}
    return pool, fired, sum(label.values())


def test_rounds_against_plain_python(spark):
    seen = set()
    for seed, mode in ((1, "aggressive"), (2, "strict"), (3, "moderate")):
        pool, fired, positives = made_up(seed)
        terms = Terms(k=6, mode=mode, max_rounds=4)
        start = sorted(sorted(pool, key=lambda r: (-pool[r][1], r))[:6])
        want, chosen = rounds_by_hand(pool, fired, positives, start, terms)
        pool_df = spark.createDataFrame([(r, *v) for r, v in pool.items()], SCHEMAS[0]).coalesce(4)
        confidence = {r: p / max(1, p + n) for r, (_, p, n) in pool.items()}
        fired_df = spark.createDataFrame([(e, r, bool(y), confidence[r]) for r, hit in fired.items() for e, y in hit], SCHEMAS[1]).coalesce(4)
        history, got = reselection_rounds(pool_df, fired_df, positives, start, terms)
        assert [(h["status"], h["tp"], h["fp"], h["removed"], h["swapped"], h["added"]) for h in history] == want
        assert sorted(got) == sorted(chosen) and len(set(got)) == len(got) <= 6
        seen |= {h["status"].split(":")[0] for h in history}
    assert seen == {"start", "accepted", "failed"}


def test_terms_of_a_round():
    best = {"f1": 0.5, "recall": 0.5, "tp": 10, "precision": 0.5}
    say = lambda **change: verdict(best | change, best, Terms()).split(":")[1]
    assert say(f1=0.49) == "f1_below_current_best"
    assert say(f1=0.6, recall=0.46) == "recall_drop_exceeds_tolerance"
    assert say(f1=0.6, tp=8) == "tp_loss_exceeds_tolerance"
    assert say(f1=0.501, tp=9) == "f1_improved_within_tolerance"
    assert say(precision=0.51) == "precision_improved_within_tolerance"
    assert say() == "no_f1_or_precision_improvement"


def test_query_keeps_the_better_round(spark):
    rows = entry.queries()["reselection_rounds"](spark, "/root/testdata/sf0.001").collect()
    kept = [r for r in rows if not r["status"].startswith("failed")]
    assert rows[0]["status"] == "start" and all(a["f1"] <= b["f1"] for a, b in zip(kept, kept[1:]))
    t = Inputs(spark, "/root/testdata/sf0.001")
    assert len(reselecting.broadest(t)) == reselecting.SELECTED
    spark.catalog.clearCache()
