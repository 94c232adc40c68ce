"""Fitted operators: held-out accuracy, defined results for odd rows, and their parts against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from trackloom.llm import pii, quality, spotsigs, tagger, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def area(scores, truth):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    for v in np.unique(scores):
        ranks[scores == v] = np.mean(np.flatnonzero(scores[order] == v)) + 1
    n = truth.sum()
    return (ranks[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def test_quality_separates_junk(docs, labels):
    got = quality.judged(docs, labels).select("doc_id", "llr", quality.F.col("quality").alias("score")).join(labels, "doc_id").toPandas()
    assert len(got) == labels.count()
    assert area(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.7


def test_quality_of_clean_and_junk_texts(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for n in range(600):
        words = ["".join(rng.choices(["an", "re", "ti", "the", "on"], k=3)) for _ in range(80)]
        junk = n % 3 == 0
        rows.append((n, (" | ".join(words) if junk else " ".join(words) + "."), "en" if n % 2 else None, f"host{n % 7}"))
        marks.append((n, 0 if junk else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([m for m in marks if m[0] % 2], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert all(got[n]["kept"] == bool(y) for n, y in marks)
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {n for n, y in marks if y}


def test_sparse_sites_shrink_to_the_level_above(spark):
    rows = [("big", "a", 6.0)] * 400 + [("big", "b", -6.0)] * 400 + [("tiny", "a", -6.0)] + [("good", "a", 6.0)] * 400
    hosts, paths = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, llr double"), 0.0)
    host = {r["host"]: r["host_share"] for r in hosts.collect()}
    path = {(r["host"], r["path"]): r["path_share"] for r in paths.collect()}
    assert host["good"] > 0.95 and 0.45 < host["big"] < 0.55
    assert host["tiny"] > 0.3  # one document moves a host little
    assert path["big", "a"] > 0.9 and path["big", "b"] < 0.1 and path["tiny", "a"] > 0.1


def test_quality_of_nasty_rows(nasty, no_rows, labels):
    assert quality.judged(nasty, labels).count() == nasty.count()
    assert quality.judged(nasty, labels.limit(0)).count() == nasty.count()
    assert quality.judged(no_rows, labels).count() == 0
    assert quality.good_documents(nasty, labels.limit(0)).columns == nasty.columns
    assert quality.good_documents(no_rows, labels).count() == 0


def all_maximal_segments(scores):
    """By definition: the best segment, the shortest of equal ones, then the same left and right of it."""
    best = None
    for b in range(len(scores)):
        for e in range(b + 1, len(scores) + 1):
            s = sum(scores[b:e])
            if s > 0 and (best is None or (s, -(e - b)) > (best[2], -(best[1] - best[0]))):
                best = (b, e, s)
    if not best:
        return []
    b, e, _ = best
    return all_maximal_segments(scores[:b]) + [best] + [(x + e, y + e, s) for x, y, s in all_maximal_segments(scores[e:])]


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    rng = random.Random(seed)
    scores = [rng.randint(-64, 40) / 8 + rng.random() / 64 for _ in range(rng.randint(0, 24))]
    got = [(b, e) for b, e, _ in toxicity.segments(np.array(scores))]
    assert got == [(b, e) for b, e, _ in all_maximal_segments(scores)]


def test_decay_solves_its_equation():
    scores, weights = np.array([-1.0, 2.0]), np.array([0.9, 0.1])
    k = toxicity.chance_decay(scores, weights)
    assert abs((weights * np.exp(k * scores)).sum() - 1) < 1e-6 and k > 0


def test_held_out_toxicity(docs, labels):
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert area(held["score"].to_numpy(), held["toxic"].to_numpy()) > 0.6
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all()
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()


def test_labels_of_the_held_out_fold_change_nothing(docs, labels):
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.in_training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert a == b


def test_toxicity_of_nasty_rows(nasty, no_rows, labels):
    rows = toxicity.toxicity(nasty, labels).collect()
    assert len(rows) == nasty.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(nasty, labels.limit(0)).count() == nasty.count()
    assert toxicity.toxicity(no_rows, labels).count() == 0


def base_by_patterns(text):
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns(docs):
    rng = random.Random(2)
    texts = [r["text"] for r in docs.filter("text rlike '[0-9@]'").limit(80).collect()]
    texts += ["".join(rng.choices("ab@.-+()1 25%é\n", k=80)) for _ in range(3000)]
    texts += ["a@b.c@d.e", "a@b@c.d", "x@y.z@", "1.2.3.4.5.6.7.8", "1.2.3.256 001.2.3.4", "4111 1111 1111 1111", "+49 (0)30-1234567.", "١٢٣.1.1.1"]
    for t in texts:
        assert pii.base_spans(t) == base_by_patterns(t), t


def test_patterns_take_linear_time():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "1 " * 200_000):
        pii.base_spans(t)


def test_slopes_of_the_net():
    x, y = pii.written_examples(3)
    net = tagger.Tagger.new(3)
    _, slopes = net.loss_and_slopes(x, y)
    rng = np.random.default_rng(0)
    for k, w in net.weights.items():
        for _ in range(3):
            at = tuple(int(rng.integers(n)) for n in w.shape)
            keep, e = w[at], 1e-5
            w[at] = keep + e
            up, _ = net.loss_and_slopes(x, y)
            w[at] = keep - e
            down, _ = net.loss_and_slopes(x, y)
            w[at] = keep
            assert abs((up - down) / (2 * e) - slopes[k][at]) < 1e-4


def test_decoding_finds_the_best_sequence():
    net = tagger.Tagger.new(1)
    x = np.random.default_rng(0).integers(0, tagger.VOCABULARY, (2, 4))
    emit, step = net.scores(x), net.weights["step"] + tagger.transitions_allowed()
    from itertools import product

    for row in range(2):
        best = max(product(range(tagger.TAGS), repeat=4), key=lambda t: sum(emit[row, i, t[i]] for i in range(4)) + sum(step[a, b] for a, b in zip(t, t[1:], strict=False)))
        assert tuple(net.decode(x)[row]) == best


@pytest.fixture(scope="module")
def trained(docs):
    return pii.train(docs)


def test_tagger_on_held_out_windows(trained):
    x, y = pii.written_examples(400, seed=77)
    got = trained.decode(x)
    assert (got == y).mean() > 0.97


def test_tagger_adds_further_spellings(trained):
    text = "the name . 34 words 97 . 51 . 17 . 173 and 4111.1111.1111.1111 then (017) 555-7713 end; 473696257 is none"
    added = pii.added_spans([text], [pii.base_spans(text)], trained)[0]
    assert ("ip", text.index("97"), text.index("173") + 3) in added
    assert ("phone", text.index("(017"), text.index("7713") + 4) in added
    assert not any(a <= text.index("473696257") < b for _, a, b in added)


def test_windows_join_to_one_sequence(trained):
    """A text far longer than a window gives the same spans wherever its windows are batched, and none overlaps a base span."""
    text = ("the words and 97 . 51 . 17 . 173 then a.b@mail4.example.com then more of the words here " * 30)
    base = pii.base_spans(text)
    one = pii.added_spans([text], [base], trained)[0]
    two = pii.added_spans(["x", text, ""], [[], base, []], trained)[1]
    assert one == two
    for _, a, b in one:
        assert all(b <= x or y <= a for _, x, y in base)


def test_personal_data_of_nasty_rows(nasty, no_rows, trained):
    rows = pii.personal_data(nasty, trained).collect()
    assert len(rows) == nasty.count()
    for r in rows:
        if not r["spans"]:
            assert r["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(no_rows, trained).count() == 0
    phones = next(r for r in rows if r["n_phone"] == 60)
    assert phones["spans"].startswith("phone:0:17,phone:18:35")


def sigs_by_definition(text):
    words = [w.strip(spotsigs.STRIP) for w in text.lower().split()]
    words = [w for w in words if w]
    found = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            rest = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:2]
            if len(rest) == 2:
                found.add((w, *rest))
    return found


def fingerprints_by_brute_force(rows):
    order = sorted(((i is None, -(i or 0), t or "", i) for i, t in rows))
    out = []
    for n, (_, _, text, doc_id) in enumerate(order):
        after = order[(n + 1) % len(order)][2]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        sims = []
        for other in (new, after):
            a, b = set(spotsigs.signatures(text).tolist()), set(spotsigs.signatures(other).tolist())
            sims.append(len(a & b) / len(a | b) if a | b else 1.0)
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), *sims))
    return out


@pytest.mark.parametrize("name", ["nasty", "small"])
def test_fingerprints(request, name):
    docs = request.getfixturevalue(name)
    want = fingerprints_by_brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in spotsigs.fingerprints(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_signatures_are_the_chains(docs):
    for r in docs.limit(50).collect():
        assert len(spotsigs.signatures(r["text"])) == max(len(sigs_by_definition(r["text"])), 1 if r["text"].split() else 0)


@pytest.mark.parametrize("least", [0.0, 0.3, 0.8])
def test_pruning_loses_nothing_above_its_bound(least):
    rng = np.random.default_rng(4)
    for _ in range(300):
        base = rng.integers(0, 900, rng.integers(0, 700))
        a, b = (np.unique(np.concatenate([base[: rng.integers(0, len(base) + 1)], rng.integers(0, 2000, rng.integers(0, 90))])).astype(np.uint32) for _ in range(2))
        union = len(set(a.tolist()) | set(b.tolist()))
        true = len(set(a.tolist()) & set(b.tolist())) / union if union else 1.0
        got = spotsigs.pruned_jaccard(a, b, least)
        assert got == true if true >= least else got in (0.0, true)


def test_one_document_follows_itself(spark, no_rows):
    one = spark.createDataFrame([(5, "the quick brown fox of old times said it")], "doc_id long, text string")
    row = spotsigs.fingerprints(one).first()
    assert row["near_next"] == 1.0
    assert spotsigs.fingerprints(no_rows).count() == 0


def test_pairs_of_similar_sets(spark, nasty, no_rows):
    rng = random.Random(6)
    words = [f"w{n}" for n in range(400)] + ["the", "of", "and", "to"] * 40
    base = [[rng.choice(words) for _ in range(rng.randint(20, 220))] for _ in range(12)]
    texts = []
    for t in base:
        for _ in range(6):
            new = list(t)
            for _ in range(rng.randint(0, 4)):
                new[rng.randrange(len(new))] = rng.choice(words)
            texts.append(" ".join(new[: len(new) - rng.randint(0, 12)]))
    texts += texts[:5] + ["", "single"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    sets = {}
    for n, t in enumerate(texts):
        sets.setdefault(tuple(spotsigs.signatures(t).tolist()), n)
    items = [(n, set(s)) for s, n in sets.items() if s]
    for similar in (0.5, 0.8):
        want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(items) for b, y in items[:i] if len(x & y) / len(x | y) >= similar}
        got = {(r["a"], r["b"]) for r in spotsigs.near_duplicates(docs, similar).collect()}
        assert got == want and len(want) > 10
    assert spotsigs.near_duplicates(no_rows).count() == 0
    spotsigs.near_duplicates(nasty).collect()
