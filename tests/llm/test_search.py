"""Search against a brute-force version of the contract, and the graph of shared sums against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np

from trackloom.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ranked_by_brute_force(docs, items, top=50):
    counts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    total, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        rows = []
        for d, c, n in counts:
            m = 100 - 50 + 50 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                rows.append((-score, d is None, d if d is not None else 0, d))
        out += [(item_id, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = queries.QUERIES["op11_ranked_search"](spark, folder)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == ranked_by_brute_force(docs, items)


def test_blocks_of_few_terms_give_the_same(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["Aa", "b-b", "çé", "D9", "e_e", "f f", "\x85", "g"]) for _ in range(n))
    docs = [(n // 2, text(rng.randrange(30))) for n in range(400)]  # every id twice
    items = [(n // 3, text(rng.randrange(1, 9))) for n in range(30)]
    spread = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = ranked_by_brute_force(docs, items, 5)
    for block in (12, 1000):
        assert sorted(map(tuple, search.ranked(spread, asked, 5, block).collect()), key=str) == want


def test_shared_sums_are_plain_sums_and_fewer_additions():
    rng = random.Random(5)
    common = [f"c{n}".encode() for n in range(12)]
    items = [(n, {*rng.sample(common, 9), *[f"own{n}x{k}".encode() for k in range(3)]}) for n in range(60)]
    plan = search.Plan.of(items)
    plan.weights = np.arange(1, len(plan.vocabulary) + 1)
    rows = [(d, t, rng.randrange(1, 9)) for d in range(20) for t in rng.sample(range(len(plan.vocabulary)), 40)]
    docs, terms, tf = map(np.array, zip(*rows, strict=True))
    m = np.array([50 + d for d in range(20)])
    got = plan.scores(docs, terms, tf, m)
    want = np.zeros_like(got)
    for d, t, f in rows:
        for n, (_, found) in enumerate(items):
            if sorted(plan.vocabulary)[t] in found:
                want[n, d] += plan.weights[t] * (1_000_000_000 * f // (1000 * f + 20 * m[d]))
    assert (got == want).all()
    assert len(plan.uses) + sum(len(x[0]) for x in plan.levels) < sum(len(f) for _, f in items) / 1.5


def test_nasty_rows(spark, nasty, no_rows):
    docs = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    items = [(1, "same TEXT here"), (1, "word é word"), (2, None), (3, ""), (None, "a one"), (4, "nowhere"), (5, "x" * 5000)]
    asked = spark.createDataFrame([(*i, "k", 3) for i in items], "item_id long, text string, item string, score int")
    assert sorted(map(tuple, search.ranked(nasty, asked).collect()), key=str) == ranked_by_brute_force(docs, items)
    assert search.ranked(no_rows, asked).count() == 0
    assert search.ranked(nasty, asked.limit(0)).count() == 0
