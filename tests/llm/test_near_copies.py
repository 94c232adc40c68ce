"""The near-copy stage against brute-force Jaccard similarity of whole shingle sets."""

from collections import defaultdict
from itertools import combinations

import numpy as np

import corpus_pipeline
from trackloom.llm import near_copies


def shingles_by_brute_force(text, words=5):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def kept_by_brute_force(rows, similar=0.8):
    sets = {d: shingles_by_brute_force(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    shared = defaultdict(list)
    for d, s in sets.items():
        for x in s or {b""}:
            shared[x].append(d)
    for a, b in {p for ds in shared.values() for p in combinations(sorted(ds), 2)}:
        x, y = sets[a], sets[b]
        if 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {d for d in root if root[d] == d}


def made_up():
    """Edited copies around 0.8, copies of an original that is not there, the same with the original, and a chain."""
    rng, texts = np.random.default_rng(7), []
    for n in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts.append(words)
        for k in range(1, 7):  # k single words replaced: similarities from 0.95 down to below 0.8
            other = list(words)
            for at in rng.choice(200, k, replace=False):
                other[at] = f"new{n}x{k}x{at}"
            texts.append(other)
    for name in "st":
        star = [[f"{name}x{n}" if i in (7 * n % 100, (7 * n + 31) % 100) else f"{name}{i}" for i in range(100)] for n in range(60)]
        texts += star + [[f"{name}{i}" for i in range(100)]] * (name == "t")
    texts += [[f"c{i}" for i in range(4 * n, 4 * n + 80)] for n in range(25)]
    return [(1_000_000 + n, " ".join(t)) for n, t in enumerate(texts)]


def test_stage_against_whole_shingle_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [*((r["doc_id"], r["text"]) for r in docs.collect()), *made_up()]
    want = kept_by_brute_force(rows)
    given = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.dissimilar(spark, given, "").collect()} == want
    assert 100 < len(rows) - len(want) < len(rows) - 100


def test_long_lists_of_edited_copies(spark, monkeypatch):
    """Copies of few texts with more and less edits, some cut short, so that lists are long and many members are alike no hub."""
    rng, rows = np.random.default_rng(11), []
    for family in range(3):
        base = [f"{'abc'[family]}{i}" if i % 3 else f"all{i}" for i in range(120)]
        for _ in range(150):
            other = list(base)
            for at in rng.choice(120, rng.integers(0, 5), replace=False):
                other[at] = f"new{rng.integers(40)}"
            cut = 120 - int(rng.integers(0, 30)) * int(rng.integers(0, 2))
            rows.append((len(rows), " ".join(other[:cut])))
    monkeypatch.setattr(near_copies, "MEMBERS", 32)
    want = kept_by_brute_force(rows)
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == want
    assert 20 < len(want) < 430


def test_recall_at_the_threshold():
    """Pairs of similarity just above 0.8 share a position."""
    rng, met = np.random.default_rng(3), 0
    for _ in range(300):
        common = rng.integers(-(1 << 63), 1 << 63, 160)
        own = [np.unique(np.append(common, rng.integers(-(1 << 63), 1 << 63, 20))) for _ in range(2)]
        assert 0.79 < near_copies.likeness(*own) < 0.81
        met += bool(set(near_copies.positions(own[0])) & set(near_copies.positions(own[1])))
    assert met >= 299


def test_nasty_rows(spark, nasty, no_rows):
    got = near_copies.one_of_each(nasty)
    assert got.dtypes == nasty.dtypes
    texts = [r["text"] for r in got.collect()]
    assert len([t for t in texts if not (t or "").strip()]) == 1 and len(texts) == len(set(texts))
    assert near_copies.one_of_each(no_rows).count() == 0
