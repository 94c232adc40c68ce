"""Runs of words against a brute-force search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from trackloom.llm import queries, runs


def runs_by_brute_force(words, min_length=24, min_exponent=3):
    n, found = len(words), {}
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(min_length, min_exponent * p):
                found.setdefault((i, length), p)
            i = j
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def words_by_contract(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest_by_brute_force(doc_id, text):
    words = words_by_contract(doc_id, (text or "").encode().split())
    found = runs_by_brute_force(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    exponent = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", range(6))
def test_random_words_of_small_alphabets(seed):
    rng, texts = random.Random(seed), []
    for _ in range(60):
        words = [bytes([97 + rng.randrange(rng.choice([1, 2, 3]))]) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(4)):  # planted runs, next to and inside each other
            unit = [bytes([97 + rng.randrange(2)]) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = unit * rng.randrange(1, 12) + unit[: rng.randrange(len(unit))]
        texts.append(words)
    for least, exponent in ((24, 3), (6, 3), (10, 4)):
        assert runs.runs_of(texts, least, exponent) == [runs_by_brute_force(t, least, exponent) for t in texts]


def test_long_periodic_text_takes_one_pass():
    words = [b"a"] * 40_000 + [b"b"] + [b"x", b"y", b"z"] * 8_000
    assert runs.runs_of([words, []]) == [[(0, 40_000, 1), (40_001, 24_000, 3)], []]
    assert runs.kept_words(words, [(0, 40_000, 1), (40_001, 24_000, 3)]) == [b"a", b"b", b"x", b"y", b"z"]


def test_many_copies_of_a_passage_with_different_neighbours():
    passage = [f"p{i}".encode() for i in range(30)]
    words = [w for n in range(300) for w in (f"l{n}".encode(), *passage, f"r{n}".encode())]
    assert runs.runs_of([words]) == [[]]


def test_exponent_below_three_is_refused():
    with pytest.raises(ValueError, match="min_exponent"):
        runs.runs_of([[b"a"]], 4, 2)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = queries.QUERIES["op13_periodic_runs"](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(digest_by_brute_force(r["doc_id"], r["text"]) for r in docs)
    assert got.filter("n_runs > 0").count() > 10


def test_nasty_rows(nasty, no_rows):
    got = runs.digests(runs.without_runs(nasty, rewrite=runs.made_periodic))
    want = [digest_by_brute_force(r["doc_id"], r["text"]) for r in nasty.collect() if r["doc_id"] is not None]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.filter("doc_id is not null").collect()), key=key) == sorted(want, key=key)
    assert got.filter("doc_id is null").count() == nasty.filter("doc_id is null").count()
    assert runs.digests(runs.without_runs(no_rows)).count() == 0
