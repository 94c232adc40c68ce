"""Operators that find copies, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from trackloom.llm import exact, simhash, suffixes
from trackloom.llm.components import smallest_reachable


def removed_by_brute_force(texts, length=suffixes.LENGTH):
    raw = [(t or "").encode() for t in texts]
    starts = defaultdict(int)
    for r in raw:
        for i in range(len(r) - length + 1):
            starts[r[i : i + length]] += 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if starts[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def check_removal(docs):
    rows = docs.select("doc_id", "text").collect()
    want = [(r["doc_id"], *x) for r, x in zip(rows, removed_by_brute_force([r["text"] for r in rows]), strict=True)]
    got = [tuple(r)[:5] for r in suffixes.without_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_repeated_bytes_of_nasty_rows(nasty):
    check_removal(nasty)


def test_repeated_bytes_of_documents(small):
    check_removal(small)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_bytes_of_spliced_texts(spark, seed, monkeypatch):
    """Passages of every length around the limit, overlapping, inside one text and between texts, few letters."""
    rng = random.Random(seed)
    letters = "ab" if seed == 2 else "abcdefgh "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [make(n) for n in (399, 400, 401, 450, 655, 656, 900, 2000)]
    texts = []
    for _ in range(40):
        t = make(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 100)
            t += p[a : len(p) - rng.randint(0, 100)] + make(rng.randint(0, 30))
        texts.append(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_removal(docs)


def test_range_ends_are_compared(spark):
    """One passage in all texts and more ranges than distinct suffixes: equal suffixes lie in several ranges."""
    rng = random.Random(4)
    common = "".join(rng.choice("abcdef") for _ in range(700))
    texts = [("%03d" % n) * rng.randint(0, 9) + common for n in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        check_removal(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_texts_are_looked_through_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 1000)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdef") for _ in range(6000))
    raw = [t.encode() for t in (base, base[:2500] + "x" + base[2500:])]
    text, p, a, b = suffixes.all_runs(raw)
    for n, r in enumerate(raw):
        covered = sorted(s for x, y in zip(a[text == n], b[text == n], strict=True) for s in range(x, y + 1))
        assert covered == list(range(len(r) - suffixes.LENGTH + 1))


def test_no_rows(no_rows):
    assert suffixes.without_repeats(no_rows).count() == 0
    assert exact.exact_duplicates(no_rows).count() == 0
    assert exact.first_of_each(no_rows).count() == 0
    assert simhash.near_duplicates(no_rows).count() == 0
    assert simhash.one_of_each(no_rows).count() == 0


def exact_by_brute_force(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("name", ["nasty", "small"])
def test_exact_duplicates(request, name):
    docs = request.getfixturevalue(name)
    want = exact_by_brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, exact.exact_duplicates(docs).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["nasty", "small"])
def test_first_of_each_keeps_one_whole_row_a_text(request, name):
    docs = request.getfixturevalue(name)
    kept = exact.first_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = {}
    for i, keep, *_, digest in exact_by_brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()]):
        want[digest] = keep
    got = {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest(): r["doc_id"] for r in rows}
    assert got == want and len(rows) == len(want)


def fingerprint_by_brute_force(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_brute_force(rows, bits=4):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(known) if known else None
    return [(doc_id, f"{fp:016x}", least[find(i)]) for i, (doc_id, fp) in enumerate(rows)]


@pytest.mark.parametrize("name", ["nasty", "small"])
def test_near_duplicates(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], fingerprint_by_brute_force(r["text"])) for r in docs.collect()]
    want = components_by_brute_force(rows)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == sorted(want, key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({w[2] for w in want})


@pytest.mark.parametrize("long_list", [2048, 3, 1])
@pytest.mark.parametrize("bits", [4, 3])
def test_links_span_the_components_whatever_the_lists(spark, long_list, bits):
    rng = random.Random(bits)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(12):
            fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = [simhash.signed(f) for f in sorted(fps)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, long_list)
    for e in edges.collect() if long_list == 2048 else []:
        assert bin((e["a"] ^ e["b"]) & (1 << 64) - 1).count("1") <= bits
    roots = {r["node"]: r["root"] for r in smallest_reachable(edges).collect()}
    got = defaultdict(set)
    for f in signed:
        got[roots.get(f, f)].add(f)
    want = defaultdict(set)
    for n, (_, fp, root) in enumerate(components_by_brute_force(list(enumerate(sorted(fps))), bits)):
        want[root].add(simhash.signed(int(fp, 16)))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_the_filter_passes_every_list(spark):
    rng = random.Random(5)
    fps = spark.createDataFrame([(simhash.signed(rng.getrandbits(64)),) for _ in range(500)] + [(0,), (-1,)], "fp long")
    lists = simhash.index(fps)
    some = lists.filter("choice % 3 = 0")
    passed = {tuple(r) for r in simhash.index_if_likely(fps, simhash.marks(some)).collect()}
    assert {tuple(r) for r in some.collect()} <= passed <= {tuple(r) for r in lists.collect()}
    assert len(passed) < 0.4 * lists.count()


def test_chains_and_hubs_reach_the_smallest_node(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
