"""The corpus pipeline against a brute-force version of each stage on what its predecessor kept."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_near_copies import kept_by_brute_force
from test_removal import exact_by_brute_force
from tokenizers import Tokenizer

import corpus_pipeline
from trackloom.llm import mixing, near_copies, quality, queries, simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each one."""
    out, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    out.append(docs)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_all_but_the_last_stage_return_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes and df.count() > 0


def test_quality_stage(spark, stages):
    weights, prior = quality.fit_evidence(stages[0], queries.labels(spark, DATA))
    rows = stages[0].collect()
    llr = [float(np.clip(quality.features(r["text"] or "").astype(float) @ weights[:-1] + weights[-1] - prior, -20, 20)) for r in rows]
    p = [1 / (1 + math.exp(-(x + prior))) for x in llr]
    sites, hosts = defaultdict(list), defaultdict(list)
    for r, x in zip(rows, p, strict=True):
        sites[r["source"], r["lang"]].append(x)
        hosts[r["source"]].append(x)
    whole = sum(p) / len(p)

    def strength(groups):
        within = sum(m * (1 - m) * len(g) for g, m in groups)
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in groups)
        n = sum(len(g) for g, _ in groups)
        excess = (between - len(groups) * within / n) / n
        return min(max(within / n / excess - 1, 2), 1000) if excess > 0 else 1000

    k = strength([(g, whole) for g in hosts.values()])
    host = {h: (sum(g) + k * whole) / (len(g) + k) for h, g in hosts.items()}
    k = strength([(g, host[s[0]]) for s, g in sites.items()])
    path = {s: (sum(g) + k * host[s[0]]) / (len(g) + k) for s, g in sites.items()}
    odds = lambda m: math.log(m / (1 - m))
    want = {r["doc_id"] for r, x in zip(rows, llr, strict=True) if x + odds(path[r["source"], r["lang"]]) >= 0}
    assert {r["doc_id"] for r in stages[1].collect()} == want


def test_exact_and_near_stages(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert {r["doc_id"] for r in stages[2].collect()} == {x[0] for x in exact_by_brute_force(rows) if x[3]}
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert {r["doc_id"] for r in stages[3].collect()} == kept_by_brute_force(rows)


def poisson(mean, seed):
    parts = max(1, math.ceil(mean / mixing.PART_RATE))
    total = 0
    for n in range(parts):
        u = int(hashlib.md5(f"{seed}:{n}".encode()).hexdigest()[:13], 16) / 2**52
        term = below = math.exp(-mean / parts)
        k = 0
        while below <= u:
            k += 1
            term *= mean / parts / k
            below += term
        total += k
    return total


def test_mixing_stage(stages):
    rows = stages[3].collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"] or "") + 1
    wanted = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    rate = {s: mixing.EPOCHS * sum(size.values()) * wanted[s] / sum(wanted.values()) / n for s, n in size.items()}
    want = Counter({r["doc_id"]: poisson(rate[r["source"]], f"{mixing.SEED}:{r['doc_id']}") for r in rows})
    assert Counter(r["doc_id"] for r in stages[4].collect()) == +want


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    copies = Counter(r["doc_id"] for r in stages[4].collect())
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in stages[4].collect()}
    covered = Counter()
    for p in stages[5].collect():
        piece = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(piece.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        covered[p["doc_id"]] += p["length"]
    assert covered == Counter({d: n * len(ids[d]) for d, n in copies.items()})


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    tokens = lambda df: df.selectExpr("sum(length)").first()[0]
    assert got.columns == stages[-1].columns and tokens(got) == tokens(stages[-1])


def test_near_stage_links_by_fingerprints_too(spark):
    """A repeated phrase decides the fingerprint, though hardly any of the shingles are shared; the third text only shares shingles."""
    unique = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    phrase = "one two three four five six seven " * 60
    chain = f"{phrase}{unique('b', 40)}"
    rows = [(1, phrase + unique("a", 40)), (2, chain), (3, chain + " end"), (4, unique("c", 60)), (5, unique("d", 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits = [simhash.fingerprint(t) for _, t in rows]
    assert (bits[0] ^ bits[1]).bit_count() <= simhash.MAX_BITS
    assert near_copies.likeness(near_copies.shingle_set(rows[0][1]), near_copies.shingle_set(rows[1][1])) < 0.5
    assert sorted(r["doc_id"] for r in corpus_pipeline.dissimilar(spark, docs, DATA).collect()) == [1, 4, 5]
