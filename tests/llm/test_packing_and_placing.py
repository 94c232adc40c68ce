"""Packing, sharding and mixing."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm import mixing, packing, queries, sharding

PATH = public_tokenizers.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def plain_tokenizer():
    return Tokenizer.from_file(PATH)


def check_pieces(docs, plain_tokenizer, capacity=packing.CAPACITY):
    """Each id of each document lies in exactly one piece, sequences are gapless and within capacity; returns pad share."""
    pieces = packing.packed(docs, PATH, capacity).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*plain_tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID]
        want[r["doc_id"], len(ids)] += 1
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(np.array([*plain_tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID], "<u4"))
    covered, sequences = Counter(), defaultdict(list)
    for p in pieces:
        fits = [t for t in texts[p["doc_id"]] if len(t) == p["doc_tokens"] and zlib.crc32(t[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]]
        assert fits
        covered[p["doc_id"], p["doc_tokens"]] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert covered == Counter({k: k[1] * n for k, n in want.items()})
    padding = total = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(total, 1)


def test_pieces_of_documents(small, plain_tokenizer):
    assert check_pieces(small.coalesce(1), plain_tokenizer) < 0.05


def test_pieces_of_nasty_rows(nasty, plain_tokenizer):
    check_pieces(nasty, plain_tokenizer)
    check_pieces(nasty, plain_tokenizer, capacity=64)


def test_blocks_join_without_a_seam(small, plain_tokenizer, monkeypatch):
    """Whatever the size of a block, every id is packed once and in order."""
    words = packing.WordTokenizer.at(PATH)
    stream = packing.Stream(words.ends_sentence, 0, 256)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 40_000, rng.integers(0, 900)).astype(np.uint16) for _ in range(60)]
    rows = []
    for n, ids in enumerate(docs):
        stream.add(n, ids)
        for batch in stream.pack(last=False) if n % 3 == 0 else ():
            rows += batch.to_pylist()
    for batch in stream.pack(last=True):
        rows += batch.to_pylist()
    got = [(r["doc_id"], r["start"], r["length"]) for r in rows]
    want_at = 0
    for doc, start, length in got:
        assert (doc, start) == (want_doc, want_at) if want_at else start == 0
        want_doc, want_at = (doc, start + length) if start + length < len(docs[doc]) + 1 else (doc, 0)
    assert sum(x[2] for x in got) == sum(len(d) + 1 for d in docs)
    ids = [r["sequence_id"] for r in rows]
    assert ids == sorted(ids) and set(ids) == set(range(max(ids) + 1))


def cheapest(positions, penalties, capacity):
    best = [0.0] + [float("inf")] * (len(positions) - 1)
    for j in range(1, len(positions)):
        for i in range(j):
            size = positions[j] - positions[i]
            if size <= capacity:
                pad = 0 if size & (size - 1) == 0 else capacity - size
                best[j] = min(best[j], best[i] + pad + penalties[j])
    return best[-1]


@pytest.mark.parametrize("seed", range(8))
def test_cuts_cost_the_least(seed):
    rng = random.Random(seed)
    positions = np.cumsum([0] + [rng.randint(1, 30) for _ in range(80)])
    penalties = np.array([rng.choice([0, 5, 20]) for _ in positions])
    cuts = packing.best_cuts(positions, penalties, 64)
    cost, before = 0, 0
    for c in cuts:
        size = positions[c] - positions[before]
        assert size <= 64
        cost += (0 if size & (size - 1) == 0 else 64 - size) + penalties[c]
        before = c
    assert before == len(positions) - 1 and cost == cheapest(positions.tolist(), penalties.tolist(), 64)


def test_words_give_the_ids_of_whole_texts(small, plain_tokenizer):
    texts = ["Hello, World! It's  'RE\tfine…", "É éa ÄÖ ΑΣ. İ x y z \x1c\x85 <|endoftext|>", "a.b.c 12 34,5 don't.", "́start ́", "", " \n "]
    texts += ["".join(random.Random(n).choices("aB.,'é́ \n\t1!sİΣ", k=60)) for n in range(200)]
    texts += ["".join(random.Random(n).choices("aBZz.,_-*#é ñÜ \n1²ªµ½ŉ\x00£ß", k=60)) for n in range(300)]
    texts += [r["text"] for r in small.filter("lang <> 'en'").limit(40).collect()]
    texts += ["hello <|endoftext|> world", "a<|startoftext|>B<|endoftext|>", "<|ENDOFTEXT|> É<|endoftext|>é", "<|EndOfText|>", "<|endoftext|", "x\n<|endoftext|>\ty"]
    words = packing.WordTokenizer.at(PATH)
    assert [words.encode(t).tolist() for t in texts] == [plain_tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def by_definition(shards, slots):
    """The table as described: in turn, each shard takes the first free slot of its own permutation."""
    lists = []
    for s in shards:
        offset, skip = sharding.preferences(s, slots)
        lists.append([(offset + j * skip) % slots for j in range(slots)])
    table, turn = [None] * slots, 0
    while None in table:
        k = turn % len(shards)
        table[next(x for x in lists[k] if table[x] is None)] = k
        turn += 1
    return table


def test_lookup_table():
    shards = sharding.default_shards(7)
    assert sharding.lookup_table(shards, 101) == by_definition(shards, 101)
    table = sharding.lookup_table(sharding.default_shards())
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1
    fewer = sharding.lookup_table(sharding.default_shards()[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True)) / len(table)
    assert moved < 0.12  # little more than the share of the shard that went
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_placing_nasty_rows(nasty, no_rows, tmp_path):
    rows = sharding.placed(nasty).collect()
    assert len(rows) == nasty.count() and all(r["shard"] for r in rows)
    assert sharding.placed(no_rows).count() == 0
    sharding.write_shards(nasty, str(tmp_path / "out"), files_per_shard=2)
    back = nasty.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == nasty.count()


def test_mean_and_spread_of_copies(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"))
    for rate in (0.3, 2.5, 150.0):
        n = ids.select(mixing.poisson_count(F.lit(rate), F.concat(F.lit("9:"), F.col("doc_id").cast("string"))).alias("n"))
        mean, spread = n.agg(F.avg("n"), F.variance("n")).first()
        assert abs(mean - rate) < 5 * (rate / 40_000) ** 0.5 and abs(spread / rate - 1) < 0.05


def test_sources_reach_their_weights(spark):
    rows = [(n, "x" * 99, "big" if n % 10 else "small") for n in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.replicated(docs, weights={"big": 0.5, "small": 0.5})
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(counts["small"] / counts["big"] - 1) < 0.05


def test_mixing_nasty_rows(nasty, no_rows):
    out = mixing.replicated(nasty, epochs=3.0)
    assert set(nasty.columns) < set(out.columns)
    rows = out.collect()
    assert {r["source"] for r in rows} <= {"src0", None} and len(rows) > 20
    per = defaultdict(set)
    for r in rows:
        per[r["doc_id"]].add(r["n_copies"])
    assert all(len(v) == 1 for k, v in per.items() if k not in (None, 3))
    assert mixing.replicated(no_rows).count() == 0
    placed = [r["position"] for r in mixing.shuffled(out).collect()]
    assert placed == sorted(placed)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    names = [d[0] for d in want.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in want.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_clashing_names_keep_their_values(spark, nasty, no_rows, tmp_path):
    docs = nasty.selectExpr("*", "'mine' as shard", "7 as copy", "1.5 as rate", "'p' as position", "0 as slot")
    mixed = mixing.mixture(docs, epochs=2.0)
    assert mixed.columns == docs.columns
    assert {(r["shard"], r["copy"], float(r["rate"]), r["position"]) for r in mixed.collect()} == {("mine", 7, 1.5, "p")}
    dealt = sharding.write_shards(docs, str(tmp_path / "a"))
    assert dealt.columns == [*docs.columns, "slot_1", "shard_1"]
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, dealt.select(*docs.columns).collect())) == sorted(map(key, docs.collect()))
    assert {r["shard"] for r in dealt.collect()} == {"mine"}
    want = {(r["doc_id"], r["slot"], r["shard"]) for r in sharding.placed(nasty).collect()}
    assert {(r["doc_id"], r["slot_1"], r["shard_1"]) for r in dealt.collect()} == want
    assert sharding.write_shards(no_rows, str(tmp_path / "b")).count() == 0
