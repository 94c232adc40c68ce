"""Languages: held-out accuracy, shares of made-up mixtures, and counts and estimates against plain Python."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from trackloom.llm import languages, queries


def grams_by_brute_force(text):
    s = "".join(c if c.isalpha() else "\0" for c in f"\0{text.lower()}\0")
    return Counter(ord(s[i - 1]) << 42 | ord(s[i]) << 21 | ord(s[i + 1]) for i in range(1, len(s) - 1) if s[i] != "\0")


@pytest.fixture(scope="module")
def tables(spark):
    return {sf: spark.read.parquet(f"/root/testdata/{sf}/documents.parquet") for sf in ("sf0.001", "sf0.01")}


def test_held_out_languages(spark, tables):
    got = queries.QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01").join(tables["sf0.01"].select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == tables["sf0.01"].count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97


def test_counts_are_exact(spark, tables):
    docs = tables["sf0.001"]
    want = {}
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"]:
            want.setdefault(r["lang"], Counter()).update(grams_by_brute_force(r["text"] or ""))
    rows = docs.filter(languages.in_training(languages.F.col("doc_id")) & docs["lang"].isNotNull())
    got = {(r["lang"], r["gram"]): r["n"] for r in languages.gram_counts(rows).collect()}
    assert got == {(lang, g): n for lang, c in want.items() for g, n in c.items()}


def test_grams_of_many_texts_and_of_pieces():
    texts = ["", "Ab c", "é\0İx", " - ", "ÀB" * 50, "a b " * 40, "z" * 7]
    keys, text = languages.grams([t.lower() for t in texts])
    for n, t in enumerate(texts):
        assert Counter(keys[text == n].tolist()) == grams_by_brute_force(t)
    model = languages.Model(["x"], np.unique(keys), np.zeros((len(np.unique(keys)) + 1, 1)), np.zeros(1))
    for size in (1, 2, 6, 50):
        assert all((a == b).all() for a, b in zip(model.counts(texts), model.counts(texts, size), strict=True))


def test_sets_of_languages_against_all_sets():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.full(40, 0.3), 4).T + 1e-4
    p /= p.sum(axis=0)
    texts, symbols, counts = [], [], []
    truth = [rng.dirichlet(np.full(4, 0.3)) for _ in range(40)]
    for t, share in enumerate(truth):
        x = rng.multinomial(600, p @ share)
        texts += [t] * int((x > 0).sum())
        symbols += np.flatnonzero(x).tolist()
        counts += x[x > 0].tolist()
    text, symbol, n = map(np.array, (texts, symbols, counts))
    got = languages.mixtures(text, symbol, n, len(truth) + 1, np.log(p), np.zeros(4))
    assert not got[-1].any()
    cost = float(languages.penalty(np.array([600.0]))[0])
    same = 0
    for t, share in enumerate(truth):
        mine = text == t
        best = (-math.inf, None)
        for size in range(1, 5):
            for chosen in combinations(range(4), size):
                w = np.full(size, 1 / size)
                q = p[np.ix_(symbol[mine], chosen)]
                for _ in range(300):
                    r = q * w
                    w = ((r / r.sum(axis=1, keepdims=True)) * n[mine][:, None]).sum(axis=0) / n[mine].sum()
                value = float((n[mine] * np.log(q @ w)).sum()) - cost * size
                best = max(best, (value, chosen))
        same += set(np.flatnonzero(got[t])) == set(best[1])
        assert abs(got[t].sum() - 1) < 1e-6 and np.argmax(got[t]) == np.argmax(share) or share.max() - np.sort(share)[-2] < 0.1
    assert same >= 39


def test_shares_of_two_languages(spark):
    rng = random.Random(2)
    words = {"aa": ["kato", "mil", "ruso", "tane"], "bb": ["thwex", "grynd", "blosh", "strix"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(n, text("ab"[n % 2] * 2, 60), "ab"[n % 2] * 2) for n in range(200)]
    rows += [(1000, text("aa", 150) + " " + text("bb", 50), None), (1001, text("bb", 4), None), (1002, "123 ...", None), (1003, None, "aa")]
    got = {r["doc_id"]: r for r in languages.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[n]["lang_pred"] == lang for n, _, lang in rows[:200])
    shares = {x["lang"]: x["share"] for x in got[1000]["languages"]}
    assert got[1000]["lang_pred"] == "aa" and abs(shares["bb"] - 0.3) < 0.1
    assert [got[n]["lang_pred"] for n in (1001, 1002, 1003)] == ["bb", "und", "und"]


def test_nasty_rows(spark, nasty, no_rows):
    got = languages.languages(nasty).collect()
    assert len(got) == nasty.count()
    texts = {r["doc_id"]: r["text"] for r in nasty.filter("doc_id is not null").collect() if r["doc_id"] != 3}
    for r in got:
        assert r["held_out"] or r["doc_id"] is not None
        if r["doc_id"] in texts:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
    assert languages.languages(no_rows).count() == 0
    unknown = languages.languages(nasty.withColumn("lang", languages.F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
