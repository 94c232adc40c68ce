"""Toxic passages as maximum-scoring segments of token log odds.

Words are counted one by one under 64-bit hashes, by a grouped sum on Spark.  The log odds of a word between toxic and other
labelled documents have a Dirichlet prior proportional to the counts of both together, and are shrunk to zero by ``CAUTION``
standard deviations, so rare words say nothing.  Only words that keep log odds other than zero go to the driver and the tasks;
all others score zero.  ``DRIFT`` is subtracted from every token.  One scan in linear time finds all maximal segments of a text.  By
extreme-value theory a segment of score s in n tokens is expected K n exp(-lambda s) times by chance: lambda solves
sum p exp(lambda s) = 1 over the tokens of clean documents, K comes from their best segments.  The significance of a
document's segments adds up, and a logistic fit on labelled documents turns the sum into the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import per_block, settle, texts_of
from trackloom.llm.quality import fit_logistic

PRIOR = 2.0
CAUTION = 2.0
DRIFT = 0.25
#: Segments expected less often than this by chance in a document are significant.
EXPECTED = 0.05
#: The last fit reads at most this many labelled documents, the first ones in the order of a hash of their id.
FIT_ROWS = 20_000
REMEMBERED = 150_000
STRIP = b".,;:!?\"'()[]{}*#$%&|<>/\\-_`~^+="


class Hashes(dict):
    """The hash of each word that was asked for, marks at its ends cut off."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.strip(STRIP), 0)
        return found


_hashes = Hashes()


def token_hashes(text: str) -> np.ndarray:
    """The hash of each word, in lower case, as a signed long."""
    found = [*map(_hashes.__getitem__, text.lower().encode("utf-8", "surrogatepass").split())]
    return np.array(found, np.uint64).view(np.int64)


@dataclass
class Model:
    words: np.ndarray  # in order
    odds: np.ndarray
    decay: float
    scale: float
    fit: np.ndarray

    def of(self, text: str) -> np.ndarray:
        """The log odds of each word of a text."""
        hashes = token_hashes(text)
        if not len(self.words):
            return np.zeros(len(hashes))
        at = np.searchsorted(self.words, hashes).clip(max=len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.odds[at], 0.0)


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 != 0


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic outside the held-out fold."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    return known.filter(in_training(F.col("doc_id"))).distinct()


def word_counts(rows: DataFrame) -> DataFrame:
    """word, clean, toxic over all rows: labelled documents with a word; the null word counts the documents."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, ns = [], []
        of_label = np.array(batch.column("toxic").to_pylist(), np.int64)
        texts = texts_of(batch)
        for y in (0, 1):
            found = [np.unique(token_hashes(t)) for t, label in zip(texts, of_label.tolist(), strict=True) if label == y]
            w, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
            words.append(w)
            ns.append(n)
        word = pa.array([*np.concatenate(words).tolist(), None, None], pa.int64())
        clean = pa.array([*ns[0].tolist(), *[0] * len(ns[1]), len(of_label) - int(of_label.sum()), 0], pa.int64())
        toxic = pa.array([*[0] * len(ns[0]), *ns[1].tolist(), 0, int(of_label.sum())], pa.int64())
        return pa.record_batch([word, clean, toxic], ["word", "clean", "toxic"])

    found = per_block(rows.select("text", "toxic"), of, "word long, clean long, toxic long", block_bytes=16 << 20)
    return found.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_odds(seen: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Shrunken log odds from (2, words) documents with a word and (2,) documents, clean ones first."""
    if not docs.all():
        return np.zeros(seen.shape[1])
    share = (seen.sum(axis=0) + 0.5) / (docs.sum() + 1)
    prior = PRIOR * np.vstack([share, share]) + 0.25
    have = seen + prior
    rest = docs[:, None] - seen + PRIOR * (1 - share) + 0.25
    delta = np.log(have[1] / rest[1]) - np.log(have[0] / rest[0])
    spread = np.sqrt((1 / have + 1 / rest).sum(axis=0))
    return np.sign(delta) * np.maximum(np.abs(delta) - CAUTION * spread, 0)


def marked_words(counts: DataFrame, docs: np.ndarray) -> DataFrame:
    """word, clean, odds of the words whose shrunken log odds are not zero."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = batch.column("clean").to_numpy().astype(float)
        odds = log_odds(np.vstack([clean, batch.column("toxic").to_numpy().astype(float)]), docs)
        return pa.record_batch([batch.column("word"), batch.column("clean"), pa.array(odds)], ["word", "clean", "odds"]).filter(pa.array(odds != 0))

    return per_block(counts.filter("word is not null"), of, "word long, clean long, odds double")


def chance_decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum weights * exp(lambda * scores) = 1; 1 where no score is positive or the mean isn't negative."""
    weights = weights / max(weights.sum(), 1e-9)
    if not (weights[scores > 0].sum() > 0 and (weights * scores).sum() < 0):
        return 1.0
    low, high = 0.0, 1.0
    value = lambda k: (weights * np.exp(np.minimum(k * scores, 500))).sum()
    while value(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return max(high, 1e-3)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in one pass with a stack of candidates."""
    found: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum up to the end
    lower: list[int] = []  # for each candidate the nearest one before it with a smaller sum before, or -1
    places = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for at in places.tolist():
        begin, end, before, upto = at, at + 1, float(sums[at]), float(sums[at + 1])
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= before:
                k = lower[k]
            if k < 0 or found[k][3] >= upto:
                break
            begin, before = found[k][0], found[k][2]
            del found[k:], lower[k:]
        found.append((begin, end, before, upto))
        lower.append(k)
    return [(b, e, u - s) for b, e, s, u in found]


def significance(odds: np.ndarray, model: Model) -> tuple[float, float]:
    """Summed nats by which significant segments beat chance, and those of the best segment (0 if none is positive)."""
    parts = segments(odds - DRIFT)
    if not parts:
        return 0.0, 0.0
    chance = np.log(max(model.scale * len(odds), 1e-9))
    beats = [model.decay * s - chance for _, _, s in parts]
    return sum(max(0.0, b + np.log(EXPECTED)) for b in beats), max(0.0, max(beats))


def inputs(odds: np.ndarray, model: Model) -> list[float]:
    """What the last fit sees: summed and best significance, the sum of positive log odds, and the length."""
    total, best = significance(odds, model)
    return [min(total, 60.0) / 10, min(best, 30.0) / 10, min(float(odds[odds > 0].sum()), 60.0) / 10, float(len(odds) == 0), np.log1p(len(odds)) / 10]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Counts over all labelled training rows; the five last weights on a bounded sample of them.  No labels: all scores equal."""
    texts, known = docs.select("doc_id", "text"), training_labels(labels)
    # the labels grow with the documents, so both sides are dealt by id, whatever their size
    rows = texts.filter(in_training(F.col("doc_id"))).join(known.hint("merge"), "doc_id")
    counts = settle(word_counts(rows), "word_counts")
    total = counts.groupBy(F.col("word").isNull().alias("documents")).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    docs_seen = np.array([[r["clean"], r["toxic"]] for r in total if r["documents"]], float).reshape(-1, 2).sum(axis=0)
    words_seen = sum(r["clean"] for r in total if not r["documents"])
    marked = marked_words(counts, docs_seen).toPandas().sort_values("word")
    words, odds, clean = marked["word"].to_numpy(np.int64), marked["odds"].to_numpy(float), marked["clean"].to_numpy(float)
    # the words without a mark all score minus DRIFT
    scores, weights = np.append(odds, 0.0) - DRIFT, np.append(clean, words_seen - clean.sum())
    model = Model(words, odds, chance_decay(scores, weights), 1.0, np.zeros(6))
    if not docs_seen.all():
        return model
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    sample = settle(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic_sample")
    decay = model.decay

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.of(t) for t in texts_of(batch)]
        tops = [max((s for _, _, s in segments(o - DRIFT)), default=0.0) for o in found]
        return pa.record_batch([pa.array([len(o) for o in found]), pa.array(np.array(tops)), batch.column("toxic")], ["n", "top", "toxic"])

    tops = per_block(sample, best, "n long, top double, toxic int").toPandas()
    clean = tops[(tops["toxic"] == 0) & (tops["top"] > 0)]
    if len(clean):  # P(best < s) = exp(-K n exp(-lambda s)), so K n exp(-lambda s) is exponential with mean one
        model.scale = float(1 / np.mean(clean["n"] * np.exp(-decay * clean["top"])))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([inputs(model.of(t), model) for t in texts_of(batch)])
        return pa.record_batch([*[pa.array(made[:, i].copy()) for i in range(5)], batch.column("toxic")], [*"abcde", "toxic"])

    table = per_block(sample, of, "a double, b double, c double, d double, e double, toxic int").toPandas()
    if len(table):
        model.fit = fit_logistic(table[[*"abcde"]].to_numpy(), table["toxic"].to_numpy(float))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_passages (significant segments), per row.  Null texts are empty; rows repeat as they come."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        odds = [model.of(t) for t in texts_of(batch)]
        x = np.array([[*inputs(o, model), 1.0] for o in odds])
        score = 1 / (1 + np.exp(-np.clip(x @ model.fit, -30, 30)))
        return pa.record_batch([batch.column("doc_id"), pa.array(score), pa.array([len(significant(o, model)) for o in odds])], ["doc_id", "score", "n_passages"])

    return per_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, "doc_id long, score double, n_passages long")


def significant(odds: np.ndarray, model: Model) -> list[tuple[int, int, float]]:
    """Segments (first word, word after the last, expected number by chance) that are significant."""
    found = [(b, e, model.scale * len(odds) * np.exp(-model.decay * s)) for b, e, s in segments(odds - DRIFT)]
    return [x for x in found if x[2] <= EXPECTED]


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, first_word, end_word, expected, passage (its words)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            words = None
            for b, e, expected in significant(model.of(text), model):
                words = words or text.encode("utf-8", "surrogatepass").split()
                rows.append((doc_id, b, e, float(expected), b" ".join(words[b:e]).decode("utf-8", "replace")))
        names = ["doc_id", "first_word", "end_word", "expected", "passage"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_block(taken, of, "doc_id long, first_word long, end_word long, expected double, passage string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages per document; labels of the held-out fold are never read into the model.

    A null doc_id is held out.  No rows give no rows.
    """
    rows = scored(docs, fit(docs, labels))
    held_out = ~F.coalesce(in_training(F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
