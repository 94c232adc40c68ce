"""The languages of a text as a mixture, from n-gram likelihoods.

Grams are three code points in lower case around each letter, everything that is no letter being a blank; they are kept
as they are, 21 bits a code point.  Each language is a multinomial over the grams that are frequent in some language and
one symbol for all others, counted over all training texts.  A document is a mixture of languages.  It starts with the one
that explains it best; the language whose share would raise the likelihood fastest is added, the shares are estimated by
expectation-maximisation, and the larger set stays if the gain is over a penalty of half the logarithm of the sample size.
Neighbouring grams share letters, so a sample of n grams counts as n / ``OVERLAP``.  The likelihood is concave in the shares,
so no set can gain more than the steepest slope: where that is below the penalty, the estimate is left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, modest_batches, per_block, settle, texts_of

OVERLAP = 3
SMOOTHING = 0.5
#: A gram is kept if it makes up this share of some language, or more where there are so many languages that the table of
#: probabilities could have over ``CELLS`` cells: at most languages / share grams reach the share.
LEAST_SHARE = 1e-5
CELLS = 1 << 24
ROUNDS = 40
SETTLED = 1e-4
#: Characters looked at together; a longer text is counted piece by piece.
PIECE = 1 << 20
#: Counts that a task gathers before it hands them on.
GATHERED = 1 << 20


@cache
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str], before: list[bool] | None = None, after: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The gram around each letter of texts in lower case, and the place in ``texts`` of its text.

    The first character of a text with ``before`` and the last one of a text with ``after`` are neighbours only.
    """
    # a blank on both sides of each text
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counted = letters()[points]
    points = np.where(counted, points, 0).astype(np.int64)
    if before:
        counted[(ends - [len(t) for t in texts])[np.array(before)]] = False
        counted[(ends - 1)[np.array(after)]] = False
    at = np.flatnonzero(counted)
    return points[at - 1] << 42 | points[at] << 21 | points[at + 1], np.searchsorted(ends, at - 1, side="right")


def grams_by_piece(texts: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams of all texts and the places of their texts, for about ``size`` characters at a time; longer texts come in parts."""
    group, held = [], 0
    for n, text in enumerate(map(str.lower, texts)):
        for at in range(0, max(len(text), 1), size):
            part = text[max(at - 1, 0) : at + size + 1]
            group.append((part, at > 0, at + size < len(text), n))
            held += len(part)
            if held >= size:
                yield of_group(group)
                group, held = [], 0
    if group:
        yield of_group(group)


def of_group(group: list[tuple[str, bool, bool, int]]) -> tuple[np.ndarray, np.ndarray]:
    parts, before, after, places = zip(*group, strict=True)
    keys, part = grams(parts, before, after)
    return keys, np.array(places)[part]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n of rows (text, lang), counted over all of them."""

    def gathered(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0
        for batch in batches:
            for block in cut(batch, PIECE):
                langs = block.column("lang").to_pylist()
                texts = texts_of(block)
                for lang in set(langs):
                    for keys, _ in grams_by_piece([t for t, x in zip(texts, langs, strict=True) if x == lang], PIECE):
                        found = np.unique(keys, return_counts=True)
                        held[lang].append(found)
                        size += len(found[0])
                if size > GATHERED:
                    yield from gathered(held)
                    held, size = defaultdict(list), 0
        yield from gathered(held)

    modest_batches(rows.sparkSession)
    counted = rows.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # in order
    log_p: np.ndarray  # grams and the symbol for all others x languages
    log_prior: np.ndarray

    def counts(self, texts: list[str], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the text, symbol, and how often it occurs there; in the order of the texts."""
        parts = []
        width = len(self.grams) + 1
        for keys, text in grams_by_piece(texts, piece):
            at = np.searchsorted(self.grams, keys)
            known = self.grams[np.minimum(at, len(self.grams) - 1)] == keys if len(self.grams) else np.zeros(len(keys), bool)
            parts.append(np.unique(text * width + np.where(known, at, width - 1), return_counts=True))
        keys, n = summed(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
        return keys // width, keys % width, n

    def shares(self, texts: list[str]) -> np.ndarray:
        """texts x languages: the share of each language, 0 outside of the chosen set; no letters: all 0."""
        return mixtures(*self.counts(texts), len(texts), self.log_p, self.log_prior)


def penalty(n: np.ndarray) -> np.ndarray:
    """What one more language must gain in log likelihood of overlapping grams."""
    return OVERLAP * 0.5 * np.log(n / OVERLAP + np.e)


def per_text(values: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Sums over the rows of each text; ``text`` is in order."""
    out = np.zeros((n_texts, *values.shape[1:]))
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.empty(0, np.int64)
    if len(first):
        out[text[first]] = np.add.reduceat(values, first, axis=0)
    return out


def mixtures(text: np.ndarray, symbol: np.ndarray, n: np.ndarray, n_texts: int, log_p: np.ndarray, log_prior: np.ndarray) -> np.ndarray:
    """Shares of the chosen languages of each text, from the counts of its symbols."""
    n_langs = log_p.shape[1]
    shares = np.zeros((n_texts, n_langs))
    size = per_text(n.astype(float), text, n_texts)
    growing = np.flatnonzero(size > 0)
    if not n_langs or not len(growing):
        return shares
    alone = per_text(log_p[symbol] * n[:, None], text, n_texts)
    best = np.argmax(alone + log_prior, axis=1)
    shares[growing, best[growing]] = 1.0
    reached = alone[np.arange(n_texts), best]
    rest = text, symbol, n
    while len(growing):
        rows = np.isin(text, growing)
        text, symbol, n = text[rows], symbol[rows], n[rows]
        p = np.exp(log_p[symbol])
        slope = per_text(p * (n / (p * shares[text]).sum(axis=1))[:, None], text, n_texts) - size[:, None]
        slope[shares > 0] = -np.inf
        added = np.argmax(slope, axis=1)
        growing = growing[slope[growing, added[growing]] > penalty(size[growing])]
        if not len(growing):
            break
        rows = np.isin(text, growing)
        tried = shares.copy()
        tried[growing] *= 0.8
        tried[growing, added[growing]] = 0.2
        gained = estimated(text[rows], n[rows], p[rows], tried, size, growing)
        growing = growing[gained[growing] - reached[growing] > penalty(size[growing])]
        shares[growing], reached[growing] = tried[growing], gained[growing]
    # of three and more, an early one may be explained by the later ones
    text, symbol, n = rest
    shrinking = np.flatnonzero((shares > 0).sum(axis=1) > 2)
    while len(shrinking):
        rows = np.isin(text, shrinking)
        text, symbol, n = text[rows], symbol[rows], n[rows]
        dropped = np.argmin(np.where(shares > 0, shares, np.inf), axis=1)
        tried = shares.copy()
        tried[shrinking, dropped[shrinking]] = 0
        tried[shrinking] /= tried[shrinking].sum(axis=1, keepdims=True)
        left = estimated(text, n, np.exp(log_p[symbol]), tried, size, shrinking)
        shrinking = shrinking[reached[shrinking] - left[shrinking] < penalty(size[shrinking])]
        shares[shrinking], reached[shrinking] = tried[shrinking], left[shrinking]
        shrinking = shrinking[(shares[shrinking] > 0).sum(axis=1) > 2]
    return shares


def estimated(text: np.ndarray, n: np.ndarray, p: np.ndarray, shares: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Improves the shares of the chosen texts in place by expectation-maximisation; the log likelihood they reach, per text."""
    for _ in range(ROUNDS):
        parts = p * shares[text]
        parts *= (n / parts.sum(axis=1))[:, None]
        following = per_text(parts, text, len(shares))[chosen] / size[chosen, None]
        moved = np.abs(following - shares[chosen]).max()
        shares[chosen] = following
        if moved < SETTLED:
            break
    return per_text(n * np.log((p * shares[text]).sum(axis=1)), text, len(shares))


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame) -> Model:
    """The model of all training rows with a language.  The driver sees a row per language and the kept grams."""
    rows = docs.select("doc_id", "text", "lang").filter(in_training(F.col("doc_id")) & F.col("lang").isNotNull())
    known = rows.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("documents")).orderBy("lang").collect()
    languages = [r["lang"] for r in known]
    number = {x: n for n, x in enumerate(languages)}
    counts = settle(gram_counts(rows), "gram_counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    total = np.zeros(len(languages))
    for r in totals.collect():
        total[number[r["lang"]]] = r["total"]
    least = max(LEAST_SHARE, len(languages) ** 2 / CELLS)
    frequent = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= least * F.col("total")).select("gram").distinct()
    kept = counts.join(frequent, "gram").toPandas()
    found, place = np.unique(kept["gram"].to_numpy(np.int64), return_inverse=True)
    table = np.zeros((len(found) + 1, len(languages)))
    table[place, [number[x] for x in kept["lang"]]] = kept["n"].to_numpy(float)
    table[-1] = total - table.sum(axis=0)
    log_p = np.log((table + SMOOTHING) / (total + SMOOTHING * len(table)))
    prior = np.array([r["documents"] for r in known], float)
    return Model(languages, found, log_p.astype(np.float32), np.log(prior / prior.sum()) if len(prior) else prior)


def mixed_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, languages: array of (lang, share) by falling share, then name; empty for texts without a letter."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for shares in model.shares(texts_of(batch)):
            order = sorted(np.flatnonzero(shares), key=lambda k: (-shares[k], model.languages[k]))
            rows.append([{"lang": model.languages[k], "share": min(1.0, float(shares[k]))} for k in order])
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return pa.record_batch([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "languages"])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_block(taken, of, "doc_id long, languages array<struct<lang:string,share:double>>", block_bytes=PIECE)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred (the language with the largest share), score (that share), languages (all shares), per row.

    Held-out rows are never learned from; a null doc_id is held out.  Null, empty and letterless texts are ``und`` with score
    0, and so is every text if no row has a language to learn from.  A very long text is counted piece by piece and judged as
    a whole.  Equal shares go by the name of the language.  Repeated rows give a row each; further columns are ignored; no
    rows give no rows.
    """
    held_out = ~F.coalesce(in_training(F.col("doc_id")), F.lit(False))
    first = F.get(F.col("languages"), 0)
    return mixed_languages(docs, fit(docs)).select(
        "doc_id", held_out.alias("held_out"), F.coalesce(first["lang"], F.lit("und")).alias("lang_pred"),
        F.coalesce(first["share"], F.lit(0.0)).alias("score"), "languages",
    )
