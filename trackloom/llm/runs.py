"""Periodic runs of words, from the maximal pairs of a text.

A maximal pair is two equal stretches of words that neither the word before nor the word after extends.  If their distance p
is at most half their length, the stretch from the first begin to the second end repeats with period p and can't be
extended: it is a run already.  Of the distances of one stretch the smallest is its period.

The suffixes of a text are sorted by prefix doubling, and the tree of LCP intervals is read bottom-up from the sorted order.
Every interval keeps the begins seen so far in text order, each with the class of its left word; the smaller list looks its
partners up in the larger one and is then merged into it.  Begins of one interval within half its depth lie at multiples of
one period, so all but the first of them have the same left word.  One look at the first begin in reach therefore decides for
all that come before, and one at the next begin for all that follow: nothing is listed that is no maximal pair.

Texts without two equal stretches of the least length within reach are set aside by hashes first; a hash never decides more.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import per_block

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Fixed odd multipliers of the hashes.
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

Words = list[bytes]
Run = tuple[int, int, int]  # first word, length, period


def seed_length(min_length: int, min_exponent: int) -> int:
    """Words that the two stretches of a run share at least: its length less its period."""
    return -(-min_length * (min_exponent - 1) // min_exponent)


def may_repeat(codes: np.ndarray, sizes: np.ndarray, seed: int, min_exponent: int) -> np.ndarray:
    """Of each text, whether ``seed`` words seem to come again at a distance that a run of it can have."""
    out = np.zeros(len(sizes), bool)
    count = len(codes) - seed + 1
    if count < 1:
        return out
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * SPREAD
    mixed ^= mixed >> np.uint64(29)
    gram = np.zeros(count, np.uint64)
    for k in range(seed):
        gram = gram * STEP + mixed[k : k + count]
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(text[:count] == text[seed - 1 :])
    key = (gram[inside] ^ (text[inside].astype(np.uint64) * SPREAD)) * STEP
    order = np.argsort(key, kind="stable")
    key, at = key[order], inside[order]
    near = at[:-1][(key[:-1] == key[1:]) & (at[1:] - at[:-1] <= sizes[text[at[:-1]]] // min_exponent)]
    out[text[near]] = True
    return out


def doubled_ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of all stretches of 1, 2, 4, ... words, until they differ; equal ranks mean equal stretches.

    A rank is the number of smaller stretches, so the last ranks are places in the suffix array.
    """
    _, inverse, counts = np.unique(first, return_inverse=True, return_counts=True)
    ranks = [(np.cumsum(counts) - counts)[inverse]]
    open_at = np.flatnonzero(counts[inverse] > 1)
    width = 1
    while len(open_at):
        rank = ranks[-1]
        beyond = open_at + width
        other = np.where(beyond < len(rank), rank[np.minimum(beyond, len(rank) - 1)], -1)
        order = np.lexsort((other, rank[open_at]))
        at, mine, other = open_at[order], rank[open_at][order], other[order]
        new_group = np.append(True, mine[1:] != mine[:-1])
        new_part = new_group | np.append(True, other[1:] != other[:-1])
        place = np.arange(len(at))
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        part_at = np.maximum.accumulate(np.where(new_part, place, 0))
        following = rank.copy()
        following[at] = mine + part_at - group_at
        ranks.append(following)
        alone = new_part & np.append(new_part[1:], True)
        open_at = at[~alone]
        width *= 2
    return ranks


def shared_words(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common prefix of suffixes a[i] and b[i]."""
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        lcp += (ranks[level][a + lcp] == ranks[level][b + lcp]).astype(np.int64) << level
    return lcp


def maximal_pairs(suffixes: list[int], lcp: list[int], left: list[int], seed: int, min_length: int, min_exponent: int) -> dict[tuple[int, int], int]:
    """The smallest distance for each (begin, length) that a maximal pair covers; ``lcp[i]`` is between suffixes i and i + 1."""
    found: dict[tuple[int, int], int] = {}

    def pair(x: int, y: int, depth: int) -> None:
        key = (x, y - x + depth)
        if key[1] >= min_length and y - x < found.get(key, key[1]):
            found[key] = y - x

    def joined(a: list[int], b: list[int], depth: int) -> list[int]:
        large, small = (a, b) if len(a) >= len(b) else (b, a)
        reach = depth // (min_exponent - 1)
        for e in small:
            at = bisect_left(large, e - reach)
            if at < len(large) and large[at] < e and left[large[at]] != left[e]:
                pair(large[at], e, depth)
            at = bisect_right(large, e, at)
            if at < len(large) and left[large[at]] != left[e]:
                while at < len(large) and large[at] <= e + reach:
                    pair(e, large[at], depth)
                    at += 1
        for e in small:
            insort(large, e)
        return large

    stack: list[tuple[int, list[int]]] = []
    current = [suffixes[0]]
    for suffix, depth in zip(suffixes[1:] + [-1], lcp + [0], strict=True):
        while stack and stack[-1][0] > depth:
            deeper, held = stack.pop()
            current = joined(held, current, deeper)
        if depth >= seed:
            if stack and stack[-1][0] == depth:
                stack[-1] = (depth, joined(stack[-1][1], current, depth))
            else:
                stack.append((depth, current))
        current = [suffix]
    return found


def runs_of(texts: list[Words], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[Run]]:
    """The runs of each text by first word, then period.  Memory grows with the words of a text times the doublings it needs."""
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    number: dict[bytes, int] = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in texts]
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    seed = seed_length(min_length, min_exponent)
    chosen = np.flatnonzero(may_repeat(np.concatenate([*coded, np.empty(0, np.int64)]), sizes, seed, min_exponent))
    if not len(chosen):
        return out
    # a mark that occurs once ends each text, and words of different texts never agree
    parts = [np.append(coded[t], len(number)) + n * (len(number) + 1) for n, t in enumerate(chosen)]
    joined = np.concatenate(parts)
    begins = np.cumsum([0, *[len(p) for p in parts]])
    ranks = doubled_ranks(joined)
    level = min(seed.bit_length() - 1, len(ranks) - 1)
    _, inverse, counts = np.unique(ranks[level], return_inverse=True, return_counts=True)
    repeated = np.flatnonzero(counts[inverse] > 1)
    if not len(repeated):
        return out
    order = repeated[np.argsort(ranks[-1][repeated])]
    lcp = shared_words(order[:-1], order[1:], ranks)
    left = np.append(-1, joined[:-1]).tolist()
    for (begin, length), period in maximal_pairs(order.tolist(), lcp.tolist(), left, seed, min_length, min_exponent).items():
        n = int(np.searchsorted(begins, begin, side="right")) - 1
        out[chosen[n]].append((begin - int(begins[n]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: Words, runs: list[Run]) -> Words:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for begin, length, period in runs:
        kept[begin + period : begin + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def without_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    rewrite: Callable[[int | None, Words], Words] | None = None,
) -> DataFrame:
    """doc_id, runs (first word, length, period; by first word, then period), kept_text (what is left, by single spaces), per row.

    Words are stretches without ASCII white space, compared byte by byte.  ``rewrite`` changes the words of a document first.
    Null, empty and blank texts have no words, no runs and an empty kept_text; a null doc_id stays null.  Repeated rows give a
    row each, further columns of any name are ignored, no rows give no rows.  A very long text is one piece of work, whose time
    is that of sorting its suffixes; runs that share their first word are in the order of their periods.
    """

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        texts = [t.split() for t in batch.column("text").to_pylist()]
        if rewrite:
            texts = [rewrite(d, words) for d, words in zip(ids, texts, strict=True)]
        found = runs_of(texts, min_length, min_exponent)
        kept = pa.array([b" ".join(kept_words(w, r)) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        return pa.record_batch([batch.column("doc_id"), pa.array(rows, kind), kept], ["doc_id", "runs", "kept_text"])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return per_block(taken, of, "doc_id long, runs array<struct<start:long,length:long,period:long>>, kept_text string")


def made_periodic(doc_id: int | None, words: Words) -> Words:
    """The words of every tenth document by a hash of its id, from some word on repeated with a period; a null id changes nothing."""
    code = zlib.crc32(str(doc_id).encode())
    if doc_id is None or code % 10 or not words:
        return words
    g = code // 10
    begin = g % len(words)
    period = 1 + (len(words) - begin) // (3 + g % 8)
    again = words[begin : begin + period]
    return words[:begin] + (again * ((len(words) - begin) // len(again) + 1))[: len(words) - begin]


def greatest(runs: Column) -> Column:
    """The run with the greatest exact length / period; the first one of equals."""
    more = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, run: F.when(more(best, run), run).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run with exponent_milli, and digests of all runs and of the kept text; from ``without_runs``."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), greatest(F.col("runs")).alias("best"), lines.alias("lines"), "kept_text")
    return rows.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
