"""Ranked lexical search of many items at once, with the sums that items share computed once per document.

Items are taken in blocks of bounded size.  Terms that occur in the same items of a block form one node; a pair of nodes that
comes together in several items becomes a node of its own, and so on until no pair repeats.  The nodes are a graph in which an
item is a short list of nodes, and a node the sum of two others.  For a block of documents the partial scores of all nodes are
a table of integers: first the nodes of terms, then level by level the pairs, last the items.

Each task keeps the best documents of each item while it reads; the lists of all tasks meet per item and salt, then per item.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import modest_batches, per_block, settle

TOP = 50
SALTS = 16
#: A block of items ends with the item that brings it to this many terms; a single item is never cut.
BLOCK_TERMS = 100_000
#: Partial scores that a task holds at a time.
CELLS = 1 << 21
LAST_ID = np.iinfo(np.int64).max

#: ASCII letters in lower case and digits stay, all other ASCII ends a term; bytes of other characters belong to terms.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def shared_pairs(items: list[list[int]], nodes: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """The items as lists of nodes, and the pairs (nodes numbered from ``nodes``) that stand for neighbours in several items.

    Every round replaces repeated neighbours from left to right, the more frequent one of two that overlap.
    """
    pairs: list[tuple[int, int]] = []
    while True:
        counts = Counter(p for item in items for p in zip(item, item[1:], strict=False))
        if not counts or max(counts.values()) < 2:
            return items, pairs
        number: dict[tuple[int, int], int] = {}
        following = []
        for item in items:
            out, at = [], 0
            while at < len(item):
                pair = tuple(item[at : at + 2])
                if counts.get(pair, 0) > 1 and counts[pair] >= counts.get(tuple(item[at + 1 : at + 3]), 0):
                    if pair not in number:
                        number[pair] = nodes + len(pairs)
                        pairs.append(pair)
                    out.append(number[pair])
                    at += 2
                else:
                    out.append(item[at])
                    at += 1
            following.append(out)
        items = following


@dataclass
class Plan:
    """How the scores of a block of items are made of the contributions of terms."""

    item_ids: list[int | None]
    vocabulary: dict[bytes, int]
    node_of: np.ndarray  # of each term
    nodes: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # node, and the two it is made of
    uses: np.ndarray  # the nodes of all items, one item after the other
    starts: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @classmethod
    def of(cls, items: list[tuple[int | None, set[bytes]]]) -> Plan:
        """``items`` have at least one term each."""
        holders: dict[bytes, list[int]] = defaultdict(list)
        for n, (_, found) in enumerate(items):
            for term in found:
                holders[term].append(n)
        together = sorted({tuple(h) for h in holders.values()}, key=lambda h: (-len(h), h))
        number = {h: n for n, h in enumerate(together)}
        # an item lists its nodes from the most shared to its own, so that common ones are neighbours
        lists: list[list[int]] = [[] for _ in items]
        for h, n in number.items():
            for item in h:
                lists[item].append(n)
        lists, pairs = shared_pairs(lists, len(together))
        depth = [0] * len(together)
        by_level: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, (a, b) in enumerate(pairs, len(together)):
            depth.append(1 + max(depth[a], depth[b]))
            by_level[depth[n]].append((n, a, b))
        levels = [tuple(np.array(by_level[k]).T) for k in sorted(by_level)]
        vocabulary = {t: n for n, t in enumerate(sorted(holders))}
        node_of = np.array([number[tuple(holders[t])] for t in sorted(holders)], np.int64)
        sizes = [len(x) for x in lists]
        return cls([i for i, _ in items], vocabulary, node_of, len(depth), levels, np.array([n for x in lists for n in x]), np.cumsum([0, *sizes[:-1]]))

    def scores(self, docs: np.ndarray, of_terms: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """items x documents; an entry per document and term: the document's place, the term, its occurrences.  ``m`` per document."""
        sums = np.zeros((self.nodes, len(m)), np.int64)
        part = self.weights[of_terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
        np.add.at(sums.reshape(-1), self.node_of[of_terms] * len(m) + docs, part)
        for node, a, b in self.levels:
            sums[node] = sums[a] + sums[b]
        return np.add.reduceat(sums[self.uses], self.starts, axis=0)


@dataclass
class Best:
    """The best documents of each item so far."""

    items: int
    top: int

    def __post_init__(self):
        self.rows = [np.empty(0, np.int64) for _ in range(4)]  # item, score, whether the id is unknown, doc_id
        self.least = np.ones(self.items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        new = (item, scores[item, doc], unknown[doc], ids[doc])
        item, score, no_id, doc_id = (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((doc_id, no_id, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(self.items))
        place = np.arange(len(item)) - first[item]
        kept = order[place < self.top]
        self.rows = [x[kept] for x in (np.concatenate([self.rows[0], new[0]]), score, no_id, doc_id)]
        full = place == self.top - 1
        self.least[item[full]] = score[order[full]]


def blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """The items with a term, as (item_id, terms), in blocks; the driver holds one block at a time."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    for row in rows.toLocalIterator():
        found = set(terms(bytes(row["text"])))
        if found:
            block.append((row["item_id"], found))
            size += len(found)
        if size >= block_terms:
            yield block
            block, size = [], 0
    if block:
        yield block


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (the terms of the vocabulary that the document holds), per row of ``docs``."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        number, sizes, found, tfs, offsets = vocabulary.get, [], [], [], [0]
        for text in batch.column("text").to_pylist():
            words = terms(text)
            sizes.append(len(words))
            counts = Counter(map(number, words))
            counts.pop(None, None)
            found.extend(counts.keys())
            tfs.extend(counts.values())
            offsets.append(len(found))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (found, tfs)]
        return pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return per_block(taken, of, "doc_id long, n long, terms array<int>, tfs array<int>")


def best_of_tasks(rows: DataFrame, plan: Plan, documents: int, length: int, top: int) -> DataFrame:
    """item (its place in the block), score, unknown, doc_id: the ``top`` best of what each task reads."""
    step = max(1, CELLS // max(plan.nodes, len(plan.uses)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(plan.item_ids), top)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, n, lists, tfs = (part.column(k) for k in ("doc_id", "n", "terms", "tfs"))
                m = 50 + 50 * n.to_numpy() * documents // length
                where = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                scores = plan.scores(where, lists.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), m)
                unknown = np.array(ids.is_null().to_pylist(), np.int64)
                best.add(scores, ids.fill_null(LAST_ID).to_numpy(), unknown)
        yield pa.record_batch([pa.array(x) for x in best.rows], ["item", "score", "unknown", "doc_id"])

    modest_batches(rows.sparkSession)
    return rows.mapInArrow(run, "item long, score long, unknown long, doc_id long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents with a score above 0 of each row of ``items``.

    Null and empty texts have no terms: such documents are never found and such items have no rows.  Equal scores go by
    ascending doc_id, unknown ids last.  Repeated rows of either table are documents and items of their own, further columns
    are ignored, and empty tables give no rows.  A very long text is counted in one piece.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items, block_terms):
        plan = Plan.of(block)
        rows = settle(occurrences(docs, plan.vocabulary), "occurrences")
        total = rows.filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not total["documents"]:
            break
        # one row per term of the block
        holding = {r["term"]: r["df"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        odds = [(2 * total["documents"] + 2) / (2 * holding.get(n, 0) + 1) for n in range(len(plan.vocabulary))]
        plan.weights = np.array([math.floor(1000 * math.log(x)) for x in odds], np.int64)
        order = (F.desc("score"), F.asc("unknown"), F.asc("doc_id"))
        found = best_of_tasks(rows, plan, total["documents"], total["length"], top)
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
        part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
        whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(plan.item_ids)), "item long, item_id long")
        doc_id = F.when(F.col("unknown") == 0, F.col("doc_id")).alias("doc_id")
        named = whole.join(F.broadcast(names), "item").select("item_id", "rank", doc_id, "score")
        out = out.unionByName(settle(named, "ranked"))
    return out


#: Terms are cut by the same ranges, the arithmetic is that of 64-bit integers.
SQL = r"""
with words as (
    select kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select 'doc' as kind, doc_id as id, text from documents union all select 'item', item_id, text from benchmark)
),
tf as (select id as doc_id, term, count(*)::bigint as tf from words where kind = 'doc' group by all),
sizes as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
totals as (select count(*)::bigint as total, sum(n)::bigint as length from sizes),
weights as (
    select term, floor(1000 * ln((2 * total + 2)::double / (2 * df + 1)))::bigint as w
    from (select term, count(*)::bigint as df from tf group by term), totals
),
parts as (
    select item_id, doc_id, (w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // length))))::bigint as part
    from (select distinct id as item_id, term from words where kind = 'item') join weights using (term) join tf using (term) join sizes using (doc_id), totals
),
scored as (select item_id, doc_id, sum(part)::bigint as score from parts group by all having sum(part) > 0)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored qualify rank <= 50
"""
