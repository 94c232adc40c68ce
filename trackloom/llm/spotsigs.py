"""SpotSigs: chains of content words that follow common words, as sets; partitions by set length, pruned Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import BLOCK_BYTES, cut, modest_batches, only, partitions, per_block, settle, texts_of

CHAIN = 2
SIMILAR = 0.8
#: Common words of the four languages, in alphabetical order.
ANCHORS = frozenset(
    """a an and are as at be by del das de den der die du ein eine el en es et for from für in is ist it la las le les lo los
    mit nicht no of on or par para pas por pour que qui se sich sur that the this to un una une und von was with y zu""".split()
)
STRIP = ".,;:!?\"'()[]{}*#$%&|<>/\\-_`~^+="


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the chains.  A text with words but no chain has one hash, of all its words."""
    words = [w.strip(STRIP) for w in text.lower().split()]
    anchors = ANCHORS
    content = [w for w in words if w and w not in anchors]
    found, seen = set(), 0
    h = xxhash.xxh32_intdigest
    last = len(content) - chain
    for w in words:
        if w in anchors:
            if seen <= last:
                found.add(f"{w} {' '.join(content[seen : seen + chain])}")
        elif w:
            seen += 1
    if not found and any(words):
        found.add(" ".join(words))
    return np.unique(np.array([h(s.encode("utf-8", "surrogatepass")) for s in found], np.uint32))


def written(signs: np.ndarray) -> str:
    return signs.astype(">u4").tobytes().hex()


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets.  Below ``least`` by their lengths alone, or once too few can be shared, it is 0."""
    if not len(a) and not len(b):
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) < least * len(large):
        return 0.0
    need, shared = least * (len(a) + len(b)) / (1 + least), 0
    step = len(small) if not least else 256
    for at in range(0, len(small), step):
        part = small[at : at + step]
        place = np.searchsorted(large, part)
        shared += int((large[np.minimum(place, len(large) - 1)] == part).sum())
        if shared + len(small) - at - len(part) < need:
            return 0.0
    return shared / (len(a) + len(b) - shared)


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows with bucket and ``own``: buckets are ranges of descending doc_id, dealt one to a partition, sorted there.

    The first row after each bucket comes along with ``own`` false; after the last bucket that is the first row of all.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.withColumn("key", key)
    wanted = partitions(docs.sparkSession)
    steps = [i / wanted for i in range(1, wanted)]
    # one row: as many numbers as there are partitions
    splits = rows.agg(F.percentile_approx("key", steps, 10_000)).first()[0] if steps else []
    splits = sorted(set(splits or []), reverse=True)

    def find(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("key") > splits[middle], find(low, middle)).otherwise(find(middle + 1, high))

    rows = rows.withColumn("bucket", find(0, len(splits)))
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("key").alias("top")).collect())
    before = [(top, tops[n - 1][0]) for n, (_, top) in enumerate(tops)]
    heads = docs.sparkSession.createDataFrame(before, "key long, before int")
    met = rows.join(F.broadcast(heads), "key", "left")
    own, ahead = F.struct("bucket", F.lit(True).alias("own")), F.struct(F.col("before").alias("bucket"), F.lit(False).alias("own"))
    spread = F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ahead)))
    out = met.withColumn("at", spread).select("at.bucket", "at.own", "doc_id", "key", "text")
    dealt = out.repartitionById(len(splits) + 1, F.col("bucket").cast("int"))
    return dealt.sortWithinPartitions("bucket", F.desc("own"), F.desc("key"), F.asc("text")), len(splits) + 1


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, per row.

    The next document is the one with the next smaller doc_id (null ids come last, equal ids in the order of their texts); after
    the last comes the first.  Null texts are empty.  Two texts without words are alike; one with and one without are not.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        waiting, rows, size = None, [], 0
        for batch in batches:
            for piece in cut(batch, BLOCK_BYTES):
                for own, doc_id, text in zip(piece.column("own").to_pylist(), piece.column("doc_id").to_pylist(), texts_of(piece), strict=True):
                    signs = signatures(text, chain)
                    if waiting is not None:
                        old_id, old, old_signs = waiting
                        new = edited(old, text)
                        new_signs = signatures(new, chain)
                        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                        rows.append((old_id, len(old), sha, written(old_signs), written(new_signs), pruned_jaccard(old_signs, new_signs), pruned_jaccard(old_signs, signs)))
                        size += len(old)
                    waiting = (doc_id, text, signs) if own else None
                    if size > BLOCK_BYTES:
                        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                        rows, size = [], 0
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    ordered, _ = in_order(only(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text"), F.lit(""))))
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    modest_batches(docs.sparkSession)
    return ordered.mapInArrow(run, fields)


def length_bounds(similar: float, longest: int) -> list[int]:
    """Starts of the partitions by set length: two sets of partitions that aren't next to each other can't be alike enough."""
    bounds = [1]
    while bounds[-1] <= longest:
        # sets of at least `similar` of each other's length lie in one partition or in two neighbours
        bounds.append(max(bounds[-1] + 1, int(np.ceil(bounds[-1] / similar))))
    return bounds


def set_table(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id and the sorted signatures ``signs`` of each row."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        signs = [signatures(t, chain).astype(np.int64) for t in texts_of(batch)]
        return pa.record_batch([batch.column("doc_id"), pa.array(signs, pa.list_(pa.int64()))], ["doc_id", "signs"])

    return per_block(only(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text")), of, "doc_id long, signs array<long>")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, chain: int = CHAIN) -> DataFrame:
    """(a, b, likeness) of all pairs of different signature sets at ``similar`` or more; a < b are the smallest ids of their sets.

    Rows with equal sets are one here (join them back by their fingerprint).  Sets lie in partitions by length, and one meets
    only its own partition and the next.  There two sets are compared if they share one of their rarest signatures (as
    many as must hold one of ``similar`` of the set), so a chain that very many documents have makes no pairs.  A null doc_id or
    a text without words takes no part.
    """
    sets = settle(set_table(docs, chain).filter("doc_id is not null and size(signs) > 0"), "sets")
    one = settle(sets.groupBy(F.sha2(F.concat_ws(",", "signs"), 256).alias("set_id")).agg(F.min("doc_id").alias("id"), F.min_by("signs", "doc_id").alias("signs")), "distinct_sets")
    longest = one.agg(F.max(F.size("signs"))).first()[0] or 0
    bounds = length_bounds(similar, longest)
    part = lambda n: F.size(F.filter(F.lit(bounds), lambda b: b <= n))
    signs = one.select("id", F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    spread = signs.groupBy("sign").agg(F.count("*").alias("seen"))
    ranked = signs.join(spread, "sign").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "sign"))).alias("signs"))
    least = F.ceil(F.col("n") * F.lit(similar)).cast("int")
    rare = ranked.select("id", "n", part(F.col("n")).alias("part"), F.explode(F.slice("signs.sign", 1, F.col("n") - least + 1)).alias("sign"))
    low = rare.withColumn("meets", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    x, y = low.select("sign", "meets", F.col("id").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa")), rare.select("sign", F.col("part").alias("meets"), F.col("id").alias("b"), F.col("n").alias("nb"))
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    candidates = x.join(y, ["sign", "meets"]).filter(shorter & (F.col("na") >= F.col("nb") * F.lit(similar))).select("a", "b").distinct()
    full = one.select("id", "signs")
    both = candidates.join(full.select(F.col("id").alias("a"), F.col("signs").alias("sa")), "a").join(full.select(F.col("id").alias("b"), F.col("signs").alias("sb")), "b")

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = batch.column("sa"), batch.column("sb")
        found = [pruned_jaccard(np.array(x, np.uint32), np.array(y, np.uint32), similar) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        return pa.record_batch([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "likeness"])

    alike = per_block(both.select("a", "b", "sa", "sb"), compare, "a long, b long, likeness double").filter(F.col("likeness") >= similar)
    return alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
