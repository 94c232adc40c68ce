"""SimHash near-duplicates through an index of fingerprint bytes by position.

A fingerprint has eight bytes.  Two fingerprints that differ in at most ``max_bits`` bits differ in at most that many
bytes, so at least ``8 - max_bits`` bytes agree at their positions: the guaranteed minimum.  The index lists the distinct
fingerprints under every choice of ``INDEXED`` positions and their byte values, which is the byte-position index read at
several positions at once; single bytes would make lists of a 256th of all rows.  Two fingerprints that meet in a list are a
candidate; the shared positional bytes are tallied, candidates below the minimum go, and the rest is verified bit by bit.

A list longer than ``long_list`` (a large group of near copies) is not turned into pairs.  Two fingerprints differ in at most
2r bits exactly if some 64-bit value lies within r bits of both, so each member of a long list is joined to the values within
r bits of itself: members that share a value are linked, all of them, and the work per member is fixed.  For an odd
``max_bits`` one of the two sides takes r + 1 bits, and values are only shared between the sides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import keep_rows, only, per_block, row_key, settle, texts_of
from trackloom.llm.components import smallest_reachable

SEED = 42
WORDS = 4
MAX_BITS = 4
#: Positions in one index key.
INDEXED = 4
#: Longer lists are linked through shared values.  A member costs about 2,081 rows there, and as many pairs at this length.
LONG_LIST = 2048


def shingle_hashes(text: str, words: int) -> list[int]:
    """A 64-bit hash per shingle, in lower case; ``words`` words or fewer are one shingle, no words none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(begins[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits; bit i is set if it is set in over half of the shingle hashes.  No words: zero."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    array = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(array), 1 << 16):
        counts += np.unpackbits(array[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, *keys: str) -> DataFrame:
    """doc_id, the long columns ``keys`` and ``fp``, the fingerprint as a signed long, per input row (null text: empty)."""
    names = ["doc_id", *keys]

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.record_batch([*[batch.column(k) for k in names], pa.array(fps)], [*names, "fp"])

    taken = only(docs, text=F.col("text"), **{k: F.col(k).cast("long") for k in names})
    return per_block(taken, of, "".join(f"{k} long, " for k in names) + "fp long")


CHOICES = list(combinations(range(8), INDEXED))


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def index(fps: DataFrame) -> DataFrame:
    """The lists: choice, value, fp.  A list is a choice of positions and the bytes there; fp must be distinct."""
    masks = [signed(sum(0xFF << 8 * p for p in chosen)) for chosen in CHOICES]
    keys = [F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for n, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.choice", "k.value", "fp")


#: Bits of the filter before the join with the lists of two and more; each is a fixed 32,768 of one row.
FILTER_BITS = 1 << 24
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def marks(lists: DataFrame) -> np.ndarray:
    """A bit for each list, by a hash; FILTER_BITS whatever the number of lists, so that a full one only filters less."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, choice = batch.column("value").to_numpy().view(np.uint64), batch.column("choice").to_numpy().astype(np.uint64)
        return pa.record_batch([pa.array(hashed_bit(value, choice))], ["bit"])

    rows = per_block(lists.select("choice", "value"), of, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("n")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in rows.collect():
        at = r["n"] * 4096
        out[at : at + 4096] |= np.frombuffer(r["bits"], np.uint8)
    return out


def index_if_likely(fps: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows of ``index`` whose list the filter doesn't exclude."""
    masks = np.array([sum(0xFF << 8 * p for p in chosen) for chosen in CHOICES], np.uint64)
    choices = np.arange(len(CHOICES), dtype=np.uint64)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        value = fp[:, None] & masks[None]
        bucket, place = bucket_and_place(hashed_bit(value, choices[None]))
        row, choice = np.nonzero(bitmap[bucket * 4096 + place // 8] >> (place % 8).astype(np.uint8) & 1)
        return pa.record_batch(
            [pa.array(choice.astype(np.int32)), pa.array(value[row, choice].view(np.int64)), pa.array(fp[row].view(np.int64))],
            ["choice", "value", "fp"],
        )

    return per_block(fps.select("fp"), of, "choice int, value long, fp long", block_bytes=1 << 17)


def hashed_bit(value: np.ndarray, choice: np.ndarray) -> np.ndarray:
    return ((value ^ choice) * SPREAD >> np.uint64(40)).astype(np.int64)


def bucket_and_place(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where Spark's bitmap functions keep a number: 1 to 32,768 is bucket 1, and so on."""
    return (bit + 32767) // 32768, np.where(bit > 0, (bit - 1) % 32768, 0)


def shared_bytes(differing: Column) -> Column:
    """Positions at which two fingerprints have the same byte, from their XOR."""
    return sum((F.shiftrightunsigned(differing, 8 * p).bitwiseAND(F.lit(0xFF).cast("long")) == 0).cast("int") for p in range(8))


def links(fps: DataFrame, max_bits: int = MAX_BITS, long_list: int = LONG_LIST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all pairs within ``max_bits``."""
    if not 0 <= max_bits <= 8 - INDEXED:
        raise ValueError(f"max_bits must be 0 to {8 - INDEXED}")
    sizes = settle(index(fps).groupBy("choice", "value").agg(F.count("*").alias("n")).filter("n > 1"), "list_sizes")
    # lists of one fingerprint go here; both sides grow with the input, so neither is broadcast, and Spark splits a long list
    kept = settle(index_if_likely(fps, marks(sizes)).join(sizes.hint("merge"), ["choice", "value"]), "lists")
    short = kept.filter(F.col("n") <= long_list).drop("n")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    # a pair may meet in several lists; it counts in the one of its first shared positions
    beyond = F.element_at(F.lit([signed((1 << 64) - (1 << 8 * (c[-1] + 1))) for c in CHOICES]), F.col("choice") + 1)
    pairs = (
        short.withColumnRenamed("fp", "a")
        .join(short.withColumnRenamed("fp", "b").hint("merge"), ["choice", "value"])
        .filter(F.col("a") < F.col("b"))
        .filter(shared_bytes(differing) >= 8 - max_bits)
        .filter(F.bit_count(differing) <= max_bits)
        .filter(shared_bytes(differing.bitwiseOR(beyond)) == INDEXED)
        .select("a", "b")
    )
    members = kept.filter(F.col("n") > long_list).select("fp").distinct()
    return pairs.unionByName(links_by_value(members, max_bits))


def links_by_value(members: DataFrame, max_bits: int) -> DataFrame:
    """Edges between members through the values within half of ``max_bits`` bits of them.

    Few members make very many rows, which Spark sizes as the members.  So the rows are not joined: they are dealt out once, and each
    looks at the others of its value, of which there are no more than values near a member (2,081 within two bits).
    """
    near, far = max_bits // 2, max_bits - max_bits // 2

    def values(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        flips = [(w, sum(1 << b for b in c)) for w in range(far + 1) for c in combinations(range(64), w)]
        mask, weight = np.array([m for _, m in flips], np.uint64), np.array([w for w, _ in flips], np.int8)
        value = (fps[:, None] ^ mask[None, :]).reshape(-1)
        return pa.record_batch(
            [pa.array(value.view(np.int64)), pa.array(np.repeat(fps, len(mask)).view(np.int64)), pa.array(np.tile(weight, len(fps)))],
            ["value", "fp", "weight"],
        )

    spread = members.repartition("fp")
    rows = per_block(spread, values, "value long, fp long, weight byte", block_bytes=64 * 8)
    of_value = Window.partitionBy("value")
    if near == far:
        # each member meets the lowest member of each of its values
        return rows.select("value", "fp").select(F.min("fp").over(of_value).alias("a"), F.col("fp").alias("b")).filter("a < b").distinct()
    # value nodes join the graph: a member within `near` bits of a value meets the lowest member within `far` bits and back
    lowest = {"f": F.min("fp").over(of_value), "n": F.min(F.when(F.col("weight") <= near, F.col("fp"))).over(of_value)}
    met = rows.withColumns(lowest).filter("n is not null")
    close = met.filter(F.col("weight") <= near).select(F.col("f").alias("a"), F.col("fp").alias("b"))
    wide = met.select(F.col("n").alias("a"), F.col("fp").alias("b"))
    both = close.unionByName(wide).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_roots(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Distinct fingerprints with the smallest fingerprint of their component."""
    roots = smallest_reachable(links(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    return nodes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is the smallest doc_id reachable over links, the
    row's own included.  Null and blank texts have fingerprint zero and link like any other.  Repeated rows stay, one output row
    each.  A null doc_id is no candidate for component_id; a component without ids gets null.  No rows give no rows.
    """
    rows = settle(fingerprints(docs, words), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    labelled = with_roots(nodes, max_bits)
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    # few components hold many fingerprints, so the label goes back per fingerprint before the rows are met
    by_fp = labelled.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS, words: int = WORDS, further: DataFrame | None = None) -> DataFrame:
    """The whole row with the smallest doc_id of each component; ties go by a hash of the row, rows equal in all columns are one.

    Rows without a doc_id stay only in components that have no id.  ``further`` has the ``group`` of each row by its key (key_a, key_b), a
    long: components are closed over these groups too.
    """
    a, b = row_key(docs.columns)
    fps = settle(fingerprints(docs.select("doc_id", "text", a, b), words, "key_a", "key_b"), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key_a", "key_b")
    if further is not None:
        # rows equal in all columns share a key
        grouped = fps.join(further.dropDuplicates(["key_a", "key_b"]).hint("merge"), ["key_a", "key_b"])
        pairs = settle(grouped.groupBy("fp", "group").agg(F.min(rank).alias("least")), "pairs")
        nodes = settle(pairs.groupBy("fp").agg(F.min("least").alias("least")), "nodes")
        first = over_groups(pairs.join(with_roots(nodes, max_bits).select("fp", "root").hint("merge"), "fp"))
    else:
        nodes = settle(fps.groupBy("fp").agg(F.min(rank).alias("least")), "nodes")
        first = with_roots(nodes, max_bits).groupBy("root").agg(F.min("least").alias("least"))
    return keep_rows(docs, first.select("least.key_a", "least.key_b"))


def over_groups(pairs: DataFrame) -> DataFrame:
    """The smallest ``least`` of what hangs together over ``root`` and ``group``.

    Most pairs share neither with another one and hang together with nothing; they make no edges.
    """
    ends = {"a": F.xxhash64(F.lit("root"), "root"), "b": F.xxhash64(F.lit("group"), "group")}
    met = settle(pairs.groupBy("root", "group").agg(F.min("least").alias("least")).withColumns(ends), "met")
    sharing = [met.join(met.groupBy(k).count().filter("count > 1").hint("merge"), k, "left_semi") for k in "ab"]
    edges = sharing[0].unionByName(sharing[1]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    whole = smallest_reachable(edges).select(F.col("node").alias("a"), F.col("root").alias("whole"))
    return met.join(whole.hint("merge"), "a", "left").groupBy(F.coalesce("whole", "a").alias("whole")).agg(F.min("least").alias("least"))
