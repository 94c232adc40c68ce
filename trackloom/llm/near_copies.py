"""Near copies by Jaccard similarity of word shingles, which the near-duplicate stage of the pipeline adds to those by SimHash.

At a similarity of 0.8 two SimHash fingerprints of 64 bits differ in about ten bits and often in more, so no choice of bytes
is shared for certain and an index of them finds few such pairs.  The fingerprint here is wider: ``POSITIONS`` words of 64
bits, each the digest of ``MINIMA`` minimum hashes of the shingle set.  Two sets of similarity s share a given position with
probability s ** MINIMA, so with 32 positions of five a pair at 0.8 is missed with probability (1 - 0.8 ** 5) ** 32, about
3 in a million, and at 0.85 with less than 2 in 100 million.  Sets that share a position are candidates, and whole shingle
sets decide.

A list of up to ``SHORT`` sets is compared pair by pair.  In a longer one every set x is compared with the ``HUBS`` members
that share most positions with others.  Let H be all their shingles and c(x) those of x in H.  Two
members that share no shingle outside of H have at most min(c(x), c(y)) in common, which must reach s / (1 + s) of both sizes;
members of equal size that are not alike a hub hardly ever do.  All others share a shingle outside of H, one of the first
ones in a fixed order: at similarity s the two have s |x| in common, so all but s |x| - c(x) - 1 of the outside ones are
looked at.  Those shingles make new, shorter lists, which are treated alike.  So the groups are those of all candidate pairs, and a
group of thousands of edited copies of one text costs no pairs of copies that are only alike the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import keep_rows, modest_batches, only, per_block, row_key, settle, texts_of
from trackloom.llm.components import smallest_reachable
from trackloom.llm.simhash import shingle_hashes

WORDS = 5
SIMILAR = 0.8
POSITIONS = 32
MINIMA = 5
#: Lists of up to so many sets are compared pair by pair.
SHORT = 16
HUBS = 4
#: Members of a list that meet its hubs in one task.
MEMBERS = 1024
#: Shingles that are hashed by all functions together.
TOGETHER = 2048

_rng = np.random.default_rng(20)
MIXED = _rng.integers(0, 1 << 32, (POSITIONS * MINIMA, 1), dtype=np.uint32)
TIMES = _rng.integers(0, 1 << 32, (POSITIONS * MINIMA, 1), dtype=np.uint32) | np.uint32(1)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes in order, as signed longs; fewer words than ``words`` are one shingle, no words none."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64).view(np.int64))


def positions(shingles: np.ndarray) -> list[int]:
    """The words of the wide fingerprint; each depends on its place too, so that a list belongs to one place."""
    low = np.full(len(MIXED), 0xFFFFFFFF, np.uint32)
    short = (shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), TOGETHER):
        low = np.minimum(low, ((short[None, at : at + TOGETHER] ^ MIXED) * TIMES).min(axis=1))
    found = [xxhash.xxh3_64_intdigest(p.tobytes(), n) for n, p in enumerate(low.reshape(POSITIONS, MINIMA))]
    return np.array(found, np.uint64).view(np.int64).tolist()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets without repeats; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def wide_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, key_a, key_b, node (a digest of the shingle set), places (the wide fingerprint) per row."""
    names = ["doc_id", "key_a", "key_b"]

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in texts_of(batch)]
        nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        places = pa.array([positions(s) for s in sets], pa.list_(pa.int64()))
        return pa.record_batch([*[batch.column(k) for k in names], pa.array(nodes), places], [*names, "node", "places"])

    taken = only(docs, text=F.col("text"), **{k: F.col(k).cast("long") for k in names})
    return per_block(taken, of, "doc_id long, key_a long, key_b long, node long, places array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """node, shingles of the nodes in ``wanted`` (node, key_a, key_b), from the text of the row with that key."""
    a, b = row_key(docs.columns)
    texts = docs.select("text", a, b).join(wanted, ["key_a", "key_b"]).select("node", "text")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([shingle_set(t, words) for t in texts_of(batch)], pa.list_(pa.int64()))
        return pa.record_batch([batch.column("node"), sets], ["node", "shingles"])

    # rows equal in all columns share a key
    return per_block(texts, of, "node long, shingles array<long>").dropDuplicates(["node"])


def alike(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose whole sets have ``similar`` or more."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = batch.column("x"), batch.column("y")
        values = [(x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(batch.num_rows)]
        kept = pa.array([likeness(p, q) >= similar - 1e-12 for p, q in values], pa.bool_())
        return pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(kept)

    # whole sets are large and take little room in a file, by which Spark would size and broadcast them
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    return per_block(both.select("a", "b", "x", "y"), of, "a long, b long")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def different_lists(rows: DataFrame) -> DataFrame:
    """place, node, n of lists of two and more; of lists with the same members one stays.  Spark splits a list that is skewed."""
    member = F.xxhash64("node").cast("decimal(38,0)"), F.xxhash64(F.lit("again"), "node").cast("decimal(38,0)")
    lists = rows.groupBy("place").agg(F.count("*").alias("n"), *[F.sum(m).alias(k) for m, k in zip(member, "pq", strict=True)]).filter("n > 1")
    kept = lists.groupBy("n", "p", "q").agg(F.min("place").alias("place")).select("place", "n")
    return settle(rows.join(kept.hint("merge"), "place").select("place", "node", "n"), "members")


def profiles(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """place, node, size, inside (shingles that hubs hold too), outside (the first other ones), alike (hubs that are alike, in order).

    A hub's set is sent once per list and ``MEMBERS`` members, and a task holds the hubs of one list at a time.
    """
    central = Window.partitionBy("place").orderBy(F.desc("weight"), F.xxhash64("node"), "node")
    chosen = members.withColumn("rank", F.row_number().over(central)).filter(F.col("rank") <= HUBS)
    hubs = chosen.select("place", F.ceil(F.col("n") / MEMBERS).alias("parts"), (F.col("rank") - HUBS - 1).alias("is_member"), "node")
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("place", "part", "node", "is_member")
    dealt = members.select("place", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / MEMBERS)).alias("part"), "node", F.lit(1).alias("is_member"))
    rows = hubs.unionByName(dealt).join(sets.hint("merge"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, whole, open_ = None, [], np.empty(0, np.int64), False
        for batch in batches:
            out = []
            keys = zip(*[batch.column(k).to_pylist() for k in ("place", "part", "node", "is_member")], strict=True)
            for i, (place, part, node, is_member) in enumerate(keys):
                x = batch.column("shingles")[i].values.to_numpy()
                if (place, part) != at:
                    at, held, open_ = (place, part), [], True
                if is_member < 0:
                    held.append((node, x))
                    continue
                if open_:
                    whole, open_ = np.unique(np.concatenate([h for _, h in held])), False
                inside = np.isin(x, whole, assume_unique=True)
                need = max(1, int(np.ceil(similar * len(x) - 1e-9)) - int(inside.sum()))
                beyond = x[~inside]
                near = [h for h, y in held if h == node or likeness(x, y) >= similar - 1e-12]
                out.append((place, node, len(x), int(inside.sum()), beyond[: max(0, len(beyond) - need + 1)], near))
            columns = [*zip(*out, strict=True)] if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["place", "node", "size", "inside", "outside", "alike"])

    modest_batches(rows.sparkSession)
    sorted_rows = rows.repartition("place", "part").sortWithinPartitions("place", "part", "is_member")
    return sorted_rows.mapInArrow(run, "place long, node long, size long, inside long, outside array<long>, alike array<long>")


def weighed(members: DataFrame) -> DataFrame:
    """With ``weight``, how many members a node meets in all lists; the text that others were made of meets the most."""
    return members.join(members.groupBy("node").agg(F.sum("n").alias("weight")), "node")


def grouped_by_hubs(rows: DataFrame) -> DataFrame:
    """``root``: a node of the members that are linked already, over the hubs of their list; a member that is alike none is its own."""
    sets = rows.filter(F.size("alike") > 0).groupBy("place").agg(F.collect_set("alike").alias("sets"))  # of a few hubs, so few sets
    wider = lambda c: F.array_distinct(F.flatten(F.concat(F.array(c), F.filter("sets", lambda s: F.arrays_overlap(s, c)))))
    reached = F.aggregate(F.sequence(F.lit(1), F.lit(HUBS)), F.col("alike"), lambda c, _: wider(c))
    root = F.when(F.size("alike") > 0, F.array_min(reached)).otherwise(F.col("node"))
    return rows.join(sets, "place", "left").withColumn("root", root).drop("alike", "sets")


def reachable_inside(rows: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of a list that could be alike by what hubs hold of them; only sizes for which that is possible meet.

    One of two members of different groups is outside of the largest group of its list, and looks for the other one.
    """
    share = similar / (1 + similar)
    most = F.col("inside") / share - F.col("size")  # the largest partner
    bin_of = lambda size: F.floor(F.log(size) * 64).cast("int")
    able = rows.filter((most >= similar * F.col("size") - 1e-6) & (F.col("size") > 0)).select("place", "node", "size", "inside", "root")
    groups = able.groupBy("place", "root").agg(F.count("*").alias("n"))
    largest = groups.groupBy("place").agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
    others = able.join(largest, "place").filter("root <> largest")
    least, last = bin_of(F.greatest(similar * F.col("size") - 1e-6, F.lit(1.0))), bin_of(most + 1e-6)
    x = others.withColumn("bin", F.explode(F.sequence(F.least(least, last), last)))
    x = x.select("place", "bin", *[F.col(k).alias(f"{k}_a") for k in ("node", "size", "inside", "root")])
    y = able.select("place", bin_of(F.col("size")).alias("bin"), *[F.col(k).alias(f"{k}_b") for k in ("node", "size", "inside", "root")])
    fits = F.least("inside_a", "inside_b") >= share * (F.col("size_a") + F.col("size_b")) - 1e-6
    return x.join(y.hint("merge"), ["place", "bin"]).filter("root_a <> root_b").filter(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def all_pairs(lists: DataFrame) -> DataFrame:
    """The pairs (a, b) of each list; for short lists."""
    x, y = lists.withColumnRenamed("node", "a"), lists.withColumnRenamed("node", "b").hint("merge")
    return x.select("place", "a").join(y.select("place", "b"), "place").filter("a < b").select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, similar: float = SIMILAR, words: int = WORDS, short: int = SHORT) -> DataFrame:
    """Edges (a, b) of ``similar`` or more between nodes; their components are those of all candidate pairs."""
    rows = nodes.select("node", F.explode("places").alias("place"))
    members = different_lists(rows)
    wanted = nodes.join(members.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "least.key_a", "least.key_b")
    sets = settle(sets_of(docs, wanted, words), "candidate_sets")
    found = settle(alike(ordered(all_pairs(members.filter(F.col("n") <= short))), sets, similar), "alike")
    members = weighed(members.filter(F.col("n") > short))
    # a list made of a list has no hub of that one and shares one more shingle, so the lists get shorter every round
    while not members.isEmpty():
        known = settle(profiles(members, sets, similar), "profiles")
        near = known.select(F.col("node").alias("a"), F.explode("alike").alias("b"))
        rows = settle(grouped_by_hubs(known), "grouped")
        beyond = rows.select(F.explode("outside").alias("shingle"), "node", "root", "place").select(F.xxhash64("place", "shingle").alias("place"), "node", "root")
        apart = beyond.groupBy("place").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("place")
        following = different_lists(beyond.join(apart.hint("merge"), "place").select("place", "node"))
        pairs = ordered(reachable_inside(rows, similar).unionByName(all_pairs(following.filter(F.col("n") <= short))))
        found = found.unionByName(ordered(near)).unionByName(settle(alike(pairs, sets, similar), "alike"))
        members = weighed(following.filter(F.col("n") > short))
    return found


def rooted(docs: DataFrame, similar: float, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their shingle set as ``node``, the nodes with their first row, and the smallest node that each node with links reaches."""
    a, b = row_key(docs.columns)
    rows = settle(wide_fingerprints(docs.select("doc_id", "text", a, b), words), "wide_fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key_a", "key_b")
    nodes = settle(rows.groupBy("node").agg(F.min(rank).alias("least"), F.first("places").alias("places")), "nodes")
    return rows, nodes, smallest_reachable(links(docs, nodes, similar, words))


def groups(docs: DataFrame, similar: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """key_a, key_b (see ``row_key``) and ``group``, the same for all rows of a group of near copies."""
    rows, _, roots = rooted(docs, similar, words)
    return rows.join(roots.hint("merge"), "node", "left").select("key_a", "key_b", F.coalesce("root", "node").alias("group"))


def one_of_each(docs: DataFrame, similar: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """The whole row with the smallest doc_id of each group of near copies; ties go by a hash of the row, equal rows are one.

    Texts link if the sets of their shingles of ``words`` words (in lower case, white space aside) have a Jaccard similarity of
    ``similar`` or more; groups are closed over links.  Null and blank texts have the empty set and link with each other.  Rows
    without a doc_id stay only in groups that have no id.  No rows give no rows.
    """
    _, nodes, roots = rooted(docs, similar, words)
    first = nodes.select("node", "least").join(roots.hint("merge"), "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("least"))
    return keep_rows(docs, first.select("least.key_a", "least.key_b"))
