"""Removal of long repeated byte strings with a distributed sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Of every window of ``SPARSE`` starts one
suffix is indexed, chosen by the bytes there alone (the least hash), so two equal strings choose suffixes at equal offsets.
The starts that chose suffix p are its run.  A suffix has two sorts of tokens: those of its core, the bytes that all strings
of such a run have in common, and those of its cover, the bytes of all strings of its own run.  Suffixes are sorted by
the first eight bytes, core, cover: neighbours with equal covers repeat in all their strings, suffixes without a neighbour of
equal core in none.  What is left, one suffix of each cover, is looked at again in runs of 16 starts and then of single
starts, where core and cover are the string itself, so the result is exact to the byte.

Each sort works alike.  Splitters from a bounded sample of suffixes cut the token order into ranges; they are whole keys, down to
the position, so equal suffixes of a passage that very many documents share are dealt to several ranges.  A range is
sorted in its task by multikey quicksort, a token at a time within what is still equal, neighbours are compared, and the first and
last suffix of each range are compared with those of the ranges beside it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, modest_batches, only, partitions, per_block, settle

LENGTH = 400
#: Starts that share an indexed suffix in the three sorts.
SPARSE, MIDDLE = 256, 16
#: Suffixes that choose the splitters, from at most so many documents.
SAMPLE_DOCUMENTS, SAMPLE_SUFFIXES = 20_000, 40_000
#: Suffixes in a range, about.
RANGE_SUFFIXES = 500_000
#: A longer text is looked through in pieces.
PIECE_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20

WORDS = ["lead", "core_a", "core_b", "cover_a", "cover_b"]
PLACE = ["id", "text_hash", "p", "a", "b"]
SUFFIX = "".join(f"{w} long, " for w in WORDS) + "id long, text_hash long, p int, a int, b int"
MIX = np.uint64(0x9E3779B97F4A7C15)
COVERED, REFINE, FIRST, LAST = range(4)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the key of a text: id and text_hash, neither null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return only(
        docs, doc_id=F.col("doc_id").cast("long"), text=text, id=F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")),
        text_hash=F.xxhash64(F.col("doc_id").isNull(), text),
    )


def eight_bytes(buffer: bytes, count: int) -> np.ndarray:
    """The eight bytes from each of ``count`` places, as numbers that sort like them."""
    raw = np.frombuffer(buffer + bytes(8), np.uint8)
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (count, 8), (1, 1))).view(">u8").reshape(-1).astype(np.uint64)


def sparse_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, p, a, b): starts a to b of a text chose its suffix p."""
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    buffer = b"".join(texts)
    total, counts = len(buffer), np.maximum(sizes - LENGTH + 1, 0)
    if not counts.sum():
        return (np.empty(0, np.int64),) * 4
    hashed = eight_bytes(buffer, total) * MIX
    hashed ^= hashed >> np.uint64(29)
    hashed *= MIX
    place = np.uint64((1 << 24) - 1)
    hashed = (hashed & ~place) | np.arange(total, dtype=np.uint64)
    width = 1
    while width < SPARSE:
        step = min(width, SPARSE - width)
        hashed, width = np.minimum(hashed[:-step], hashed[step:]), width + step
    text = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[text]
    chosen = (hashed[starts] & place).astype(np.int64)
    change = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(text) != 0))
    first, last = np.concatenate([[0], change + 1]), np.concatenate([change, [len(text) - 1]])
    doc = text[first]
    return doc, chosen[first] - begins[doc], starts[first] - begins[doc], starts[last] - begins[doc]


def all_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``sparse_runs`` of texts of any length."""
    pieces, owner, offset = [], [], []
    for n, t in enumerate(texts):
        for at in range(0, max(1, len(t)), PIECE_BYTES):
            pieces.append(t if len(t) <= PIECE_BYTES else t[at : at + PIECE_BYTES + LENGTH - 1])
            owner.append(n)
            offset.append(at)
    found = [[], [], [], []]
    begin = 0
    while begin < len(pieces):
        end, size = begin, 0
        while end < len(pieces) and (end == begin or size + len(pieces[end]) <= BLOCK_BYTES):
            size += len(pieces[end])
            end += 1
        doc, p, a, b = sparse_runs(pieces[begin:end])
        shift = np.array(offset[begin:end])[doc] if len(doc) else doc
        for out, x in zip(found, (np.array(owner[begin:end])[doc] if len(doc) else doc, p + shift, a + shift, b + shift), strict=True):
            out.append(x)
        begin = end
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


def suffixes(raw: bytes, runs: list[tuple[int, int, int]], size: int) -> tuple[list[bytes], list[bytes], list[bytes], list[tuple[int, int, int]]]:
    """Leads, cores, covers and runs (p, first start, last start) of ``size`` starts or fewer, cut at fixed distances from p."""
    view, digest = memoryview(raw), xxhash.xxh3_128_digest
    leads, cores, covers, places = [], [], [], []
    for p, a, b in runs:
        for part in range((p - b) // size, (p - a) // size + 1):
            begin = p - size * part
            first, last = max(a, begin - size + 1), min(b, begin)
            core = digest(view[begin : begin - size + 1 + LENGTH])
            leads.append(raw[begin : begin + 8])
            cores.append(core)
            covers.append(core if size == 1 else digest(view[first : last + LENGTH], (p - first) << 20 | (p - last)))
            places.append((p, first, last))
    return leads, cores, covers, places


def table_of(leads: list[bytes], cores: list[bytes], covers: list[bytes], places: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    two = lambda x: np.frombuffer(b"".join(x), ">u8").reshape(-1, 2).astype(np.uint64)
    core, cover = two(cores), two(covers)
    words = [np.frombuffer(b"".join(leads), ">u8").astype(np.uint64), core[:, 0], core[:, 1], cover[:, 0], cover[:, 1]]
    return dict(zip([*WORDS, *PLACE], [*words, ids, hashes, places[:, 0], places[:, 1], places[:, 2]], strict=True))


def sparse_table(batch: pa.RecordBatch) -> dict[str, np.ndarray] | None:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    doc, p, a, b = all_runs(raw)
    if not len(doc):
        return None
    leads, cores, covers = [], [], []
    edges = np.searchsorted(doc, np.arange(len(raw) + 1))
    for n, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if x < y:
            got = suffixes(raw[n], list(zip(p[x:y].tolist(), a[x:y].tolist(), b[x:y].tolist(), strict=True)), SPARSE)
            leads += got[0]
            cores += got[1]
            covers += got[2]
    ids, hashes = batch.column("id").to_numpy(), batch.column("text_hash").to_numpy()
    return table_of(leads, cores, covers, np.stack([p, a, b], axis=1), ids[doc], hashes[doc])


def finer_table(batch: pa.RecordBatch, size: int) -> dict[str, np.ndarray] | None:
    leads, cores, covers, places, counts = [], [], [], [], []
    for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
        got = suffixes((text or "").encode("utf-8", "surrogatepass"), [(r["p"], r["a"], r["b"]) for r in runs], size)
        leads += got[0]
        cores += got[1]
        covers += got[2]
        places += got[3]
        counts.append(len(got[3]))
    if not places:
        return None
    ids, hashes = batch.column("id").to_numpy(), batch.column("text_hash").to_numpy()
    return table_of(leads, cores, covers, np.array(places), np.repeat(ids, counts), np.repeat(hashes, counts))


class Splitters:
    """Ranges of the order of whole keys: the five words, then the place, in which even equal texts differ."""

    KEY = [*WORDS, "id", "text_hash", "p", "a"]

    def __init__(self, sample: list[tuple[int, ...]], ranges: int):
        keys = sorted(sample)
        self.keys = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
        self.leads = np.array([k[0] for k in self.keys], np.uint64)

    def range_of(self, table: dict[str, np.ndarray]) -> np.ndarray:
        lead = table["lead"]
        low, high = np.searchsorted(self.leads, lead, "left"), np.searchsorted(self.leads, lead, "right")
        out = low.astype(np.int32)
        for i in np.flatnonzero(low < high).tolist():
            key = tuple(int(table[k][i]) for k in self.KEY)
            out[i] = bisect_right(self.keys, key, int(low[i]), int(high[i]))
        return out


def batch_of(table: dict[str, np.ndarray], chosen: np.ndarray | slice = slice(None), **more: np.ndarray) -> pa.RecordBatch:
    columns = {k: (v[chosen].view(np.int64) if k in WORDS else v[chosen].astype(np.int32 if k in "pab" else np.int64)) for k, v in table.items()}
    columns |= more
    return pa.record_batch([pa.array(v) for v in columns.values()], list(columns))


def sorted_by_words(words: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: all rows by the first word, then at each next word only what is equal so far."""
    order = np.argsort(words[0], kind="quicksort")
    starts = np.arange(len(order)) == 0
    for before, word in zip(words, words[1:], strict=False):
        starts[1:] |= before[order][1:] != before[order][:-1]
        group = np.cumsum(starts)
        tied = ~starts
        tied[:-1] |= ~starts[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        order[rows] = order[rows][np.lexsort((word[order[rows]], group[rows]))]
    return order


def compared(table: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The suffixes of one range that repeat (COVERED) or need finer runs (REFINE), and its ends with their words."""
    words = [table[w] for w in WORDS]
    order = sorted_by_words(words)
    ranked = {k: v[order] for k, v in table.items()}
    n = len(order)
    core = np.ones(n - 1, bool)
    for w in WORDS[:3]:
        core &= ranked[w][1:] == ranked[w][:-1]
    cover = core & (ranked["cover_a"][1:] == ranked["cover_a"][:-1]) & (ranked["cover_b"][1:] == ranked["cover_b"][:-1])
    repeats, first = np.zeros(n, bool), np.ones(n, bool)
    repeats[1:] |= cover
    repeats[:-1] |= cover
    first[1:] = ~cover
    group = np.concatenate([[0], np.cumsum(~core)])
    several = np.zeros(group[-1] + 1, bool)
    several[group[1:][core & ~cover]] = True
    ends = np.array([0, n - 1])
    kinds = [(np.flatnonzero(repeats), COVERED), (np.flatnonzero(first & several[group]), REFINE), (ends[:1], FIRST), (ends[1:], LAST)]
    for rows, kind in kinds:
        if len(rows):
            yield batch_of(ranked, rows, kind=np.full(len(rows), kind, np.int8))


def sort_and_compare(rows: DataFrame, make, splitters: Splitters, name: str) -> DataFrame:
    """kind (COVERED or REFINE) and place of the suffixes that ``make`` finds in batches of ``rows``."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, BLOCK_BYTES):
                table = make(piece)
                if table:
                    yield batch_of(table, range=splitters.range_of(table))

    def in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        table = {k: got.column(k).to_numpy() for k in [*WORDS, *PLACE]}
        table |= {w: table[w].view(np.uint64) for w in WORDS}
        number = got.column("range")[0].as_py()
        for out in compared(table):
            yield out.append_column("range", pa.array(np.full(out.num_rows, number, np.int32)))

    spread = rows.mapInArrow(dealt, SUFFIX + ", range int").repartitionById(len(splitters.keys) + 1, F.col("range"))
    found = settle(spread.mapInArrow(in_range, SUFFIX + ", kind byte, range int"), name)
    # two rows a range
    ends = found.filter(F.col("kind").isin(FIRST, LAST)).orderBy("range", "kind").collect()
    more = []
    for x, y in zip(ends, ends[1:], strict=False):
        if (x["kind"], y["kind"]) == (LAST, FIRST) and all(x[w] == y[w] for w in WORDS[:3]):
            kind = COVERED if all(x[w] == y[w] for w in WORDS[3:]) else REFINE
            more += [(kind, *[z[c] for c in PLACE]) for z in (x, y)]
    fields = "kind byte, id long, text_hash long, p int, a int, b int"
    across = rows.sparkSession.createDataFrame(more, fields)
    return found.filter(F.col("kind").isin(COVERED, REFINE)).select("kind", *PLACE).unionByName(across)


def splitters_of(rows: DataFrame, make, ranges: int) -> Splitters:
    """From at most SAMPLE_SUFFIXES suffixes of ``rows``, the first ones in the order of a hash of their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, BLOCK_BYTES):
                table = make(piece)
                if table:
                    yield batch_of(table)

    chosen = rows.mapInArrow(run, SUFFIX).orderBy(F.xxhash64("id", "text_hash", "p", "a")).limit(SAMPLE_SUFFIXES)
    # written first: a collected limit would bring that many rows of every partition to the driver
    found = settle(chosen, "splitters").collect()
    unsigned = 1 << 64
    return Splitters([tuple(r[k] % unsigned if k in WORDS else r[k] for k in Splitters.KEY) for r in found], ranges)


def by_text(found: DataFrame, kind: int, name: str) -> DataFrame:
    """id, text_hash and the list ``name`` of the runs of one kind; a list is no longer than its text."""
    rows = found.filter(F.col("kind") == kind).select(*PLACE).distinct()
    return rows.groupBy("id", "text_hash").agg(F.collect_list(F.struct("p", "a", "b")).alias(name))


def covered_bytes(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans [begin, end) of the strings that start at the given ranges of starts."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b + LENGTH))
        else:
            spans.append((a, b + LENGTH))
    return spans


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes, null where all of the text stays).

    A null text is empty.  Texts below ``LENGTH`` bytes keep all bytes.  Repeated rows repeat each other.  A null doc_id stays null.
    No rows give no rows.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    texts = keyed(docs)
    chosen = texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCUMENTS)
    sample = texts.join(F.broadcast(chosen), "id", "left_semi").drop("doc_id")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(partitions(spark), 2 * size // SPARSE // RANGE_SUFFIXES + 1)
    found = sort_and_compare(texts.drop("doc_id"), sparse_table, splitters_of(sample, sparse_table, ranges), "sparse")
    lists = by_text(found, COVERED, "covered").join(by_text(found, REFINE, "runs"), ["id", "text_hash"], "full")
    touched = settle(texts.join(lists, ["id", "text_hash"]), "touched")

    covers = []
    open_runs = touched.filter("runs is not null").select("id", "text_hash", "text", "runs")
    for width, name in ((MIDDLE, "middle"), (1, "single")):
        make = lambda batch, width=width: finer_table(batch, width)
        chosen = open_runs.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCUMENTS)
        cuts = splitters_of(open_runs.join(F.broadcast(chosen), "id", "left_semi"), make, partitions(spark))
        found = sort_and_compare(open_runs, make, cuts, name)
        covers.append(by_text(found, COVERED, f"covered_{name}"))
        open_runs = touched.select("id", "text_hash", "text").join(by_text(found, REFINE, "runs"), ["id", "text_hash"])
    whole = touched.select("doc_id", "id", "text_hash", "text", "covered")
    for more in covers:
        whole = whole.join(more, ["id", "text_hash"], "left")

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        lists = [batch.column(c).to_pylist() for c in ("covered", "covered_middle", "covered_single")]
        for doc_id, text, *given in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), *lists, strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            spans = covered_bytes([(r["a"], r["b"]) for runs in given for r in runs or ()])
            edges = [0, *[x for s in spans for x in s], len(raw)]
            left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc_id, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if spans else None))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    changed = per_block(whole.drop("id", "text_hash"), kept, RESULT + ", kept binary")
    plain = texts.select(
        "doc_id", "id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"),
    ).join(lists.select("id", "text_hash"), ["id", "text_hash"], "left_anti")
    return changed.unionByName(plain.drop("id", "text_hash"))
