"""Linking across gaps and frames: fragments of tracks into chains, and boxes of two sources by several cues."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.components import connected_components
from trackloom.operators.lineage import checkpointed
from trackloom.operators.matching import greedy_per_group
from trackloom.operators.ordered import Ordered, by_step, row_number

BOX = ("x1", "y1", "x2", "y2")
#: Candidate pairs of a whole video that are looked at in one go; more come in further goes.
PAIRS = 1 << 20


def box_iou(a: str, b: str) -> Column:
    """Overlap of two boxes given by the prefixes of their columns; 0 for boxes without area."""
    c = F.col
    wide = F.greatest(F.lit(0.0), F.least(c(f"{a}x2"), c(f"{b}x2")) - F.greatest(c(f"{a}x1"), c(f"{b}x1")))
    high = F.greatest(F.lit(0.0), F.least(c(f"{a}y2"), c(f"{b}y2")) - F.greatest(c(f"{a}y1"), c(f"{b}y1")))
    area = lambda p: F.greatest(F.lit(0.0), c(f"{p}x2") - c(f"{p}x1")) * F.greatest(F.lit(0.0), c(f"{p}y2") - c(f"{p}y1"))
    union = area(a) + area(b) - wide * high
    return F.when(union > 0, wide * high / union).otherwise(0.0)


def fragment_pairs(fragments: DataFrame, keys: Sequence[str], max_gap: int, min_iou: float, max_distance: float, width: float, height: float) -> DataFrame:
    """(end_id, start_id, first_frame, merge_score) of all fragments of which one may continue the other.

    Ends and starts meet in blocks of ``max_gap`` frames and in cells that are as wide as the largest box and the largest
    distance, so far fragments of a crowded video never form a pair.
    """
    on = [*keys, "label", "prior"]
    side = lambda p, k: F.col(f"{p}_{k}2") - F.col(f"{p}_{k}1")
    largest = fragments.agg(*[F.max(F.greatest(side("s", k), side("e", k))).alias(k) for k in "xy"]).first()
    # distances are measured in units of at least one
    cell = {"x": max(largest["x"] or 0.0, max_distance * max(1.0, width), 1e-9), "y": max(largest["y"] or 0.0, max_distance * max(1.0, height), 1e-9)}
    at = lambda p, k: F.floor((F.col(f"{p}_{k}1") + F.col(f"{p}_{k}2")) / 2 / cell[k]).cast("long")
    step = max(1, max_gap)
    block = lambda frame: F.floor(frame / F.lit(step)).cast("long")
    around = F.array(*[F.struct((at("e", "x") + i).alias("ix"), (at("e", "y") + j).alias("iy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    blocks = F.array_distinct(F.array(block(F.col("last_frame") + 1), block(F.col("last_frame") + step)))
    ends = fragments.withColumn("block", F.explode(blocks)).withColumn("c", F.explode(around))
    ends = ends.select(*on, "block", "c.ix", "c.iy", F.col("fragment_id").alias("end_id"), "last_frame", *[F.col(f"e_{b}") for b in BOX])
    starts = fragments.select(*on, block(F.col("first_frame")).alias("block"), at("s", "x").alias("ix"), at("s", "y").alias("iy"), F.col("fragment_id").alias("start_id"), "first_frame", *[F.col(f"s_{b}") for b in BOX])
    middle = lambda p, k: (F.col(f"{p}_{k}1") + F.col(f"{p}_{k}2")) / 2
    apart = F.sqrt(F.pow((middle("s", "x") - middle("e", "x")) / max(1.0, width), 2) + F.pow((middle("s", "y") - middle("e", "y")) / max(1.0, height), 2))
    pairs = ends.join(starts, [*on, "block", "ix", "iy"]).withColumn("iou", box_iou("s_", "e_")).withColumn("apart", apart)
    gap = F.col("first_frame") - F.col("last_frame")
    near = (F.col("iou") >= min_iou) | (F.col("apart") <= max_distance)
    return pairs.filter((gap >= 1) & (gap <= max_gap) & near).select("end_id", "start_id", "first_frame", (F.col("iou") - F.col("apart")).alias("merge_score"))


def chain_heads(links: DataFrame, item: str, before: str) -> DataFrame:
    """(item, head): the first item of the chain of each item that has one before it; every round doubles the reach."""
    current = checkpointed(links.select(F.col(item).alias("item"), F.col(before).alias("head")))
    while True:
        above = current.select(F.col("item").alias("head"), F.col("head").alias("above"))
        jumped = checkpointed(current.join(above, "head", "left").select("item", F.coalesce("above", "head").alias("head"), F.col("above").isNotNull().alias("moved")))
        if jumped.filter("moved").isEmpty():
            return jumped.select("item", "head")
        current = jumped.drop("moved")


def _spans(rows: dict[str, np.ndarray], kind: np.ndarray, max_gap: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments in order of the place of their end, and where the ends that a start may meet begin and stop there.

    Ends lie by kind, cell across and last frame, so a start meets one stretch in its own cell and one in each cell beside it.
    """
    cell = lambda p: np.floor((rows[f"{p}_x1"] + rows[f"{p}_x2"]) / 2 / reach)
    cells, across = np.unique(cell("e"), return_inverse=True)
    frames, last = np.unique(rows["last_frame"], return_inverse=True)
    place = (kind * len(cells) + across) * len(frames) + last
    ends = np.argsort(place, kind="stable")
    ends = ends[kind[ends] >= 0]
    place = place[ends]
    first = rows["first_frame"]
    earliest, beyond = np.searchsorted(frames, first - max_gap), np.searchsorted(frames, first)
    begin, stop = [], []
    for side in (-1, 0, 1):
        wanted = cell("s") + side
        at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
        some = (kind >= 0) & (cells[at] == wanted) & (beyond > earliest)
        base = (kind * len(cells) + at) * len(frames)
        begin.append(np.searchsorted(place, base + earliest))
        stop.append(np.where(some, np.searchsorted(place, base + beyond), begin[-1]))
    return ends, np.stack(begin, 1), np.stack(stop, 1)


def _continued(rows: dict[str, np.ndarray], kind: np.ndarray, max_gap: int, min_iou: float, max_distance: float, width: float, height: float) -> tuple[np.ndarray, np.ndarray]:
    """For the fragments of a video in order of first frame and id: the place of the one that each continues (-1: none), and the score.

    ``kind`` numbers label and prior; fragments of a negative one have no links.
    """
    n, wide, high = len(kind), max(1.0, width), max(1.0, height)
    widest = max((rows[f"{p}_x2"] - rows[f"{p}_x1"]).max() for p in "se")
    # a little more, for centres that are rounded
    ends, begin, stop = _spans(rows, kind, max_gap, max(widest, max_distance * wide, 1e-9) * (1 + 1e-9))
    sizes = stop - begin
    upto = np.cumsum(sizes.sum(1))
    before, scores, taken = [-1] * n, np.full(n, np.nan), bytearray(n)
    area = lambda x1, y1, x2, y2: np.maximum(0.0, x2 - x1) * np.maximum(0.0, y2 - y1)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        size, origin = sizes[lo:hi].ravel(), begin[lo:hi].ravel()
        s = np.repeat(np.repeat(np.arange(lo, hi), 3), size)
        e = ends[np.repeat(origin - np.cumsum(size) + size, size) + np.arange(len(s))]
        a, b = [rows[f"s_{k}"][s] for k in BOX], [rows[f"e_{k}"][e] for k in BOX]
        both = np.maximum(0.0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])) * np.maximum(0.0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
        union = area(*a) + area(*b) - both
        iou = np.divide(both, union, out=np.zeros(len(s)), where=union > 0)
        apart = np.sqrt((((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2) / wide) ** 2 + (((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2) / high) ** 2)
        near = np.flatnonzero((iou >= min_iou) | (apart <= max_distance))
        s, e, score = s[near], e[near], (iou - apart)[near]
        order = np.lexsort((rows["fragment_id"][e], -score, s))
        for start, end, value in zip(s[order].tolist(), e[order].tolist(), score[order].tolist(), strict=True):
            if before[start] < 0 and not taken[end]:
                before[start], scores[start], taken[end] = end, value, 1
        lo = hi
    return np.array(before), scores


def linked_whole(fragments: DataFrame, keys: Sequence[str], max_gap: int, min_iou: float, max_distance: float, width: float, height: float) -> DataFrame:
    """``linked_fragments`` of videos that fit one task; fragments spread by the keys stay where they are."""
    boxes = [f"{p}_{b}" for p in "se" for b in BOX]
    numbers = ["fragment_id", "first_frame", "last_frame"]

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("first_frame", "ascending"), ("fragment_id", "ascending")])
        rows = {c: table[c].to_numpy() for c in (*numbers, *boxes)}
        kind = np.zeros(len(table), np.int64)
        for c in ("label", "prior"):
            codes = table[c].combine_chunks().dictionary_encode()
            number = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            kind = np.where((kind < 0) | (number < 0), -1, kind * (len(codes.dictionary) + 1) + number)
        if not all(k.is_valid for k in key):
            kind[:] = -1
        before, score = _continued(rows, kind, max_gap, min_iou, max_distance, width, height)
        chain = list(range(len(before)))
        for place in np.flatnonzero(before >= 0).tolist():
            chain[place] = chain[before[place]]
        ids, none = rows["fragment_id"], before < 0
        out = {k: table[k] for k in keys} | {"fragment_id": table["fragment_id"], "chain_id": pa.array(ids[chain])}
        return pa.table(out | {"linked_to": pa.array(ids[before], mask=none), "merge_score": pa.array(score, mask=none)})

    typed = fragments.select(*keys, *[F.col(c).cast("long") for c in numbers], "label", "prior", *[F.col(c).cast("double") for c in boxes])
    kinds = ", ".join(f"`{k}` {typed.schema[k].dataType.simpleString()}" for k in keys)
    return typed.groupBy(*keys).applyInArrow(work, f"{kinds}, fragment_id long, chain_id long, linked_to long, merge_score double")


def linked_fragments(
    fragments: DataFrame, keys: Sequence[str], max_gap: int = 2, min_iou: float = 0.2, max_distance: float = 0.1, width: float = 1.0, height: float = 1.0, whole: bool = False
) -> DataFrame:
    """fragment_id, chain_id (its first fragment), linked_to (the fragment it continues, or null), merge_score.

    ``fragments`` has the keys of a video, fragment_id (unique over all), label, prior, first_frame, last_frame and the boxes
    s_x1 ... of its start and e_x1 ... of its end.  In the order of first frame, then id, each start takes the free end with
    the largest overlap less distance; ends of equal score go by id.  An end has one continuation.  Groups of starts and
    ends that share no candidate don't meet, however long the video is.  ``whole`` videos fit one task and have no null or NaN
    in ids, frames and boxes: each is linked in one piece, which gives the same.
    """
    if whole:
        return linked_whole(fragments, keys, max_gap, min_iou, max_distance, width, height)
    pairs = checkpointed(fragment_pairs(fragments, keys, max_gap, min_iou, max_distance, width, height))
    # a fragment's end and its start are nodes of their own
    edges = pairs.select((F.col("end_id") * 2).alias("a"), (F.col("start_id") * 2 + 1).alias("b"))
    groups = connected_components(edges).select((F.col("node") / 2).cast("long").alias("end_id"), "component", (F.col("node") % 2 == 0).alias("is_end"))
    grouped = pairs.join(groups.filter("is_end").drop("is_end"), "end_id")
    ranked = grouped.select("component", F.struct("first_frame", "start_id").alias("start"), "end_id", (-F.col("merge_score")).alias("cost"))
    chosen = greedy_per_group(ranked, ["component"], "start", "end_id", "cost")
    links = checkpointed(chosen.select(F.col("start.start_id").alias("fragment_id"), F.col("end_id").alias("linked_to"), (-F.col("cost")).alias("merge_score")))
    heads = chain_heads(links, "fragment_id", "linked_to").select(F.col("item").alias("fragment_id"), F.col("head").alias("chain_id"))
    out = fragments.select(*keys, "fragment_id").join(links, "fragment_id", "left").join(heads, "fragment_id", "left")
    return out.select(*keys, "fragment_id", F.coalesce("chain_id", "fragment_id").alias("chain_id"), "linked_to", "merge_score")


def previous_frame_links(objects: DataFrame, keys: Sequence[str], radius: float, span: int = 256) -> DataFrame:
    """keys, frame_index, item, linked_to, first_item (the first object of its chain), object_number (of the chain, from 0).

    ``objects`` has the keys of a video, frame_index, item (unique over all; its order is that of a frame), label and the centre
    (x, y).  An object continues the nearest one of its label in the frame before, nearer than ``radius``; of equally near ones the
    first.  The frame before is the last one with objects.  Several objects may continue the same one and then share its
    number.  Objects meet by square cells of the radius; chains are followed by doubling, so a long video is many tasks.
    """
    keys = list(keys)
    frames = by_step(keys, "frame_index", span).scan(objects.select(*keys, "frame_index").distinct(), __n=row_number())
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    at = checkpointed(objects.join(frames, [*keys, "frame_index"]).withColumns({"ix": cell("x"), "iy": cell("y")}))
    around = F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    now = at.withColumn("c", F.explode(around)).select(*keys, "label", (F.col("__n") - 1).alias("__n"), "c.ix", "c.iy", "item", "x", "y")
    before = at.select(*keys, "label", "__n", "ix", "iy", F.col("item").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    far = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    met = now.join(before, [*keys, "label", "__n", "ix", "iy"]).withColumn("far", far).filter(F.col("far") < radius)
    links = checkpointed(met.groupBy("item").agg(F.min(F.struct("far", "other"))["other"].alias("linked_to")))
    heads = chain_heads(links, "item", "linked_to").withColumnRenamed("head", "first_item")
    first = at.join(links, "item", "left_anti")
    numbers = Ordered(keys, ["frame_index", "item"], F.floor(F.col("frame_index") / F.lit(span))).scan(first.select(*keys, "frame_index", "item"), __k=row_number())
    numbers = numbers.select(F.col("item").alias("first_item"), (F.col("__k") - 1).alias("object_number"))
    out = at.select(*keys, "frame_index", "item").join(links, "item", "left").join(heads, "item", "left")
    return out.withColumn("first_item", F.coalesce("first_item", "item")).join(numbers, "first_item").select(*keys, "frame_index", "item", "linked_to", "first_item", "object_number")


def cue_score(cues: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the cues that are there (not null); 0 without any."""
    used = {k: (value, weight) for k, (value, weight) in cues.items() if weight > 0}
    present = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in used.values()), F.lit(0.0))
    total = sum((F.coalesce(v * float(w), F.lit(0.0)) for v, w in used.values()), F.lit(0.0))
    return F.when(present > 0, total / present).otherwise(0.0)


def class_cue(a: Column, b: Column) -> Column:
    """1 for equal classes, 0 for others, one half where one of them is unknown."""
    unknown = lambda c: c.isNull() | c.isin("", "unknown")
    return F.when(unknown(a) | unknown(b), 0.5).otherwise((a == b).cast("double"))


def depth_cue(a: Column, b: Column) -> Column:
    return F.exp(-F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-6)))


def best_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total score, as many as the shorter side has, by shortest augmenting paths."""
    if score.shape[0] > score.shape[1]:
        return sorted((r, c) for c, r in best_assignment(score.T))
    rows, columns = score.shape
    cost = 1.0 - score
    of_row, of_column = np.zeros(rows), np.zeros(columns)
    holder = np.full(columns, -1)
    for row in range(rows):
        reach = cost[row] - of_row[row] - of_column
        came_from, done = np.full(columns, -1), np.zeros(columns, bool)
        while True:
            column = int(np.argmin(np.where(done, np.inf, reach)))
            done[column] = True
            if holder[column] < 0:
                break
            step = reach[column] + cost[holder[column]] - of_row[holder[column]] - of_column
            closer = ~done & (step < reach)
            reach[closer], came_from[closer] = step[closer], column
        length = reach[column]
        settled = done & (reach < length)
        of_row[row] += length
        of_row[holder[settled]] += length - reach[settled]
        of_column[settled] -= length - reach[settled]
        while came_from[column] >= 0:
            holder[column] = holder[came_from[column]]
            column = int(came_from[column])
        holder[column] = row
    return sorted((int(r), c) for c, r in enumerate(holder) if r >= 0)


def associated(pairs: DataFrame, keys: Sequence[str], first: str, second: str, score: str, least: float) -> DataFrame:
    """keys, first, second, score, outcome: the one-to-one assignment of each group with the largest total score.

    ``pairs`` has the score of every first with every second of a group, the objects of one frame, whose numbers are unique there.  Outcomes are matched,
    low_score (assigned with less than ``least``, so the pair is given up) and no_partner (left over; the other side is null).
    """
    keys = list(keys)
    item = {c: pairs.schema[c].dataType.simpleString() for c in (*keys, first, second)}
    frames = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(first).alias("a"), F.col(second).alias("b"), F.col(score).alias("score")))).alias("rows"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = [row[k] for k in keys]
                a, b = (sorted({r[k] for r in row["rows"]}) for k in "ab")
                table = np.zeros((len(a), len(b)))
                for r in row["rows"]:
                    table[a.index(r["a"]), b.index(r["b"])] = r["score"]
                found = best_assignment(table)
                out += [(*key, a[i], b[j], table[i, j], "matched" if table[i, j] >= least else "low_score") for i, j in found]
                out += [(*key, a[i], None, None, "no_partner") for i in set(range(len(a))) - {i for i, _ in found}]
                out += [(*key, None, b[j], None, "no_partner") for j in set(range(len(b))) - {j for _, j in found}]
            frame = pd.DataFrame(out, columns=[*keys, first, second, "score", "outcome"])
            yield frame.astype({c: "Int64" for c in (first, second) if item[c] in ("int", "bigint")})

    kinds = ", ".join(f"{c} {item[c]}" for c in (*keys, first, second))
    return frames.mapInPandas(work, f"{kinds}, score double, outcome string")
