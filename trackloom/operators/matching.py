"""One-to-one matching of boxes within a frame and of segments within a video."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.spread import spread


def greedy_per_group(pairs: DataFrame, keys: Sequence[str], first: str, second: str, cost: str) -> DataFrame:
    """Each ``first`` in order takes its cheapest free ``second``; ties go to the smaller ``second``.

    The candidate pairs of one group (the boxes of one frame, already filtered by a threshold) are folded inside
    a row, in the JVM.  The group is bounded by what one frame can hold.
    """
    options = pairs.groupBy(*keys, first).agg(
        F.array_sort(F.collect_list(F.struct(F.col(cost).alias("cost"), F.col(second).alias("item")))).alias("options")
    )
    lists = options.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(first).alias("item"), "options"))).alias("rows")
    )
    item1 = pairs.schema[first].dataType.simpleString()
    item2 = pairs.schema[second].dataType.simpleString()
    kind = f"array<struct<a:{item1},b:{item2},cost:double>>"
    start = F.array().cast(kind)

    def take(done: Column, row: Column) -> Column:
        used = F.transform(done, lambda m: m["b"])
        free = F.filter(row["options"], lambda o: ~F.array_contains(used, o["item"]))
        pick = F.transform(
            F.slice(free, 1, 1),
            lambda o: F.struct(row["item"].alias("a"), o["item"].alias("b"), o["cost"].cast("double").alias("cost")),
        )
        return F.concat(done, pick.cast(kind))

    matched = lists.select(*keys, F.explode(F.aggregate("rows", start, take)).alias("m"))
    return matched.select(*keys, F.col("m.a").alias(first), F.col("m.b").alias(second), F.col("m.cost").alias(cost))


def pooled_position_rates(boxes: DataFrame, keys: Sequence[str], item: str, radius: float) -> DataFrame:
    """Hits, false alarms, misses, precision, recall, F1 and mean distance of hits over all frames, as one row.

    ``boxes`` has the keys of a frame, an item number, source (gt or det) and centre (cx, cy).  In a frame each detection in
    order takes the nearest object that none before it took, within ``radius``.  Candidates meet by square cells of that
    size, so far boxes of a crowded frame never form a pair.  Frames without pairs count as misses and false alarms.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.array(*[F.struct((F.col("ix") + i).alias("ix"), (F.col("iy") + j).alias("iy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    at = boxes.withColumns({"ix": cell("cx"), "iy": cell("cy")})
    found = at.filter("source = 'det'").withColumn("c", F.explode(around)).select(*keys, F.col("c.ix"), F.col("c.iy"), F.col(item).alias("d"), F.col("cx").alias("dx"), F.col("cy").alias("dy"))
    truth = at.filter("source = 'gt'").select(*keys, "ix", "iy", F.col(item).alias("g"), "cx", "cy")
    far = F.sqrt(F.pow(F.col("dx") - F.col("cx"), 2) + F.pow(F.col("dy") - F.col("cy"), 2))
    pairs = found.join(truth, [*keys, "ix", "iy"]).select(*keys, "d", "g", far.alias("far")).filter(F.col("far") <= radius)
    hits = greedy_per_group(pairs, keys, "d", "g", "far").agg(F.count("*").alias("hits"), F.sum("far").alias("far"))
    totals = boxes.agg(F.count_if(F.col("source") == "gt").alias("truth"), F.count_if(F.col("source") == "det").alias("found"))
    both = hits.crossJoin(totals)  # one row each
    return both.select(
        "hits", (F.col("found") - F.col("hits")).alias("false_alarms"), (F.col("truth") - F.col("hits")).alias("misses"),
        (F.col("hits") / F.col("found")).alias("precision"), (F.col("hits") / F.col("truth")).alias("recall"),
        (2.0 * F.col("hits") / (F.col("found") + F.col("truth"))).alias("f1"), (F.col("far") / F.col("hits")).alias("mean_position_error"),
    )


def best_segment_assignment(pairs: DataFrame, keys: Sequence[str], block: int = 4096) -> DataFrame:
    """One-to-one assignment of two segmentations with the largest total IoU.

    ``pairs`` are the overlapping pairs (a_start, b_start, iou).  Segments of a timeline do not overlap each other,
    so the pairs in order of their overlap form chains in which only neighbours can share a segment, and the best
    assignment of a chain is a running choice.  Chains that share no segment are independent; whole chains are
    packed by position, so a long video is many groups.
    """
    from trackloom.operators.ordered import Ordered, carried, previous

    keys = list(keys)
    at = F.greatest("a_start", "b_start")
    rows = pairs.select(*keys, at.cast("bigint").alias("at"), F.col("a_start").cast("bigint"), F.col("b_start").cast("bigint"), F.col("iou").cast("double"))
    scan = Ordered(keys, ["at"], F.floor(F.col("at") / F.lit(block)))
    seen = scan.scan(rows, pa=previous(F.col("a_start")), pb=previous(F.col("b_start")))
    linked = (F.col("pa") == F.col("a_start")) | (F.col("pb") == F.col("b_start"))
    heads = seen.withColumn("head", F.when(F.coalesce(linked, F.lit(False)), None).otherwise(F.col("at"))).drop("pa", "pb")
    chained = scan.scan(heads, chain=carried(F.col("head"))).withColumn("pack", F.floor(F.col("chain") / block)).drop("head")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        a, b, w = pdf["a_start"].tolist(), pdf["b_start"].tolist(), pdf["iou"].tolist()
        n = len(w)
        total, before, take = [0.0] * (n + 1), [0] * n, [False] * n
        for k in range(n):
            j = k
            while j > 0 and (a[j - 1] == a[k] or b[j - 1] == b[k]):
                j -= 1
            before[k] = j
            with_k = total[j] + w[k]
            take[k] = with_k > total[k]
            total[k + 1] = max(total[k], with_k)
        chosen, k = [], n - 1
        while k >= 0:
            if take[k]:
                chosen.append(k)
                k = before[k] - 1
            else:
                k -= 1
        return pdf.iloc[sorted(chosen)][[*keys, "a_start", "b_start", "iou"]]

    types = {f.name: f.dataType.simpleString() for f in chained.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "a_start", "b_start", "iou"])
    return spread(chained, *keys, "pack").groupBy(*keys, "pack").applyInPandas(work, schema)
