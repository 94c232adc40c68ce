"""Order-dependent clean-up of short runs.

These rules read what earlier steps wrote, so they run as small pandas functions.  The unit of work is not the
video but a block of its run table that provably does not affect the rest: nothing passes between two
neighbouring runs that are both long, because long runs are neither relabelled nor absorbed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.ordered import by_step, carried, following, previous
from trackloom.operators.spread import spread

SPAN = 8192


def independent_blocks(run_table: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """The start frame of the block of each run; blocks end between neighbouring runs of at least ``least`` frames."""
    scan = by_step(keys, "start_frame", SPAN)
    seen = scan.scan(run_table, before=previous(F.col("frames")))
    joined = F.col("before").isNotNull() & ((F.col("before") < least) | (F.col("frames") < least))
    head = F.when(joined, None).otherwise(F.col("start_frame"))
    return scan.scan(seen.withColumn("head", head).drop("before"), block=carried(F.col("head"))).drop("head")


def _per_block(run_table: DataFrame, keys: Sequence[str], least: int, label: str, rewrite: Callable) -> DataFrame:
    """Rewrite each block; whole blocks are packed by position, so that a task gets a fair batch of them."""
    keys = list(keys)
    blocks = independent_blocks(run_table, keys, least).select(
        *keys,
        "block",
        F.floor(F.col("block") / SPAN).alias("pack"),
        "start_frame",
        "end_frame",
        F.col("frames").cast("bigint"),
        F.col("mean").cast("double"),
        label,
    )
    fields = [f for f in blocks.schema.fields if f.name not in ("block", "pack")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]
    columns = ["start_frame", "end_frame", "frames", "mean", label]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start_frame")
        parts: dict = {}
        for block, row in zip(pdf["block"].tolist(), pdf[columns].values.tolist()):
            parts.setdefault(block, []).append(row)
        out = pd.DataFrame([r for rows in parts.values() for r in rewrite(rows)], columns=columns)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[names]

    return spread(blocks, *keys, "pack").groupBy(*keys, "pack").applyInPandas(work, schema)


def _joined(a: list, b: list) -> list:
    """Two touching rows as one: start, end, frames, mean, label of the first."""
    frames = a[2] + b[2]
    return [a[0], b[1], frames, (a[3] * a[2] + b[3] * b[2]) / frames, a[4]]


def absorb_short_runs(run_table: DataFrame, keys: Sequence[str], label: str, least: int) -> DataFrame:
    """Repeatedly give the left-most short run to its longer neighbour (left on a tie)."""

    def rewrite(rows: list[list]) -> list[list]:
        done: list[list] = []
        todo = [list(r) for r in reversed(rows)]
        while todo:
            run = todo.pop()
            if done and done[-1][4] == run[4]:
                run = _joined(done.pop(), run)
            left, right = (done[-1] if done else None), (todo[-1] if todo else None)
            if run[2] >= least or (left is None and right is None):
                done.append(run)
            elif left is None or (right is not None and right[2] > left[2]):
                todo.pop()
                todo.append(_joined([*run[:4], right[4]], right))
            else:
                todo.append(_joined(done.pop(), run))
        return done

    return _per_block(run_table, keys, least, label, rewrite)


def smooth_short_runs(run_table: DataFrame, keys: Sequence[str], label: str, least: int) -> DataFrame:
    """One pass: a short run takes the label of its neighbours where they agree, or of its only neighbour.

    The label on the left is the already smoothed one; a short run between different labels stays.
    """

    def rewrite(rows: list[list]) -> list[list]:
        out: list[list] = []
        for i, run in enumerate(rows):
            run = list(run)
            left = out[-1][4] if out else None
            right = rows[i + 1][4] if i + 1 < len(rows) else None
            if run[2] < least:
                if left is not None and (right is None or left == right):
                    run[4] = left
                elif left is None and right is not None:
                    run[4] = right
            out.append(run)
        merged: list[list] = []
        for run in out:
            if merged and merged[-1][4] == run[4]:
                merged[-1] = _joined(merged[-1], run)
            else:
                merged.append(run)
        return merged

    return _per_block(run_table, keys, least, label, rewrite)


def bridge_interruptions(
    run_table: DataFrame,
    keys: Sequence[str],
    label: str,
    tolerance: int,
    total_frames: int = 15,
    anchor_frames: int = 8,
    max_runs: int = 5,
    anchor_ratio: float = 0.75,
) -> DataFrame:
    """Join two equal long anchors over a few short runs, left-most first, until nothing changes."""

    def bridged(rows: list[list], i: int) -> int | None:
        if rows[i][2] < anchor_frames:
            return None
        for j in range(i + 2, min(len(rows), i + max_runs + 2)):
            between = rows[j][0] - rows[i][1] - 1
            if between > total_frames:
                return None
            fits = (
                rows[j][4] == rows[i][4]
                and rows[j][2] >= anchor_frames
                and all(r[2] <= tolerance for r in rows[i + 1 : j])
                and between / max(1, min(rows[i][2], rows[j][2])) <= anchor_ratio
            )
            if fits:
                return j
        return None

    def rewrite(rows: list[list]) -> list[list]:
        i = 0
        while i < len(rows) - 2:
            j = bridged(rows, i)
            if j is None:
                i += 1
                continue
            weight = sum(r[2] for r in rows[i : j + 1])
            mean = sum(r[3] * r[2] for r in rows[i : j + 1]) / weight
            rows[i : j + 1] = [[rows[i][0], rows[j][1], rows[j][1] - rows[i][0] + 1, mean, rows[i][4]]]
            i = 0
        return rows

    return _per_block(run_table, keys, tolerance + 1, label, rewrite)


def assign_short_islands(run_table: DataFrame, keys: Sequence[str], label: str, tolerance: int) -> DataFrame:
    """Give each island of short runs to the long runs around it, split where the mean signal fits best."""

    def split(island: list[list], left: list, right: list) -> int:
        cost = lambda run, anchor: abs(run[3] - anchor[3]) * max(1, run[2])
        options = [
            (sum(cost(r, left) for r in island[:k]) + sum(cost(r, right) for r in island[k:]), abs(k - len(island) / 2), k)
            for k in range(len(island) + 1)
        ]
        return min(options)[2]

    def rewrite(rows: list[list]) -> list[list]:
        is_long = [r[2] > tolerance for r in rows]
        if not any(is_long):
            top = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
            relabelled = [[*r[:4], rows[top][4]] for r in rows]
        else:
            relabelled, i = [], 0
            while i < len(rows):
                if is_long[i]:
                    relabelled.append(rows[i])
                    i += 1
                    continue
                j = i
                while j < len(rows) and not is_long[j]:
                    j += 1
                left, right = (rows[i - 1] if i else None), (rows[j] if j < len(rows) else None)
                island = rows[i:j]
                k = split(island, left, right) if left and right else (len(island) if left else 0)
                relabelled += [[*r[:4], (left if n < k else right)[4]] for n, r in enumerate(island)]
                i = j
        out: list[list] = []
        for run in relabelled:
            if out and out[-1][4] == run[4]:
                out[-1] = _joined(out[-1], run)
            else:
                out.append(list(run))
        return out

    return _per_block(run_table, keys, tolerance + 1, label, rewrite)


def next_label(run_table: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    return by_step(keys, "start_frame", SPAN).scan(run_table, following_label=following(F.col(label)))
