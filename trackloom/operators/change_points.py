"""Change points of a signal: the cheapest cut of each contiguous run into backward, static and forward segments.

The cost of a cut is the squared error around the segment means plus a penalty per segment; forward and backward never touch.
Everything that grows with the signal (noise, medians, prefix sums, candidate boundaries) is a chunked scan or a counted
quantile; the program itself sees the prefix sums at no more than ``max_boundaries`` candidate boundaries of a run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.lineage import checkpointed
from trackloom.operators.ordered import by_step, carried, previous, row_number, running_sum, runs, total
from trackloom.operators.quantiles import quantiles

SPAN = 8192
STATES = ("backward", "static", "forward")
TO_SIGMA = 1.4826
TINY = 1e-6


# The defaults must give the results that users know.
@dataclass(frozen=True)
class Limits:
    min_length: int = 5
    penalty: float = 3.0
    band_floor: float = 0.05
    band_noise: float = 2.5
    clip: float = 4.0
    uncertain_variance: float = 9.0
    strong_change: float = 2.0
    stride: int = 12
    max_boundaries: int = 320


def best_cut(at: np.ndarray, sums: np.ndarray, squares: np.ndarray, band: float, penalty: float, least: int) -> list[tuple[int, int, int]]:
    """(begin, end, state) of the cheapest segments; neighbours of one state are joined.

    ``sums`` and ``squares`` are those of all values before the boundaries ``at``, which rise from 0 to the length of the run.
    Equal costs go to the earlier begin, then to the lower state.  A run shorter than ``least`` is one segment.
    """
    last = len(at) - 1
    cost = np.full((3, last + 1), np.inf)  # of the best cut up to a boundary whose last segment has that state
    before = np.full((3, last + 1), np.inf)  # the best one that may come before a segment of that state
    begin, earlier = np.zeros((3, last + 1), int), np.zeros((3, last + 1), int)
    for end in range(1, last + 1):
        size = at[end] - at[:end]
        mean = (sums[end] - sums[:end]) / size
        error = np.maximum(0.0, (squares[end] - squares[:end]) / size - mean * mean) * size
        state = np.where(mean > band, 2, np.where(mean < -band, 0, 1))
        whole = before[state, np.arange(end)] + penalty + error
        whole[0] = error[0]
        allowed = size >= least
        allowed[0] |= end == last
        whole[~allowed] = np.inf
        for s in range(3):
            mine = np.where(state == s, whole, np.inf)
            begin[s, end] = np.argmin(mine)
            cost[s, end] = mine[begin[s, end]]
        for s in range(3):
            near = range(max(0, s - 1), min(3, s + 2))
            earlier[s, end] = min(near, key=lambda q: (cost[q, end], q))
            before[s, end] = cost[earlier[s, end], end]
    state, end, found = int(np.argmin(cost[:, last])), last, []
    while end > 0:
        first = int(begin[state, end])
        if found and found[-1][2] == state:
            found[-1] = (int(at[first]), found[-1][1], state)
        else:
            found.append((int(at[first]), int(at[end]), state))
        state, end = int(earlier[state, first]), first
    return found[::-1]


def noise_scales(good: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """keys, noise: robust deviation of the steps between known values in order, over the whole key."""
    steps = by_step(keys, position, SPAN).scan(good, __before=previous(F.col(value))).withColumn("__step", F.col(value) - F.col("__before"))
    steps = steps.filter("__step is not null").select(*keys, "__step")
    middle = quantiles(steps, keys, "__step", __middle=0.5)
    off = steps.join(middle, list(keys)).withColumn("__off", F.abs(F.col("__step") - F.col("__middle")))
    return quantiles(off, keys, "__off", __mad=0.5).select(*keys, F.greatest(F.lit(TINY), TO_SIGMA * F.col("__mad") / F.sqrt(F.lit(2.0))).alias("noise"))


def measured_runs(good: DataFrame, keys: Sequence[str], position: str, value: str, limits: Limits) -> DataFrame:
    """Rows with ``run`` (its first position), ``idx`` (place in it), ``n`` (its length), noise, scale, band, and ``w``, the value clipped."""
    keys, v = list(keys), F.col(value)
    seen = by_step(keys, position, SPAN).scan(good, __at=previous(F.col(position)))
    head = F.when(F.col("__at").isNull() | (F.col(position) != F.col("__at") + 1), F.col(position))
    cut = by_step(keys, position, SPAN).scan(seen.withColumn("__head", head), run=carried(F.col("__head"))).drop("__at", "__head")
    cut = checkpointed(cut)
    of_run = [*keys, "run"]
    center = quantiles(cut, of_run, value, center=0.5)
    off = cut.join(center, of_run).withColumn("__off", F.abs(v - F.col("center")))
    spread = quantiles(off, of_run, "__off", mad=0.5)
    size = cut.groupBy(*of_run).agg(F.count("*").alias("n"))
    noise = F.coalesce("noise", F.lit(TINY))
    per_run = size.join(center, of_run).join(spread, of_run).join(noise_scales(good, keys, position, value), keys, "left").select(
        *of_run, "n", "center", noise.alias("noise"), F.greatest(noise, TO_SIGMA * F.col("mad"), F.lit(TINY)).alias("scale"),
        F.greatest(F.lit(limits.band_floor), limits.band_noise * noise).alias("band"),
    )
    reach = limits.clip * F.col("scale")
    clipped = F.least(F.col("center") + reach, F.greatest(F.col("center") - reach, v))
    return checkpointed(cut.join(per_run, of_run).withColumn("idx", F.col(position) - F.col("run")).withColumn("w", clipped).drop("center"))


def boundaries(rows: DataFrame, keys: Sequence[str], position: str, limits: Limits) -> DataFrame:
    """One row per run: n, noise, band and the candidate boundaries with the sums before them, at most ``max_boundaries``."""
    of_run, w, idx, n = [*keys, "run"], F.col("w"), F.col("idx"), F.col("n")
    in_run = by_step(of_run, position, SPAN)
    summed = in_run.scan(rows, __s=running_sum(w), __q=running_sum(w * w), __w=previous(w))
    least = F.greatest(F.lit(1), F.least(F.lit(limits.min_length), n))
    stride = F.greatest(least, F.lit(limits.stride))
    regular = (idx >= least) & ((idx - least) % stride == 0)
    strong = (idx >= least) & (idx <= n - least) & (F.abs(w - F.col("__w")) >= limits.strong_change * F.greatest(F.col("noise"), F.lit(1e-9)))
    marked = summed.filter((idx > 0) & (regular | strong)).select(*of_run, position, "idx", (F.col("__s") - w).alias("s"), (F.col("__q") - w * w).alias("q"))
    inner = in_run.scan(marked, __place=row_number(), __all=total(1))
    keep = limits.max_boundaries - 2
    # of too many, evenly spaced ones stay
    spaced = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda k: F.bround(k * (F.col("__all") - 1) / max(1, keep - 1)).cast("long"))
    picks = inner.filter(F.col("__all") > keep).select(*of_run, "__all").distinct().select(*of_run, F.explode(F.array_distinct(spaced)).alias("__pick"))
    few = inner.filter(F.col("__all") <= keep).select(*of_run, "idx", "s", "q")
    many = inner.filter(F.col("__all") > keep).withColumn("__pick", F.col("__place") - 1).join(picks, [*of_run, "__pick"]).select(*of_run, "idx", "s", "q")
    ends = rows.groupBy(*of_run).agg(F.count("*").alias("idx"), F.sum("w").alias("s"), F.sum(w * w).alias("q"))
    points = few.unionByName(many).unionByName(ends).groupBy(*of_run).agg(F.array_sort(F.collect_list(F.struct("idx", "s", "q"))).alias("points"))
    per_run = rows.filter(idx == 0).select(*of_run, "n", "noise", "band")
    return points.join(per_run, of_run)


def cut_runs(bounded: DataFrame, keys: Sequence[str], limits: Limits) -> DataFrame:
    """keys, run, begin, end, state."""
    of_run = [*keys, "run"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                at, s, q = (np.array([0, *[p[k] for p in row["points"]]], float) for k in ("idx", "s", "q"))
                unit = max(row["noise"], limits.band_floor, TINY)
                least = max(1, min(limits.min_length, row["n"]))
                for begin, end, state in best_cut(at.astype(int), s, q, row["band"], limits.penalty * unit * unit, least):
                    out.append((*[row[k] for k in of_run], begin, end, STATES[state]))
            yield pd.DataFrame(out, columns=[*of_run, "begin", "end", "state"])

    types = {f.name: f.dataType.simpleString() for f in bounded.schema.fields}
    return bounded.mapInPandas(work, ", ".join(f"{k} {types[k]}" for k in of_run) + ", begin long, end long, state string")


def certainty(limits: Limits) -> Column:
    """How well level, spread and length of a segment speak for its state, 0 to 1; below one half where the spread is too large."""
    c = F.col
    far = F.abs("robust_level") / F.greatest(c("band"), F.lit(1e-9))
    separation = F.when(c("state") == "static", F.greatest(F.lit(0.0), 1 - far)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), far - 1)))
    stability = 1 / (1 + c("residual_variance") / F.greatest(c("scale") * c("scale"), F.lit(1e-12)))
    least = F.greatest(F.lit(1), F.least(F.lit(limits.min_length), c("n")))
    support = F.least(F.lit(1.0), c("duration_frames") / F.greatest(F.lit(1.0), 2.0 * least))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 * separation + 0.4 * stability + 0.15 * support))
    unit = F.greatest(c("noise"), c("band") / max(1.0, limits.band_noise), F.lit(TINY))
    return F.when(c("residual_variance") > limits.uncertain_variance * unit * unit, F.least(value, F.lit(0.49))).otherwise(value)


def change_points(df: DataFrame, keys: Sequence[str], position: str, value: str, available: Column, limits: Limits = Limits()) -> DataFrame:
    """keys, start_frame, end_frame, duration_frames, state, robust_level, residual_variance, confidence.

    ``position`` is an integer that occurs once per key.  Rows that are not available, null and not finite values are segments of
    state unknown and end a run, and so does a missing position.
    """
    keys = list(keys)
    known = F.coalesce(available, F.lit(False)) & F.col(value).isNotNull() & (F.abs(F.col(value)) < float("inf")) & ~F.isnan(value)
    taken = df.select(*keys, F.col(position).cast("long").alias(position), F.col(value).cast("double").alias(value), known.alias("__known"))
    rows = measured_runs(taken.filter("__known").drop("__known"), keys, position, value, limits)
    of_run = [*keys, "run"]
    cuts = checkpointed(cut_runs(boundaries(rows, keys, position, limits), keys, limits))
    heads = cuts.select(*of_run, (F.col("run") + F.col("begin")).alias(position), F.struct("begin", "state").alias("__cut"))
    placed = by_step(of_run, position, SPAN).scan(rows.join(heads, [*of_run, position], "left"), cut=carried(F.col("__cut"))).drop("__cut")
    of_cut = [*of_run, "cut"]
    levels = quantiles(placed, of_cut, value, robust_level=0.5)
    v = F.col(value)
    sums = placed.groupBy(*of_cut).agg(
        F.min(position).alias("start_frame"), F.max(position).alias("end_frame"), F.count("*").alias("duration_frames"),
        F.sum(v).alias("__v"), F.sum(v * v).alias("__vv"), *[F.first(k).alias(k) for k in ("n", "noise", "scale", "band")],
    )
    size, level = F.col("duration_frames"), F.col("robust_level")
    variance = F.greatest(F.lit(0.0), (F.col("__vv") - 2 * level * F.col("__v")) / size + level * level)
    joined = sums.join(levels, of_cut).withColumn("state", F.col("cut.state")).withColumn("residual_variance", variance)
    names = [*keys, "start_frame", "end_frame", "duration_frames", "state", "robust_level", "residual_variance"]
    segments = joined.select(*names, certainty(limits).alias("confidence"))
    gaps = runs(taken.filter(~F.col("__known")).select(*keys, position, F.lit("unknown").alias("state")), keys, position, "state", contiguous=True)
    none = F.lit(None).cast("double")
    unknown = gaps.select(*keys, "start_frame", "end_frame", F.col("frames").alias("duration_frames"), "state", none.alias("robust_level"), none.alias("residual_variance"), F.lit(0.0).alias("confidence"))
    return segments.unionByName(unknown)
