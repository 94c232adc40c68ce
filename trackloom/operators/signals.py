"""Ordered signals: smoothing, differences, thinning."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trackloom.operators.ordered import by_step, near, previous

START, END = W.unboundedPreceding, W.unboundedFollowing


def thin_frames(df: DataFrame, frame: str, source_fps: float, target_fps: float) -> DataFrame:
    """Keep every k-th frame and renumber; k is the rounded ratio of rates, at least 1."""
    k = max(1, round(source_fps / target_fps))
    return df.filter(F.col(frame) % k == 0).withColumn(frame, F.floor(F.col(frame) / k).cast("int"))


# The means below differ only at the ends of a series; each is a function WindowSpec -> Column for ``near``.


def edge_padded_mean(value: str, width: int) -> Callable:
    """The ends repeat the first and last value; an even width looks one further to the left."""
    left, right = width // 2, width - 1 - width // 2
    v, one = F.col(value), F.lit(1)

    def make(w) -> Column:
        around = w.rowsBetween(-left, right)
        missing = lambda size, frame: F.lit(size) - F.count(one).over(frame) if size else F.lit(0)
        before = missing(left, w.rowsBetween(-left, -1))
        after = missing(right, w.rowsBetween(1, right))
        total = F.sum(v).over(around) + before * F.first(v).over(around) + after * F.last(v).over(around)
        return total / width

    return make


def odd(width: int) -> int:
    return width if width % 2 else width + 1


def shrinking_mean(value: str, width: int) -> Callable:
    half = odd(width) // 2
    return lambda w: F.avg(value).over(w.rowsBetween(-half, half))


def zero_padded_mean(value: str, width: int) -> Callable:
    """Missing neighbours count as zero."""
    left, right = width // 2, width - 1 - width // 2
    return lambda w: F.sum(value).over(w.rowsBetween(-left, right)) / width


def rolling_median(value: str, radius: int) -> Callable:
    return lambda w: F.percentile(F.col(value), F.lit(0.5)).over(w.rowsBetween(-radius, radius))


def rolling(df: DataFrame, keys: Sequence[str], position: str, reach: int, **columns: Callable) -> DataFrame:
    return near(df, keys, position, reach, **columns)


def presence_mean(df: DataFrame, keys: Sequence[str], frame: str, value: str, half: int, name: str) -> DataFrame:
    """Mean over observed frames within ``half`` frame units, gaps not filled."""
    return near(
        df, keys, frame, half, **{name: lambda w: F.avg(value).over(w.rangeBetween(-half, half))}
    )


def central_velocity(
    df: DataFrame, keys: Sequence[str], position: str, seconds: str, values: Sequence[str], sigma: str, multiplier: float
) -> DataFrame:
    """Central differences with the row itself standing in at the ends, and a speed interval from the noise."""
    at_edge = lambda w, c, back: F.coalesce((F.lag(c) if back else F.lead(c)).over(w), F.col(c))
    cols = [seconds, *values, sigma]
    made = {f"l_{c}": (lambda w, c=c: at_edge(w, c, True)) for c in cols}
    made |= {f"r_{c}": (lambda w, c=c: at_edge(w, c, False)) for c in cols}
    wide = near(df, keys, position, 1, **made)
    dt = F.col(f"r_{seconds}") - F.col(f"l_{seconds}")
    parts = [(F.col(f"r_{v}") - F.col(f"l_{v}")) / dt for v in values]
    speed = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    noise = multiplier * F.sqrt(len(values) * (F.pow(f"r_{sigma}", F.lit(2)) + F.pow(f"l_{sigma}", F.lit(2)))) / dt
    known = dt > 1e-9
    return wide.select(
        *df.columns,
        F.when(known, speed).alias("speed"),
        F.when(known, F.greatest(F.lit(0.0), speed - noise)).alias("speed_low"),
        F.when(known, speed + noise).alias("speed_high"),
    )


def timestamp_velocity(df: DataFrame, keys: Sequence[str], position: str, micros: str, values: Sequence[str]) -> DataFrame:
    """Backward differences per second; the first row copies the second; zero where time does not advance."""

    def back(c):
        def make(w):
            dt = (F.col(micros) - F.lag(micros).over(w)) / 1e6
            own = F.when(dt > 0, (F.col(c) - F.lag(c).over(w)) / dt).when(dt <= 0, 0.0)
            next_dt = (F.lead(micros).over(w) - F.col(micros)) / 1e6
            ahead = F.when(next_dt > 0, (F.lead(c).over(w) - F.col(c)) / next_dt).when(next_dt <= 0, 0.0)
            return F.coalesce(own, F.when(F.lag(micros).over(w).isNull(), ahead), F.lit(0.0))

        return make

    return near(df, keys, position, 1, **{f"v_{c}": back(c) for c in values})


def future_flags(df: DataFrame, keys: Sequence[str], position: str, flag: Column, horizons: Sequence[int]) -> DataFrame:
    """Whether the flag holds within the next k rows, for each k."""
    hit = F.when(flag, 1).otherwise(0)
    make = lambda k: lambda w: F.coalesce(F.max(hit).over(w.rowsBetween(1, k)), F.lit(0)) == 1
    return near(df, keys, position, max(horizons), **{f"within_{k}": make(k) for k in horizons})


def spikes(df: DataFrame, keys: Sequence[str], position: str, value: str, history: int, sigmas: float, least: int) -> DataFrame:
    """Values above mean plus sigmas deviations of the preceding ones, given enough of them."""

    def make(w):
        past = w.rowsBetween(-history, -1)
        limit = F.avg(value).over(past) + sigmas * F.stddev_pop(value).over(past)
        return F.coalesce((F.count(value).over(past) >= least) & (F.col(value) > limit), F.lit(False))

    return near(df, keys, position, history, spike=make)


def transitions(df: DataFrame, keys: Sequence[str], order: str, state: str, reversal: tuple[str, str], span: int = 8192) -> DataFrame:
    """Changes of a label sequence per key and how many of them swap the reversal pair."""
    seen = by_step(keys, order, span).scan(df.filter(F.col(state) != "unknown"), before=previous(F.col(state)))
    a, b = reversal
    now, before = F.col(state), F.col("before")
    swap = ((now == a) & (before == b)) | ((now == b) & (before == a))
    return seen.groupBy(*keys).agg(
        F.count_if(now != before).alias("transitions"), F.count_if(swap).alias("reversals")
    )


def history(df: DataFrame, keys: Sequence[str], position: str, value: str, back: int, padding: str) -> DataFrame:
    """The last ``back`` values and the current one as an array, padded on the left, and how many were there."""
    seen = near(df, keys, position, back, __h=lambda w: F.collect_list(value).over(w.rowsBetween(-back, 0)))
    missing = F.lit(back + 1) - F.size("__h")
    return (
        seen.withColumn("history", F.concat(F.array_repeat(F.lit(padding), missing), F.col("__h")))
        .withColumn("available", F.size("__h") - 1)
        .drop("__h")
    )
