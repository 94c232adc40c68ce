"""Ordered computations that survive a hot key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  The helpers here cut each key
into chunks of its order column and do the row work per (key, chunk):

* ``Ordered.scan``  - unbounded running values (row numbers, running sums, carried values, neighbours).
  A small summary per chunk is aggregated first, the carry into each chunk is a window over those
  summaries only, and rows join their carry on (key, chunk).
* ``near``          - windows of bounded reach over dense positions; rows within reach of a chunk border are
  copied to the neighbouring chunk, so one shuffle is enough.
* ``runs``          - gaps and islands; runs are compressed per chunk and only the first and last run of a
  chunk are stitched with their neighbours.

There is one way for keys of every size; only where all keys are known to be short, each of them is one chunk (``Ordered.chunk`` is None) and
keeps the partitioning of its rows.  Null keys form a group of their own and null order values come first in it, as
in an ordinary window: a chunk is addressed by a struct of keys and chunk, which is never null and equal where all its fields
are, so windows, summaries and the join with the carry also share one partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

START, END = W.unboundedPreceding, W.unboundedFollowing
CHUNK, CELL = "__chunk", "__cell"

@dataclass(frozen=True)
class Spec:
    """One output of a scan: columns per row, summary per chunk, carry between chunks, final merge."""

    local: Callable[[WindowSpec], list[Column]]
    summary: Callable[[Column], Column]
    carry: Callable[[WindowSpec, Column], Column]
    merge: Callable[[list[Column], Column], Column]
    whole: Callable[[WindowSpec], Column] | None = None


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def running_sum(value: Column | int) -> Spec:
    v = value if isinstance(value, Column) else F.lit(value)
    return Spec(
        lambda w: [F.sum(v).over(w.rowsBetween(START, 0))],
        lambda o: F.sum(v),
        lambda w, s: F.sum(s).over(w.rowsBetween(START, -1)),
        lambda l, c: _zero(l[0]) + _zero(c),
    )


def row_number() -> Spec:
    return running_sum(1)


def _whole(value: Column, fold: Callable[[Column], Column]) -> Spec:
    return Spec(
        lambda w: [],
        lambda o: fold(value),
        lambda w, s: fold(s).over(w.rowsBetween(START, END)),
        lambda l, c: c,
        lambda w: fold(value).over(w.rowsBetween(START, END)),
    )


def total(value: Column | int) -> Spec:
    """Sum over the whole key."""
    return _whole(value if isinstance(value, Column) else F.lit(value), F.sum)


def overall_max(value: Column) -> Spec:
    return _whole(value, F.max)


def carried(value: Column) -> Spec:
    """Last non-null value up to and including the row."""
    return Spec(
        lambda w: [F.last(value, True).over(w.rowsBetween(START, 0))],
        lambda o: F.max_by(value, F.when(value.isNotNull(), o)),
        lambda w, s: F.last(s, True).over(w.rowsBetween(START, -1)),
        lambda l, c: F.coalesce(l[0], c),
    )


def upcoming(value: Column) -> Spec:
    """First non-null value from the row onwards."""
    return Spec(
        lambda w: [F.first(value, True).over(w.rowsBetween(0, END))],
        lambda o: F.min_by(value, F.when(value.isNotNull(), o)),
        lambda w, s: F.first(s, True).over(w.rowsBetween(1, END)),
        lambda l, c: F.coalesce(l[0], c),
    )


def previous(value: Column) -> Spec:
    """Value of the row before, whatever the distance."""
    return Spec(
        lambda w: [F.lag(F.lit(True)).over(w), F.lag(value).over(w)],
        lambda o: F.max_by(value, o),
        lambda w, s: F.lag(s).over(w),
        lambda l, c: F.when(l[0].isNull(), c).otherwise(l[1]),
    )


def following(value: Column) -> Spec:
    return Spec(
        lambda w: [F.lead(F.lit(True)).over(w), F.lead(value).over(w)],
        lambda o: F.min_by(value, o),
        lambda w, s: F.lead(s).over(w),
        lambda l, c: F.when(l[0].isNull(), c).otherwise(l[1]),
    )


@dataclass(frozen=True)
class Ordered:
    """Rows of ``keys`` in ascending ``order``; ``chunk`` is a non-decreasing function of the order, or None where a key is one chunk."""

    keys: Sequence[str]
    order: Sequence[str]
    chunk: Column | None

    def scan(self, df: DataFrame, **specs: Spec) -> DataFrame:
        keys, names = list(self.keys), df.columns
        if self.chunk is None:
            whole = W.partitionBy(*keys).orderBy(*self.order)
            local = {n: s.local(whole) for n, s in specs.items()}
            more = {n: s.whole(whole) if s.whole else F.lit(None) for n, s in specs.items()}
            rows = df.select("*", *[c.alias(f"__l_{n}_{i}") for n, cs in local.items() for i, c in enumerate(cs)], *[c.alias(f"__c_{n}") for n, c in more.items()])
            return rows.select(*names, *[self._merged(n, s, local[n]) for n, s in specs.items()])
        cut = df.withColumn(CHUNK, self.chunk).withColumn(CELL, F.struct(*keys, CHUNK))
        whole = W.partitionBy(*[f"{CELL}.{k}" for k in keys]).orderBy(f"{CELL}.{CHUNK}")
        carry = (
            cut.groupBy(CELL)
            .agg(*[s.summary(F.struct(*self.order)).alias(f"__s_{n}") for n, s in specs.items()])
            .select(CELL, *[s.carry(whole, F.col(f"__s_{n}")).alias(f"__c_{n}") for n, s in specs.items()])
        )
        within = W.partitionBy(CELL).orderBy(*self.order)
        local = {n: s.local(within) for n, s in specs.items()}
        rows = cut.select("*", *[c.alias(f"__l_{n}_{i}") for n, cs in local.items() for i, c in enumerate(cs)])
        return rows.join(carry, CELL).select(*names, *[self._merged(n, s, local[n]) for n, s in specs.items()])

    @staticmethod
    def _merged(name: str, spec: Spec, local: list[Column]) -> Column:
        return spec.merge([F.col(f"__l_{name}_{i}") for i in range(len(local))], F.col(f"__c_{name}")).alias(name)


def by_step(keys: Sequence[str], order: str, span: int | None, *ties: str) -> Ordered:
    """Chunks of ``span`` units of an integer order column; without a span a key is one chunk."""
    return Ordered(keys, [order, *ties], None if span is None else F.floor(F.col(order) / F.lit(span)))


def value_bucket(value: Column) -> Column:
    """Monotone bucket of a double with fixed relative width, fine enough to spread a hot group of values."""
    size = F.floor(F.log2(F.abs(value)) * 256) + (1 << 20)
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise((F.signum(value) * size).cast("bigint"))


def near(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    reach: int,
    span: int = 8192,
    then: dict[str, Callable[[WindowSpec], Column]] | None = None,
    **columns: Callable[[WindowSpec], Column],
) -> DataFrame:
    """Window columns that look at most ``reach`` positions away; positions are dense per key.

    Columns of ``then`` are made after the others and may use them; ``reach`` covers both steps.
    """
    if span < reach:
        raise ValueError("span must be at least the reach")
    at = lambda shift: F.floor((F.col(position) + shift) / F.lit(span))
    w = W.partitionBy(*keys, CHUNK).orderBy(position)
    return (
        df.withColumn(CHUNK, F.explode(F.array_distinct(F.array(at(-reach), at(0), at(reach)))))
        .select("*", *[make(w).alias(n) for n, make in columns.items()])
        .select("*", *[make(w).alias(n) for n, make in (then or {}).items()])
        .filter(F.col(CHUNK).eqNullSafe(at(0)))
        .drop(CHUNK)
    )


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    label: str,
    span: int = 8192,
    contiguous: bool = False,
    **measures: tuple[str, Column],
) -> DataFrame:
    """Maximal runs of equal ``label``: keys, label, start_frame, end_frame, frames and the measures.

    A measure is ``("sum" | "min" | "max", column)``.  With ``contiguous`` a missing order value also ends a run.
    """
    keys = list(keys)
    folds = {"frames": ("sum", F.lit(1)), **measures}

    def breaks(same_label: Column, gap: Column) -> Column:
        same = same_label & (gap <= 1) if contiguous else same_label
        return F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)

    names = [*keys, label, "start_frame", "end_frame", *folds]
    inner = W.partitionBy(*keys, CHUNK).orderBy(order)
    fragments = (
        df.withColumn(CHUNK, F.floor(F.col(order) / F.lit(span)))
        .withColumn(
            "__cut",
            breaks(
                F.col(label).eqNullSafe(F.lag(label).over(inner)) & F.lag(order).over(inner).isNotNull(),
                F.col(order) - F.lag(order).over(inner),
            ),
        )
        .withColumn("__part", F.sum("__cut").over(inner.rowsBetween(START, 0)))
        .groupBy(*keys, CHUNK, "__part")
        .agg(
            F.min(label).alias(label),
            F.min(order).alias("start_frame"),
            F.max(order).alias("end_frame"),
            *[_MERGE[k](c).alias(n) for n, (k, c) in folds.items()],
        )
    )
    fragments = fragments.withColumn("__last", F.max("__part").over(W.partitionBy(*keys, CHUNK)))
    edge = (F.col("__part") == 1) | (F.col("__part") == F.col("__last"))
    chain = W.partitionBy(*keys).orderBy("start_frame")
    stitched = (
        fragments.filter(edge)
        .withColumn(
            "__cut",
            breaks(
                F.col(label).eqNullSafe(F.lag(label).over(chain))
                & F.lag("start_frame").over(chain).isNotNull()
                & (F.lag(CHUNK).over(chain) != F.col(CHUNK)),
                F.col("start_frame") - F.lag("end_frame").over(chain),
            ),
        )
        .withColumn("__run", F.sum("__cut").over(chain.rowsBetween(START, 0)))
        .groupBy(*keys, "__run")
        .agg(
            F.min(label).alias(label),
            F.min("start_frame").alias("start_frame"),
            F.max("end_frame").alias("end_frame"),
            *[_MERGE[k](n).alias(n) for n, (k, _) in folds.items()],
        )
    )
    return fragments.filter(~edge).select(*names).unionByName(stitched.select(*names))
