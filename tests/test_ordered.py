"""Chunked windows give what ordinary windows give, with one key holding a third of the rows."""

import random

from pyspark.sql import functions as F

from trackloom.operators import ordered
from trackloom.operators.quantiles import quantiles, weighted_median


def skewed(spark, n=900):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        key = 0 if i < n // 3 else rnd.randrange(1, 40)
        rows.append((key, i * rnd.choice([1, 1, 1]), rnd.choice("abc"), float(rnd.randrange(-50, 50))))
    return spark.createDataFrame(rows, "k int, at int, label string, v double")


def test_scan(spark):
    df = skewed(spark)
    got = ordered.by_step(["k"], "at", 16).scan(
        df,
        n=ordered.row_number(),
        s=ordered.running_sum(F.col("v")),
        before=ordered.previous(F.col("v")),
        after=ordered.following(F.col("label")),
        last_a=ordered.carried(F.when(F.col("label") == "a", F.col("at"))),
        next_a=ordered.upcoming(F.when(F.col("label") == "a", F.col("at"))),
        whole=ordered.total(F.col("v")),
    ).collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r)
    want = {}
    for k, rs in groups.items():
        rs.sort(key=lambda r: r.at)
        for i, r in enumerate(rs):
            a_before = [x.at for x in rs[: i + 1] if x.label == "a"]
            a_after = [x.at for x in rs[i:] if x.label == "a"]
            want[k, r.at] = (
                i + 1,
                sum(x.v for x in rs[: i + 1]),
                rs[i - 1].v if i else None,
                rs[i + 1].label if i + 1 < len(rs) else None,
                a_before[-1] if a_before else None,
                a_after[0] if a_after else None,
                sum(x.v for x in rs),
            )
    assert {(r.k, r.at): (r.n, r.s, r.before, r.after, r.last_a, r.next_a, r.whole) for r in got} == want


def test_runs(spark):
    df = skewed(spark)
    got = ordered.runs(df, ["k"], "at", "label", span=16, top=("max", F.col("v"))).collect()
    want = set()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r)
    for k, rs in groups.items():
        rs.sort(key=lambda r: r.at)
        i = 0
        while i < len(rs):
            j = i
            while j + 1 < len(rs) and rs[j + 1].label == rs[i].label:
                j += 1
            want.add((k, rs[i].label, rs[i].at, rs[j].at, j - i + 1, max(r.v for r in rs[i : j + 1])))
            i = j + 1
    assert {(r.k, r.label, r.start_frame, r.end_frame, r.frames, r.top) for r in got} == want
    assert len(got) == len(want)


def test_near(spark):
    df = spark.range(200).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("at"), F.col("id").cast("double").alias("v"))
    got = ordered.near(df, ["k"], "at", 3, 8, total=lambda w: F.sum("v").over(w.rowsBetween(-3, 3))).collect()
    assert {r["at"]: r.total for r in got} == {i: float(sum(range(max(0, i - 3), min(200, i + 4)))) for i in range(200)}


def test_quantiles(spark):
    import numpy as np

    df = skewed(spark)
    got = {r.k: (r.a, r.b) for r in quantiles(df, ["k"], "v", a=0.5, b=0.9).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r.v)
    for k, vs in groups.items():
        assert abs(got[k][0] - np.quantile(vs, 0.5)) < 1e-9
        assert abs(got[k][1] - np.quantile(vs, 0.9)) < 1e-9


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 3.0, 3.0), (2, 5.0, 1.0), (2, -5.0, 1.0)], "k int, v double, w double")
    got = {r.k: r.m for r in weighted_median(df, ["k"], "v", "w", "m").collect()}
    assert got == {1: 3.0, 2: -5.0}


def test_value_bucket_is_monotone(spark):
    values = [-1e9, -3.5, -3.4, -1e-12, 0.0, 1e-300, 1e-9, 0.99, 1.0, 1.0001, 7.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(ordered.value_bucket(F.col("v")).alias("b"))
    got = [r.b for r in df.collect()]
    assert got == sorted(got)


def test_null_keys_and_null_order_values_stay(spark):
    from pyspark.sql import Window as W

    rows = [(None, None, "a", 1.0), (None, 3, "a", 2.0), (None, 40, "b", 3.0), (1, None, "a", 4.0), (1, 5, "a", 5.0), (1, 77, "a", 6.0)]
    df = spark.createDataFrame(rows, "k int, at int, label string, v double")
    w = W.partitionBy("k").orderBy("at")
    want = df.select("k", "at", F.row_number().over(w).alias("n"), F.sum("v").over(w).alias("s"), F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"))
    got = ordered.by_step(["k"], "at", 16).scan(
        df, n=ordered.row_number(), s=ordered.running_sum(F.col("v")), before=ordered.previous(F.col("v")), after=ordered.following(F.col("v"))
    ).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    near = ordered.near(df, ["k"], "at", 2, span=16, around=lambda x: F.sum("v").over(x.rowsBetween(0, 0)))
    assert near.count() == len(rows)
    assert sum(r.frames for r in ordered.runs(df, ["k"], "at", "label", span=16).collect()) == len(rows)


def test_a_hot_key_is_dealt_in_chunks(spark):
    """No window of a scan holds a whole key: nine tenths of the rows have one key, and no task gets more than a few chunks."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).alias("k"), F.col("id").alias("at"))
    out = ordered.by_step(["k"], "at", 500).scan(df, n=ordered.row_number())
    parts = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert out.count() == 20_000 and parts < 12_000
