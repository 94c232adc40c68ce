"""The repair search on gathered tracks gives what the search in chunks gives, and shuffles the observations once."""

import random

import pytest
from pyspark.sql import functions as F
from test_repair_search import SCHEMA, row, still

import __spark_entry__ as entry
from trackloom.operators import repair_search as rs

KEYS = [*rs.TRACK, "candidate"]


def tracks(spark):
    rng = random.Random(8)
    rows = []
    for track, n in enumerate([1, 2, 3, 7, 25, 40]):
        for f in sorted(rng.sample(range(n * 3), n)):
            jump = 30.0 if rng.random() < 0.15 else 0.0
            left, top = rng.uniform(0, 500), rng.uniform(0, 300)
            box = (left, top, left + rng.uniform(20, 90), top + rng.uniform(20, 90))
            rows.append(row(track, f, rng.uniform(-2, 2) + jump, rng.uniform(-1, 12) + jump, rng.choice(["car", "bus", None]), video=1 + track % 2, box=box))
    fine = [row(9, f, 0.1 * f, video=2) for f in range(6)]
    gaps = [r[:6] + (None if k % 4 == 2 else r[6],) + r[7:8] + (None if k % 5 == 3 else r[8],) + r[9:] for k, r in enumerate(rows)]
    return spark.createDataFrame(rows + fine + [(3, *r[1:]) for r in gaps if r[1] == 4], SCHEMA)


def values(df, keys):
    out = {}
    for r in df.collect():
        flat = {k: v for k, v in r.asDict(True).items() if k != "plan"}
        assert out.setdefault(tuple(r[k] for k in keys), flat) is flat
    return out


def test_gathered_search_equals_chunked_search(spark):
    observations, ego = tracks(spark), still(spark, (1, 2))
    ego = ego.withColumns({"ego_vx": F.col("frame_index") * 0.01, "ego_vz": F.sin(F.col("frame_index").cast("double"))})
    want, rows, first = rs.repair_candidates(observations, ego)
    want = want.cache()
    gathered = rs.gathered(observations, ego)
    got = rs.tried(gathered)
    chosen = rs.chosen_repairs(want)
    pairs = [
        (got, want, KEYS), (rs.chosen_repairs(got), chosen, rs.TRACK),
        (rs.repaired(gathered, rs.chosen_repairs(got)), rs.repaired_tracks(rows, first, chosen), [*rs.TRACK, "frame_index"]),
    ]
    for a, b, keys in pairs:
        a, b = values(a, keys), values(b, keys)
        assert a.keys() == b.keys() and a
        for k in a:
            assert a[k] == {n: pytest.approx(v, abs=1e-7) if isinstance(v, float) else v for n, v in b[k].items()}, k


def test_observations_are_shuffled_once(spark):
    df = entry.queries()["repair_candidates"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2 and "ExistingRDD" not in plan
