"""The extension rounds read examples in tokens, whatever the length of templates, and keep no row per example and body."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_extension_scenes import DATA, copied

from trackloom.operators import extension
from trackloom.operators.rules import MARK
from trackloom.plans import extending
from trackloom.plans.views import Inputs


def held(scenes, names=None):
    """Examples with the templates of each situation and whether it has an object."""
    spelled = {r["token"]: r["sourced"] for r in names.collect()} if names else {}
    atoms = lambda s: frozenset(a for t in s.split(MARK) if t for a in spelled.get(t, [t]))
    rows = [(r["example_id"], r["label"], Counter((not s.startswith(MARK), atoms(s)) for s in r["situations"])) for r in scenes.collect()]
    return sorted(rows, key=lambda r: (r[0], r[1]))


CHANGES = {
    "given": {},
    "seen_twice": {"lineitem": lambda df: df.withColumn("l_linenumber", (F.col("l_linenumber") / 3).cast("int"))},
    "odd_classes": {"part": lambda df: df.withColumn("p_type", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).when(F.col("p_partkey") % 3 == 1, F.lower("p_type")))},
    "unknown": {"lineitem": lambda df: df.withColumns({c: F.when(F.col("l_orderkey") % 5 > 0, F.col(c)) for c in ("l_quantity", "l_discount", "l_returnflag")})},
}


@pytest.mark.parametrize("change", CHANGES)
def test_tokens_stand_for_the_templates(spark, tmp_path, change):
    t = Inputs(spark, copied(spark, tmp_path / "in", CHANGES[change]))
    assert held(*t.coded_scenes()) == held(extension.scenes_of(extending.sourced_facts(t)))


def test_examples_are_moved_without_templates(spark, monkeypatch):
    seen = []
    alike = extension.alike
    monkeypatch.setattr(extension, "alike", lambda scenes: (seen.append(scenes), alike(scenes))[1])
    got = extending.first_extension_round(Inputs(spark, DATA))
    assert got.count() > 0
    tokens = seen[0].select(F.explode("situations").alias("s")).select(F.explode(F.split("s", MARK)).alias("t"))
    assert tokens.agg(F.max(F.length("t"))).first()[0] <= 5


def test_bodies_are_counted_in_the_rows_of_examples(spark):
    rows = [(True, 2, 5, -7, [3, 9, 3, 5, 9, 9]), (False, 1, 6, 1 << 62, [4, 3, 3]), (True, 1, 9, -1, [3, 4]), (True, 1, 1, 1, [])]
    df = spark.createDataFrame(rows, "label boolean, n long, h0 long, h1 long, ids array<int>").coalesce(1)
    for once in (False, True):
        want = {}
        for label, n, h0, h1, ids in rows:
            for body, times in Counter(ids).items():
                p, q, a, b, c, d = want.get((body, 1 if once else times), (0,) * 6)
                want[body, 1 if once else times] = (p + n * label, q + n * (not label), a ^ h0, b ^ h1, c ^ h0 * label, d ^ h1 * label)
        tallies = extension.tallied(df, once)
        assert "Exchange" not in tallies._jdf.queryExecution().executedPlan().toString()
        sums = tallies.groupBy("body_id", "times").agg(*[F.sum(k) for k in "pq"], *[F.bit_xor(k) for k in ("h0", "h1", "p_h0", "p_h1")])
        assert {tuple(r)[:2]: tuple(r)[2:] for r in sums.collect()} == want
