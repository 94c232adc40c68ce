"""The extension rounds work on distinct situations: examples from facts and from scenes are the same, and objects are not moved as facts."""

import random

import pytest
from pyspark.sql import functions as F
from test_extension import HEAD, SCHEMA, by_hand, collected, made_up

from trackloom.operators import extension
from trackloom.operators.extension import Terms
from trackloom.plans import extending
from trackloom.plans.views import Inputs

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "lineitem", "orders", "part")


def copied(spark, folder, changed):
    for name in TABLES:
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        changed.get(name, lambda df: df)(df).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def gathered(scenes):
    return sorted((r["example_id"], r["label"], sorted(r["situations"])) for r in scenes.collect())


def test_scenes_are_those_of_the_facts(spark):
    t = Inputs(spark, DATA)
    scenes = extending.sourced_scenes(t)
    assert "situations" in scenes.columns
    assert gathered(scenes) == gathered(extension.scenes_of(extending.sourced_facts(t)))


def test_tracks_seen_twice_and_without_number(spark, tmp_path):
    twice = copied(spark, tmp_path / "twice", {"lineitem": lambda df: df.withColumn("l_linenumber", (F.col("l_linenumber") / 3).cast("int"))})
    t = Inputs(spark, twice)
    scenes = extending.sourced_scenes(t)
    assert "situations" in scenes.columns
    assert gathered(scenes) == gathered(extension.scenes_of(extending.sourced_facts(t)))
    unknown = copied(spark, tmp_path / "unknown", {"lineitem": lambda df: df.withColumn("l_linenumber", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")))})
    assert "situations" not in extending.sourced_scenes(Inputs(spark, unknown)).columns


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_alike_examples_and_joined_situations(spark, monkeypatch, most):
    monkeypatch.setattr(extension, "FIRED", most)
    rows = made_up(6, 40)
    # every example four times under other numbers: signatures and coverages are of examples, not of rows that are alike
    rows = [(e + 1000 * k, *rest) for k in range(4) for e, *rest in rows]
    random.Random(1).shuffle(rows)
    facts = spark.createDataFrame(rows, SCHEMA).repartition(5)
    scenes = extension.scenes_of(facts)
    assert extension.alike(scenes).count() * 4 <= scenes.count()
    assert collected(extension.extension_rounds(facts, HEAD)[0]) == collected(extension.extension_rounds(scenes, HEAD)[0]) == by_hand(rows, Terms())


def test_an_even_number_of_alike_examples_keeps_signatures_apart(spark):
    rows = []
    for e in range(8):
        rows += [(e, e % 4 < 2, "object_class(S,O,a).", 1, 1), (e, e % 4 < 2, "object_distance_state(S,O,b).", 1, 1)]
        rows += [(e, e % 4 < 2, "object_x_position_state(S,O,c).", 1, 1)] if e % 4 == 0 else []
    facts = spark.createDataFrame(rows, SCHEMA)
    assert collected(extension.extension_rounds(facts, HEAD)[0]) == by_hand(rows, Terms())
