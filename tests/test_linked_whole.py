"""Fragments of whole videos are linked in one piece: one shuffle, and the links of the chunked way and of plain Python."""

import random

import pytest
from test_linking import SIDES, linked_by_hand

import __spark_entry__ as entry
from trackloom.operators import linking
from trackloom.plans import views

DATA = "/root/testdata/sf0.001"
FIELDS = "video_id long, fragment_id long, label string, prior string, first_frame long, last_frame long, " + ", ".join(f"{c} double" for c in SIDES)


def rows(spark):
    try:
        return sorted((tuple(r) for r in entry.queries()["linked_fragments"](spark, DATA).collect()), key=repr)
    finally:
        spark.catalog.clearCache()


def crowd(seed, videos, labels, size, reach):
    """Boxes of the given size on whole places of a square, so many scores are equal."""
    rng, out = random.Random(seed), []
    for video in videos:
        for _ in range(150):
            first, box = rng.randrange(40), [rng.randrange(reach) * size / 2 for _ in range(2)]
            end = [c + rng.randrange(-1, 2) * size / 2 for c in box]
            side = rng.choice([size, size / 2])
            out.append((video, len(out) * 7 % 10007, rng.choice(labels), rng.choice("pq"), first, first + rng.randrange(5), *box, box[0] + side, box[1] + size, *end, end[0] + size, end[1] + side))
    return out


def test_chunked_videos_have_the_same_links(spark, monkeypatch):
    whole = rows(spark)
    # a few videos are chunked, the others whole
    monkeypatch.setattr(views, "LONG", 600)
    assert rows(spark) == whole


def test_observations_are_shuffled_once(spark):
    df = entry.queries()["linked_fragments"](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("gap,distance,width,size", [(2, 0.1, 100.0, 10.0), (6, 0.4, 0.5, 0.25), (40, 0.02, 50.0, 8.0)])
def test_both_ways_against_all_starts_in_order(spark, monkeypatch, whole, gap, distance, width, size):
    monkeypatch.setattr(linking, "PAIRS", 50)
    df = spark.createDataFrame(crowd(gap, [1, 2, 3], ["car", "bus"], size, 9), FIELDS).repartition(5)
    got = linking.linked_fragments(df, ["video_id"], gap, 0.2, distance, width, width, whole).collect()
    # distances are measured in units of at least one
    want = linked_by_hand([r.asDict() for r in df.collect()], gap, 0.2, distance, max(1.0, width), max(1.0, width))
    assert sorted((r["fragment_id"], r["chain_id"], r["linked_to"]) for r in got) == want
    assert sum(w[2] is not None for w in want) > 20


@pytest.mark.parametrize("whole", [True, False])
def test_unknown_label_or_video_has_no_links(spark, whole):
    box = [0.0, 0.0, 2.0, 2.0] * 2
    pairs = [(1, None, "p"), (1, "car", None), (None, "car", "p"), (2, "car", "p")]
    data = [(v, 10 * n + k, label, prior, k * 5, k * 5 + 4, *box) for n, (v, label, prior) in enumerate(pairs) for k in range(2)]
    df = spark.createDataFrame(data, FIELDS)
    got = linking.linked_fragments(df, ["video_id"], whole=whole).collect()
    assert sorted((r["fragment_id"], r["linked_to"]) for r in got) == sorted((r[1], 30 if r[1] == 31 else None) for r in data)
    assert linking.linked_fragments(df.limit(0), ["video_id"], whole=whole).count() == 0
