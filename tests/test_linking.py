"""Chains of fragments, association by cues and conflict clusters against plain Python."""

import math
import os
import random
import time
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_change_points import segments_by_hand

import __spark_entry__ as entry
from trackloom.operators import conflicts, linking
from trackloom.operators.change_points import Limits
from trackloom.plans import linking as plans
from trackloom.plans.views import Inputs, with_views

DATA = "/root/testdata/sf0.001"
SIDES = [f"{p}_{b}" for p in "se" for b in linking.BOX]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def linked_by_hand(rows, max_gap, min_iou, max_distance, width, height):
    """(fragment, chain, linked_to) by going through all starts in order; rows are dicts."""
    used, chain, before = set(), {}, {}
    for s in sorted(rows, key=lambda r: (r["first_frame"], r["fragment_id"])):
        best = None
        for e in rows:
            if (e["video_id"], e["label"], e["prior"]) != (s["video_id"], s["label"], s["prior"]) or e["fragment_id"] in used:
                continue
            if not 1 <= s["first_frame"] - e["last_frame"] <= max_gap:
                continue
            a, b = [s[f"s_{k}"] for k in linking.BOX], [e[f"e_{k}"] for k in linking.BOX]
            dx, dy = ((a[i] + a[i + 2] - b[i] - b[i + 2]) / 2 / n for i, n in ((0, width), (1, height)))
            overlap, apart = iou(a, b), math.sqrt(dx * dx + dy * dy)
            if overlap >= min_iou or apart <= max_distance:
                best = min(best or (math.inf, 0), (round(apart - overlap, 12), e["fragment_id"]))
        chain[s["fragment_id"]], before[s["fragment_id"]] = s["fragment_id"], None
        if best:
            used.add(best[1])
            before[s["fragment_id"]], chain[s["fragment_id"]] = best[1], chain[best[1]]
    return sorted((f, chain[f], before[f]) for f in chain)


def test_query_of_fragments_against_all_starts_in_order(spark):
    t = Inputs(spark, DATA)
    rows = [r.asDict() for r in plans.fragments(t).collect()]
    got = entry.queries()["linked_fragments"](spark, DATA).collect()
    want = linked_by_hand(rows, plans.MAX_GAP, 0.2, 0.1, 50.0, 7.0)
    assert sorted((r["fragment_id"], r["chain_id"], r["linked_to"]) for r in got) == want
    assert sum(w[2] is not None for w in want) > 20
    spark.catalog.clearCache()


def test_chain_of_fifty_and_crowded_frames(spark):
    rng, rows = random.Random(4), []

    def add(video, first, last, x, y, label="car"):
        box = [x, y, x + 10.0, y + 10.0]
        rows.append((video, len(rows), label, "p", first, last, *box, *box))

    for n in range(50):
        add(1, 10 * n, 10 * n + 8, 5.0 * n, 0.0)
    for _ in range(200):
        first = rng.randrange(60)
        add(2, first, first + rng.randrange(5), rng.randrange(12) * 4.0, rng.randrange(12) * 4.0, rng.choice(["car", "bus"]))
    df = spark.createDataFrame(rows, "video_id long, fragment_id long, label string, prior string, first_frame long, last_frame long, " + ", ".join(f"{c} double" for c in SIDES))
    got = linking.linked_fragments(df.repartition(6), ["video_id"], 2, 0.2, 0.1, 100.0, 100.0).collect()
    want = linked_by_hand([r.asDict() for r in df.collect()], 2, 0.2, 0.1, 100.0, 100.0)
    assert sorted((r["fragment_id"], r["chain_id"], r["linked_to"]) for r in got) == want
    assert {w[1] for w in want[:50]} == {0}
    assert linking.linked_fragments(df.limit(0), ["video_id"]).count() == 0


def test_assignment_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(150):
        score = np.round(rng.random((rng.integers(1, 8), rng.integers(1, 8))), rng.integers(1, 4))
        found = linking.best_assignment(score)
        short, wide = (score, score.T)[score.shape[0] > score.shape[1]], None
        wide = max(sum(short[i, j] for i, j in enumerate(p)) for p in permutations(range(short.shape[1]), short.shape[0]))
        assert len(found) == min(score.shape) == len({a for a, _ in found}) == len({b for _, b in found})
        assert abs(sum(score[a, b] for a, b in found) - wide) < 1e-9
    big = rng.random((300, 280))
    start = time.time()
    assert len(linking.best_assignment(big)) == 280 and time.time() - start < 20


def test_query_of_boxes_against_all_assignments(spark):
    pairs = {}
    for r in plans.cue_pairs(Inputs(spark, DATA)).collect():
        pairs.setdefault(r["frame_index"], {})[r["proposal"], r["detection"]] = r["score"]
    got = {}
    for r in entry.queries()["associated_boxes"](spark, DATA).collect():
        got.setdefault(r["frame_index"], []).append(r)
    assert got.keys() == pairs.keys() and len(got) > 100
    for frame, scores in pairs.items():
        a, b = (sorted({k[i] for k in scores}) for i in (0, 1))
        if len(a) > len(b):
            best = max(sum(scores[x, y] for x, y in zip(p, b, strict=True)) for p in permutations(a, len(b)))
        else:
            best = max(sum(scores[x, y] for x, y in zip(a, p, strict=True)) for p in permutations(b, len(a)))
        paired = [r for r in got[frame] if r["outcome"] != "no_partner"]
        assert abs(sum(scores[r["proposal"], r["detection"]] for r in paired) - best) < 1e-9
        assert all((r["outcome"] == "matched") == (scores[r["proposal"], r["detection"]] >= 0.35) for r in paired)
        assert sorted(x for r in got[frame] for x in [r["proposal"]] if x is not None) == a and sorted(x for r in got[frame] for x in [r["detection"]] if x is not None) == b


def test_weights_are_shared_over_the_cues_that_are_there(spark):
    rows = [(1.0, None, 0.0), (0.5, 0.25, None), (None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    score = linking.cue_score({"a": (F.col("a"), 3.0), "b": (F.col("b"), 1.0), "c": (F.col("c"), 1.0), "off": (F.lit(9.0), 0.0)})
    assert [round(r[0], 9) for r in df.select(score).collect()] == [0.75, 0.4375, 0.0]


def test_clusters_of_windows_with_several_subjects(spark, monkeypatch):
    monkeypatch.setattr(conflicts, "SPAN", 8)
    rng, rows = random.Random(8), []
    for n in range(400):
        start = rng.randrange(600)
        subjects = rng.choice([[], ["a"], ["a"], ["a"], ["b"], ["c"], ["d", "e"], ["b", "d"]])
        rows.append((n % 2, n, start, start + rng.randrange(3), subjects))
    gap = 1
    root = list(range(len(rows)))

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for subject in (None, *"abcde"):
        for video in (0, 1):
            mine = sorted((r for r in rows if r[0] == video and (subject in r[4] if subject else not r[4])), key=lambda r: (r[2], r[3], r[1]))
            end = None
            for before, row in zip([None, *mine], mine):
                if end is not None and row[2] <= end + gap + 1:
                    x, y = sorted((top(before[1]), top(row[1])))
                    root[y] = x
                end = row[3] if end is None else max(end, row[3])
    df = spark.createDataFrame(rows, "video_id long, window_id long, start_frame long, end_frame long, subjects array<string>").repartition(5)
    got = {r["window_id"]: r["cluster_id"] for r in conflicts.conflict_clusters(df, ["video_id"], gap).collect()}
    assert got == {n: top(n) for n in range(len(rows))}
    assert 30 < len(set(got.values())) < 350


def test_objects_of_the_frame_before(spark):
    rng, rows = random.Random(6), []
    for video, count in ((1, 40), (2, 6)):
        for frame in sorted(rng.sample(range(90), 45)):
            for _ in range(rng.randrange(1, count)):
                rows.append((video, frame, len(rows), rng.choice("ab"), float(rng.randrange(40)), float(rng.randrange(40))))
    want, number = [], {}
    for video in (1, 2):
        before = []
        for frame in sorted({r[1] for r in rows if r[0] == video}):
            now = []
            for v, f, item, label, x, y in (r for r in rows if r[:2] == (video, frame)):
                near = [(math.hypot(x - p[2], y - p[3]), p[0], p[4]) for p in before if p[1] == label and math.hypot(x - p[2], y - p[3]) < 5.0]
                if not near:
                    number[item] = sum(1 for i in number if rows[i][0] == video)
                first = min(near)[2] if near else item
                now.append((item, label, x, y, first))
                want.append((v, f, item, min(near)[1] if near else None, first, number[first]))
            before = now
    df = spark.createDataFrame(rows, "video_id long, frame_index long, item long, label string, x double, y double").repartition(5)
    got = linking.previous_frame_links(df, ["video_id"], 5.0, span=16)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == sorted(want, key=lambda r: r[2])


@pytest.mark.parametrize("name", ["conflict_clusters", "diagnosed_conflicts"])
def test_conflicts_match_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_query_of_change_points_against_the_definition(spark, duck):
    rows = duck.execute(with_views("""select video_id, frame_index, sum(vz) over (partition by video_id order by frame_index) as vz, (video_id * 31 + frame_index) % 17 <> 0 as ok from v_signal order by 1, 2""")).fetchall()
    videos = {}
    for video, frame, value, ok in rows:
        videos.setdefault(video, []).append((frame, value if ok else None))
    got = {}
    for r in entry.queries()["change_points"](spark, DATA).collect():
        got.setdefault(r["video_id"], []).append((r["start_frame"], r["end_frame"], r["state"]))
    want = {k: [s[:3] for s in segments_by_hand(v, Limits())] for k, v in videos.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
