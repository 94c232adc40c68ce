"""Gap filling, smoothing, budgets and components on hand-made cases."""

import random

from trackloom.operators import components, repair

SCHEMA = "video_id int, track_id int, frame_index int, label string, score double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows):
    return spark.createDataFrame([(1, t, f, l, s, x, 0.0, x + 20, 20.0) for t, f, l, s, x in rows], SCHEMA)


def test_safe_gap_is_filled_at_the_midpoint(spark):
    filled, report = repair.fill_gaps(boxes(spark, [(1, 0, "car", 0.8, 0.0), (1, 2, "car", 0.6, 4.0)]))
    row = filled.collect()[0]
    assert (row.frame_index, row.x1, row.x2) == (1, 2.0, 22.0) and abs(row.score - 0.57) < 1e-9
    assert [r.reason for r in report.collect()] == [""]


def test_overlap_conflict(spark):
    rows = [(1, 0, "car", 0.8, 0.0), (1, 2, "car", 0.6, 4.0), (2, 1, "car", 0.9, 3.0)]
    filled, report = repair.fill_gaps(boxes(spark, rows))
    assert filled.count() == 0
    assert [r.reason for r in report.collect()] == ["overlap_conflict"]


def test_colliding_fills_go_to_the_earlier_track(spark):
    rows = [(t, f, "car", 0.9, x) for t, x in ((1, 0.0), (2, 10.0), (3, 20.0)) for f in (0, 2)]
    filled, report = repair.fill_gaps(boxes(spark, rows))
    # 1 blocks 2, and since 2 is gone 3 may stay
    assert sorted(r.track_id for r in filled.collect()) == [1, 3]
    assert {r.track_id: r.reason for r in report.collect()} == {1: "", 2: "overlap_conflict", 3: ""}


def test_first_reason_wins(spark):
    rows = [(1, 0, "car", 0.8, 0.0), (1, 9, "bus", 0.6, 4.0), (2, 0, "car", 0.1, 300.0), (2, 2, "car", 0.6, 300.0)]
    _, report = repair.fill_gaps(boxes(spark, rows))
    assert {r.track_id: r.reason for r in report.collect()} == {1: "gap_length", 2: "low_endpoint_score"}


def test_two_way_smoothing(spark):
    rnd = random.Random(2)
    values = [rnd.uniform(-5, 5) for _ in range(80)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, at int, v double")
    got = {r["at"]: r.smoothed for r in repair.two_way_smoothing(df, ["k"], "at", "v", 0.55).collect()}
    forward = [values[0]]
    for v in values[1:]:
        forward.append(0.55 * v + 0.45 * forward[-1])
    backward = [forward[-1]]
    for v in reversed(forward[:-1]):
        backward.append(0.55 * v + 0.45 * backward[-1])
    backward.reverse()
    assert all(abs(got[i] - (f + b) / 2) < 1e-9 for i, (f, b) in enumerate(zip(forward, backward)))


def test_budgets(spark):
    rows = [(1, 1, "car", "p", 0.9), (1, 2, "car", "q", 0.8), (1, 3, "car", "q", 0.7), (1, 4, "bus", "p", 0.6), (1, 5, "bus", "r", 0.5), (1, 6, "dog", "s", 0.4), (1, 7, "cat", "t", 0.05)]
    df = spark.createDataFrame(rows, "seg int, object_id int, cls string, prior string, score double")
    got = {r.object_id: r.reason for r in repair.budgeted_objects(df, ["seg"], 3, 2, 1, 0.1).collect()}
    assert got == {
        1: "", 2: "", 3: "class_candidate_budget_exceeded", 4: "prior_candidate_budget_exceeded", 5: "",
        6: "segment_candidate_budget_exceeded", 7: "below_candidate_selection_score",
    }


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 200)]
    df = spark.createDataFrame(chain, "a int, b int")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(31))
    assert got[100] == got[101] == got[102] == 100 and got[200] == 200
