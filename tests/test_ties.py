"""Values that lie on a threshold, where the last bits of a sum would decide otherwise."""

from datetime import datetime, timedelta
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackloom.functions.scores import control_relevance
from trackloom.operators.quantiles import weighted_median

#: In floating point the last value of each list is more than 10, 20 and 60 above the mean; exactly, it is that much.
ON_THRESHOLD = {
    10: [151.59, 176.7, 10.36, 72.82, 239.22, 124.29, 140.83],
    20: [47.89, 158.21, 50.44, 81.87, 213.48, 136.41, 138.05],
    60: [188.26, 181.69, 250.6, 61.98, 85.43, 162.7, 225.11],
}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("events"), ON_THRESHOLD, lambda user, k: "click")


def written(spark, path, lists, kind):
    start, rows = datetime(2024, 1, 1), []
    for user, values in lists.items():
        for k, v in enumerate(values):
            rows.append((len(rows), start + timedelta(minutes=k), user, kind(user, k), v))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def deviations(user, lists=ON_THRESHOLD):
    values = [Fraction(str(v)) for v in lists[user]]
    return [v - sum(values) / len(values) for v in values]


def found(spark, name, path):
    return [r.asDict() for r in entry.queries()[name](spark, path).collect()]


def by_sql(name, path):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, row)) for row in cursor.fetchall()]


def same(a, b):
    return sorted(map(str, map(sorted, map(dict.items, a)))) == sorted(map(str, map(sorted, map(dict.items, b))))


def test_votes_on_the_threshold_count_as_forward(spark, events):
    got = {(r["video_id"], r["frame_index"]): r["forward"] for r in found(spark, "frame_votes", events)}
    for user in ON_THRESHOLD:
        for k, d in enumerate(deviations(user)):
            assert got[user, k] == sum(w for th, w in ((10, 0.5), (40, 0.3), (160, 0.2)) if -th <= d <= th)
    assert same(found(spark, "frame_votes", events), by_sql("frame_votes", events))


def test_speeds_on_the_threshold_are_steady(spark, events):
    got = {(r["video_id"], r["frame_index"]): r["action"].split("|")[0] for r in found(spark, "ego_actions", events)}
    for user in ON_THRESHOLD:
        for k, d in enumerate(deviations(user)):
            assert got[user, k] == ("stop" if abs(d) < 10 else "speedup" if d > 60 else "slowdown" if d < -60 else "steady")
    assert same(found(spark, "ego_actions", events), by_sql("ego_actions", events))


def predicted(d):
    return "left" if d > 20 else "static" if d < -20 else "forward"


def test_frames_on_the_threshold_are_forward(spark, events):
    got = {(r["gt_label"], r["pred_label"]): r["frames"] for r in found(spark, "frame_confusion", events)}
    labels = [predicted(d) for user in ON_THRESHOLD for d in deviations(user)]
    assert got == {("forward", p): labels.count(p) for p in set(labels)}
    assert same(found(spark, "frame_confusion", events), by_sql("frame_confusion", events))


def test_class_counts_follow_the_exact_labels(spark, events):
    got = {r["cls"]: (r["tp"], r["fp"]) for r in found(spark, "frame_class_metrics", events)}
    labels = [predicted(d) for user in ON_THRESHOLD for d in deviations(user)]
    assert got["forward"] == (labels.count("forward"), 0) and got["left"] == (0, labels.count("left"))
    assert same(found(spark, "frame_class_metrics", events), by_sql("frame_class_metrics", events))


def test_evaluation_follows_the_exact_labels(spark, events):
    got = {r["scope"]: r["agreed"] for r in found(spark, "video_evaluation", events)}
    agreed = {str(user): sum(predicted(d) == "forward" for d in deviations(user)) for user in ON_THRESHOLD}
    assert got == agreed | {"all": sum(agreed.values())}
    assert same(found(spark, "video_evaluation", events), by_sql("video_evaluation", events))


def test_candidates_are_weighed_by_the_exact_labels(spark, tmp_path):
    # the truth is what the threshold 10 says of the exact values, so its candidate is right everywhere
    kind = lambda user, k: "purchase" if deviations(user)[k] > 10 else "error" if deviations(user)[k] < -10 else "click"
    path = written(spark, tmp_path, ON_THRESHOLD, kind)
    got = {r["video_id"]: (r["candidate_id"], r["weighted"], r["raw"]) for r in found(spark, "best_threshold_candidate", path)}
    assert got == {user: (0, 1.0, 1.0) for user in ON_THRESHOLD}
    assert same(found(spark, "best_threshold_candidate", path), by_sql("best_threshold_candidate", path))


def test_a_rise_of_exactly_five_is_no_violation(spark, tmp_path):
    # 40.55 is far below the mean and rises by 5; the difference of the two deviations falls short of it in floating point
    lists = {1: [288.26, 174.84, 254.48, 251.46, 159.11, 40.55, 45.55]}
    path = written(spark, tmp_path, lists, lambda user, k: "click")
    d = deviations(1, lists)
    low = [k for k in range(len(d) - 1) if d[k] < -40]
    [row] = found(spark, "violation_rates", path)
    assert (row["applications"], row["violations"]) == (len(low), sum(d[k + 1] < d[k] + 5 for k in low))
    assert same([row], by_sql("violation_rates", path))


def test_half_of_the_weights_is_reached_exactly(spark):
    # 0.3 is half of 0.3 + 0.1 + 0.2, whose sum is a little more than 0.6 in floating point
    rows = spark.createDataFrame([(1, 1.0, 0.3), (1, 2.0, 0.1), (1, 3.0, 0.2)], "k int, v double, w double")
    assert [r.m for r in weighted_median(rows, ["k"], "v", "w", "m", 6).collect()] == [1.0]


def test_relevance_on_the_limit_is_high(spark):
    # each row weighs 0.67 exactly and a little less in floating point
    rows = spark.createDataFrame([(0.6, 12.0, 0.7), (0.85, 24.0, 0.7), (0.7, 24.0, 0.8)], "seen double, z double, middle double")
    label = control_relevance(F.col("seen"), F.lit(50.0), F.col("z"), F.lit(0.0), F.col("middle"))["label"]
    assert [r.label for r in rows.select(label.alias("label")).collect()] == ["high"] * 3
