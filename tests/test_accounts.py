"""Episodes, splits with their fall-backs, matching by position and coherence on literal rows."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import accounts
from trackloom.operators.matching import pooled_position_rates
from trackloom.sources import stores

C = F.col


def test_violations_end_with_the_first_kept_step(spark):
    # falling below 0 obliges the next value to rise
    values = [1, -1, -2, -3, 5, -1, 4, -2, -3]
    rows = spark.createDataFrame([(1, n, float(v)) for n, v in enumerate(values)], "video_id int, frame_index int, vz double")
    steps = accounts.violation_steps(rows, ["video_id"], "frame_index", "vz", C("vz") < 0, C("next") > C("vz"))
    got = [(r["start_frame"], r["end_frame"], r["duration"]) for r in accounts.violation_episodes(steps, ["video_id"], "frame_index").collect()]
    assert sorted(got) == [(1, 2, 2), (7, 7, 1)]
    assert steps.filter("applies").count() == 5 and steps.count() == len(values) - 1


@pytest.mark.parametrize("n,want", [(1, ["both"]), (2, ["train", "validation"]), (8, ["train"] * 6 + ["validation"] * 2)])
def test_one_video_is_divided_by_place(spark, n, want):
    rows = spark.createDataFrame([(5, k, 100 + k) for k in range(n)], "video_id int, segment_index int, example_id int")
    got = {r["example_id"]: r["split"] for r in accounts.train_validation(rows, "video_id", "segment_index", "example_id", 0.25, 7).collect()}
    assert [got[100 + k] for k in range(n)] == want


def test_videos_stay_whole(spark):
    rows = spark.createDataFrame([(v, k, 10 * v + k) for v in range(9) for k in range(3)], "video_id int, segment_index int, example_id int")
    out = accounts.train_validation(rows, "video_id", "segment_index", "example_id", 0.25, 7)
    assert out.groupBy("video_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert out.filter("split = 'validation'").select("video_id").distinct().count() == 2


def test_detections_take_the_nearest_free_object(spark):
    rows = [
        (1, 1, "gt", 0.0, 0.0), (1, 2, "gt", 4.0, 0.0), (1, 3, "det", 1.0, 0.0), (1, 4, "det", 0.5, 0.0), (1, 5, "det", 90.0, 0.0),
        (2, 1, "gt", 0.0, 0.0), (3, 1, "det", 0.0, 0.0),
    ]
    boxes = spark.createDataFrame(rows, "frame int, item int, source string, cx double, cy double")
    got = pooled_position_rates(boxes, ["frame"], "item", 5.0).first()
    # the first detection takes the object at 0, the second has to take the one at 4
    assert (got["hits"], got["false_alarms"], got["misses"]) == (2, 2, 1)
    assert got["mean_position_error"] == pytest.approx((1.0 + 3.5) / 2)


def test_points_behind_the_camera_have_no_residual(spark):
    points = spark.createDataFrame([(1.0, 0.0, 2.0, 10.0, 0.0), (1.0, 0.0, 0.0, 0.0, 0.0)], "x double, y double, z double, u double, v double")
    got = accounts.reprojection_residuals(points, 10.0, (0.0, 0.0), 2.0, 3.0).collect()
    assert [(r["evaluable"], r["raw"], r["severity"]) for r in got] == [(True, 5.0, "warning"), (False, None, "info")]


def test_missing_results_are_none_and_others_come_back(spark, tmp_path):
    path = str(tmp_path / "results")
    assert stores.read_results(spark, path) is None
    rows = spark.createDataFrame([(v, k) for v in range(3) for k in range(4)], "video_id int, value int")
    stores.write_results(rows, path, {"a": 1}, 2)
    back = stores.read_results(spark, path)
    assert back.count() == 12
    assert stores.pending(spark.range(4).select(C("id").cast("int").alias("video_id")), back, {"a": 1}, 2).count() == 1
