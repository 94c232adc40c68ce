"""Track queries on whole tracks: one shuffle of the observations, and the values of the chunked way."""

import pytest

import __spark_entry__ as entry
from trackloom.plans import views

DATA = "/root/testdata/sf0.001"
NAMES = ["motion_cues", "motion_classes", "decision_signatures", "calibrated_thresholds", "cohort_profiles", "cohort_anomalies"]


def rows(spark, name):
    try:
        return sorted((tuple(r) for r in entry.queries()[name](spark, DATA).collect()), key=repr)
    finally:
        spark.catalog.clearCache()


@pytest.mark.parametrize("name", NAMES)
def test_chunked_videos_have_the_same_values(spark, monkeypatch, name):
    whole = rows(spark, name)
    # a few videos are chunked, the others whole
    monkeypatch.setattr(views, "LONG", 600)
    mixed = rows(spark, name)
    for a, b in zip(whole, mixed, strict=True):
        assert a == tuple(pytest.approx(v, abs=2e-6) if isinstance(v, float) else v for v in b)


@pytest.mark.parametrize("name", ["motion_cues", "motion_classes", "reality_checks"])
def test_observations_are_shuffled_once(spark, name):
    df = entry.queries()[name](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1
