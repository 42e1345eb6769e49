"""Timelines are as long as the events, not as the given tables."""

import datetime

from motiontables.plans import timelines


def test_timelines_reach_the_last_day(spark, tmp_path):
    first = datetime.datetime(2024, 1, 1, 3)
    rows = [(d, 1, first + datetime.timedelta(days=d), "click", 100.0, '{"k": 1}') for d in (0, 10, 20, 35, 44)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    dense = timelines.dense_positions(spark, str(tmp_path)).collect()
    assert sorted(r.frame for r in dense) == list(range(180))
    assert {r.frame for r in dense if r.sample_kind == "observed"} == {0, 40, 80, 140, 176}


def test_timelines_begin_with_the_first_event(spark, tmp_path):
    first = datetime.datetime(2023, 12, 20, 3)
    rows = [(d, u, first + datetime.timedelta(days=d), "click", 100.0, '{"k": 1}') for u, days in ((1, (0, 2)), (2, (13, 14))) for d in days]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    dense = timelines.dense_positions(spark, str(tmp_path)).collect()
    for clip, seen in ((1, {0, 8}), (2, {52, 56})):
        own = [r for r in dense if r.clip_id == clip]
        assert sorted(r.frame for r in own) == list(range(60)) and {r.frame for r in own if r.sample_kind == "observed"} == seen
