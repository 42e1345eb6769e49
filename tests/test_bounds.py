"""Input beyond the fixtures: frames outside the clip, repeated frames, nested versions, unreadable documents."""

from pyspark.sql import functions as F

from motiontables.operators import fill, scale, timeline
from motiontables.sources import captures


def test_frames_outside_the_clip_are_reported_and_not_filled(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (1, 12, 2.0), (1, -1, 3.0), (1, None, 4.0)], "clip long, frame long, v double")
    filled = fill.expand_gaps(df, ["clip"], ["v"], 10)
    assert [r.at for r in filled.orderBy("at").collect()] == list(range(10))
    assert sorted(r.v for r in fill.outside_frames(df, 10).collect()) == [2.0, 3.0, 4.0]


def test_repeated_frames_fill_no_gap_twice(spark):
    df = spark.createDataFrame([(1, 3, 1.0), (1, 3, 2.0), (1, 5, 3.0)], "clip long, frame long, v double")
    assert [r.at for r in fill.expand_gaps(df, ["clip"], ["v"], 7).orderBy("at").collect()] == [0, 1, 2, 3, 3, 4, 5, 6]


def test_frames_outside_the_clip_are_in_no_window(spark):
    df = spark.createDataFrame([(0,), (119,), (120,), (130,), (-3,)], "frame long")
    assert {r.frame for r in timeline.hopping_windows(df, 120).collect()} == {0, 119}


def test_upgrade_leaves_nested_versions(spark):
    text = '{"a": {"format_version": "1.0"}, "b": ["format_version", "1.0"], "format_version" : "1.0"}'
    out = captures.upgrade_version(spark.createDataFrame([("x", text), ("y", None)], "doc_id string, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {"x": text[:-5] + '1.1"}', "y": None}


def test_unreadable_documents_are_invalid_leaves(spark):
    rows = [("null", None), ("deep", "[" * 100_000), ("wide", '{"a": 1' + "0" * 400 + "}"), ("good", '{"a": 1}')]
    leaves = captures.leaves(spark.createDataFrame(rows, "doc_id string, text string"))
    kinds = {r.doc_id: r.kind for r in leaves.select("doc_id", "kind").distinct().collect()}
    assert kinds["null"] == kinds["deep"] == "invalid" and kinds["good"] == "number" and "wide" in kinds


def test_contact_correspondence_is_an_independent_method():
    assert "mano_verified_contact_correspondence" in scale.INDEPENDENT_METHODS
