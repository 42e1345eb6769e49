"""Range operators move on only what changes, and sum blocks up without sorting."""

import random

from pyspark.sql import functions as F

from motiontables.operators import masks, ranges
from motiontables.operators.blocks import Scan, block_scan


def test_difference_keeps_only_turns(spark, monkeypatch):
    df = spark.createDataFrame([(1, i, i + 1, "a") for i in range(100)] + [(1, 40, 60, "b")], "k int, lo long, hi long, side string")
    kept, whole = [], ranges.cut
    monkeypatch.setattr(ranges, "cut", lambda own: kept.append(own.count()) or whole(own))
    got = ranges.interval_difference(df, ["k"], "lo", "hi", F.col("side") == "a", 16).collect()
    assert sorted(map(tuple, got)) == [(1, "a_only", 0, 40), (1, "a_only", 60, 100)]
    assert kept == [4]


def test_difference_of_meeting_parts(spark):
    df = spark.createDataFrame([(1, 0, 5, "a"), (1, 5, 9, "b"), (1, 9, 9, "a"), (1, 20, 30, "b"), (1, 30, 33, "b"), (1, 22, 25, "a")],
                               "k int, lo long, hi long, side string")
    got = ranges.interval_difference(df, ["k"], "lo", "hi", F.col("side") == "a", 4).collect()
    assert sorted(map(tuple, got)) == [(1, "a_only", 0, 5), (1, "b_only", 5, 9), (1, "b_only", 20, 22), (1, "b_only", 25, 33)]


def test_neighbour_scans_sort_no_summaries(spark):
    df = spark.createDataFrame([(1, p, None if p % 3 == 0 else p) for p in range(40)], "k int, pos long, v long")
    out = block_scan(df, ["k"], ["pos"], [Scan("prev", F.col("v"), "p"), Scan("next", F.col("v"), "n")], 4)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    value = {p: None if p % 3 == 0 else p for p in range(40)}
    assert all((r.p, r.n) == (value.get(r.pos - 1), value.get(r.pos + 1)) for r in out.collect())


def test_interior_with_holes_and_overlaps(spark, monkeypatch):
    rng, runs, lit = random.Random(5), [], []
    for clip in range(3):
        for y in range(6):
            for out, n in ((runs, 5), (lit, 3)):
                for _ in range(n):
                    x = rng.randrange(30)
                    out.append((clip, 0, y, x, x + rng.choice([0, 1, 2, 5, 9, 14])))
    schema = "clip_id int, frame int, y long, x0 long, x1 long"
    merged, whole = [], masks.merged_intervals
    monkeypatch.setattr(masks, "merged_intervals", lambda own, *rest: merged.append(1) or whole(own, *rest))
    got = masks.interior_support(spark.createDataFrame(runs, schema), spark.createDataFrame(lit, schema), min_interior=3, min_share=.5)
    for r in got.collect():
        base = {(y, x) for c, _, y, a, b in runs if c == r.clip_id for x in range(a, b)}
        shine = {(y, x) for c, _, y, a, b in lit if c == r.clip_id for x in range(a, b)}
        inner = {(y, x) for y, x in base if {(y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)} <= base}
        assert (r.interior_px, r.dark_px) == (len(inner), len(inner - shine)) and len(inner) > 0
    assert merged == [1]  # lit runs stay as they are
