"""What the batch form of identity tracking moves: eight numbers a detection, sessions in one scan, whole values through the fold."""

import random

from pyspark.sql import functions as F

from motiontables.operators import fold, identity

SCHEMA = "clip_id string, view_id string, timestamp_ms long, det_idx int, side string, score double, landmarks array<array<double>>"


def points(rng):
    return [[rng.uniform(0, 1), rng.uniform(0, 1), 0.0] for _ in range(21)]


def test_landmarks_stay_behind_and_shapes_are_those_of_the_frame_rule(spark, monkeypatch):
    rng, kept = random.Random(3), []
    rows = [("c", "v", 400 * i, 0, "left", .5, points(rng)) for i in range(40)]
    rows += [("c", "v", 400 * i, 1, "right", .5, bad) for i, bad in enumerate(
        (None, [], [None] * 21, [[.1]] * 21, [[.1, None]] * 21, [[.1, .2, float("inf")]] * 21, [[.1, .2]] * 20), 50)]

    def caught(df, *args):
        kept.append(df)
        return fold.sorted_fold(df, *args)

    monkeypatch.setattr(identity, "sorted_fold", caught)
    refused = [r.source for r in identity.track_identities(spark.createDataFrame(rows, SCHEMA)).collect() if r.track_id is None]
    assert refused == ["rejected_invalid_detection"] * 7
    (moved,) = kept
    assert "landmarks" not in moved.columns and not [t for _, t in moved.dtypes if t.startswith("array")]
    got = {r.timestamp_ms: [r[n] for n in identity.SHAPE] for r in moved.filter("rejection IS NULL").collect()}
    assert got == {ts: identity.observation(side, score, p)["shape"] for _, _, ts, _, side, score, p in rows[:40]}


def test_sessions_cross_blocks_and_rows_without_detection(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for clip in ("a", "b", "c"):
        ts, last, session = 0, None, 0
        for i in range(300):
            ts += rng.choice((0, 30, 400, 1200, 1201, 9000))
            seen = rng.random() < .6
            if seen:
                session += last is None or ts - last > 1200
                last = ts
            rows.append((clip, ts, i, seen))
            expected[clip, i] = session
    df = spark.createDataFrame(rows, "clip_id string, t long, i int, seen boolean")
    for width in (1, 700, 5000, 10**9):
        got = identity._with_sessions(df, ["clip_id"], ["t", "i"], F.when(F.col("seen"), F.col("t")), 1200, width).collect()
        assert {(r.clip_id, r.i): r.session for r in got} == expected


def test_fold_keeps_types_and_missing_values(spark):
    df = spark.createDataFrame([(k, i, None if i % 2 else 2**53 + i, None if i % 3 else f"s{i}") for k in (1, 2) for i in range(5)],
                               "k short, i int, big long, s string")

    def step(state, row):
        if row is None:
            return [{"big": state["n"], "names": state["names"]}]
        state["n"] += 1
        state["names"].append(row["s"])
        return [{"big": row["big"], "flag": row["big"] is None}] if row["i"] != 3 else []

    got = fold.sorted_fold(df, ["k"], ["i"], lambda: {"n": 0, "names": []}, step, "k short, big bigint, flag boolean, names array<string>")
    assert got.dtypes == [("k", "smallint"), ("big", "bigint"), ("flag", "boolean"), ("names", "array<string>")]
    for k in (1, 2):
        assert [tuple(r)[1:] for r in got.filter(f"k = {k}").collect()] == [
            (2**53, False, None), (None, True, None), (2**53 + 2, False, None), (2**53 + 4, False, None), (5, None, ["s0", None, None, "s3", None])]
