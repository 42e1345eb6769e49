"""Ranges, ordered scans, filling and selection against analytic fixtures and plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiontables.operators import fill, ranges, selection, timeline
from motiontables.operators.blocks import Scan, block_scan
from motiontables.operators.quantiles import exact_quantiles


def test_frame_ranges_fixture(spark):
    df = spark.createDataFrame([("a", f) for f in (5, 1, 2, 2, 7, 8)], "clip_id string, frame int")
    got = sorted((r.start, r.end) for r in ranges.frame_ranges(df, ["clip_id"]).collect())
    assert got == [(1, 2), (5, 5), (7, 8)]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_frame_ranges_do_not_depend_on_blocks(spark, width):
    rng = random.Random(width)
    data = [(c, rng.randrange(60)) for c in "ab" for _ in range(50)]
    df = spark.createDataFrame(data, "clip_id string, frame int")
    expected = set()
    for c in "ab":
        frames = sorted({f for k, f in data if k == c})
        run = [frames[0], frames[0]]
        for f in frames[1:]:
            if f == run[1] + 1:
                run[1] = f
            else:
                expected.add((c, *run))
                run = [f, f]
        expected.add((c, *run))
    assert {(r.clip_id, r.start, r.end) for r in ranges.frame_ranges(df, ["clip_id"], width=width).collect()} == expected


@pytest.mark.parametrize("width", [2, 7, 10000])
def test_block_scan_equals_one_pass(spark, width):
    rng = random.Random(7)
    data = [(k, i * rng.choice((1, 1, 5)) + i, i, rng.choice((None, 1.0, 2.5, -3.0))) for k in ("x", "y") for i in range(40)]
    df = spark.createDataFrame(data, "k string, pos long, id int, v double")
    got = block_scan(df, ["k"], ["pos", "id"], [
        Scan("prev", F.col("v"), "p"), Scan("next", F.col("id"), "n"), Scan("last_known", F.col("v"), "lk"),
        Scan("next_known", F.col("v"), "nk"), Scan("sum", F.col("v"), "s"), Scan("max", F.col("v"), "m"),
        Scan("max_before", F.col("v"), "mb")], width).collect()
    for key in ("x", "y"):
        seq = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))
        mine = {r.id: r for r in got if r.k == key}
        for i, (_, _, ident, v) in enumerate(seq):
            r = mine[ident]
            before = [x[3] for x in seq[:i]]
            known = [x for x in before + [v] if x is not None]
            after = [x[3] for x in seq[i:] if x[3] is not None]
            assert r.p == (before[-1] if before else None)
            assert r.n == (seq[i + 1][2] if i + 1 < len(seq) else None)
            assert r.lk == (known[-1] if known else None)
            assert r.nk == (after[0] if after else None)
            assert r.s == pytest.approx(sum(known))
            assert r.m == (max(known) if known else None)
            earlier = [x for x in before if x is not None]
            assert r.mb == (max(earlier) if earlier else None)


def test_fill_fixture(spark):
    q90 = [0.0, 0.0, math.sqrt(0.5), math.sqrt(0.5)]
    df = spark.createDataFrame([("c", "left", 1, [0., 2., 4.], [0., 0., 0., 1.]), ("c", "left", 3, [10., 4., 8.], q90)],
                               "clip_id string, side string, frame long, trans array<double>, quat array<double>")
    got = fill.fill_vectors(df, ["clip_id", "side"], ["trans"], 5).orderBy("frame").collect()
    assert [r.sample_kind for r in got] == ["endpoint_hold", "observed", "interpolated", "observed", "endpoint_hold"]
    assert got[2].trans == [5., 3., 6.] and got[2].source_frames == [1, 3] and got[2].alpha == 0.5
    assert got[0].trans == [0., 2., 4.] and got[4].trans == [10., 4., 8.] and got[1].alpha is None
    rot = fill.fill_rotations(df, ["clip_id", "side"], "quat", 5).orderBy("frame").collect()
    assert rot[2].quat == pytest.approx([0, 0, math.sin(math.pi / 8), math.cos(math.pi / 8)])


def test_fill_equals_numpy_interp(spark):
    rng = np.random.default_rng(3)
    frames = sorted(rng.choice(200, 30, replace=False).tolist())
    values = rng.normal(size=30).tolist()
    df = spark.createDataFrame([("c", int(f), [v]) for f, v in zip(frames, values)], "clip_id string, frame long, v array<double>")
    got = [r.v[0] for r in fill.fill_vectors(df, ["clip_id"], ["v"], 200, width=16).orderBy("frame").collect()]
    assert got == pytest.approx(np.interp(np.arange(200), frames, values).tolist())


def test_slerp_takes_the_short_way(spark):
    def about_z(deg):
        return [0., 0., math.sin(math.radians(deg) / 2), math.cos(math.radians(deg) / 2)]
    df = spark.createDataFrame([("c", 0, about_z(170)), ("c", 2, about_z(-170))], "clip_id string, frame long, quat array<double>")
    mid = fill.fill_rotations(df, ["clip_id"], "quat", 3).orderBy("frame").collect()[1].quat
    assert abs(mid[2]) == pytest.approx(1.0) and abs(mid[3]) < 1e-12


def _sequential_fill(observed, count):
    """Plain model of the dense rule: fill every frame, then flip against the previous one."""
    def slerp(a, b, t):
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
        d = float(a @ b)
        b, d = (-b, -d) if d < 0 else (b, d)
        d = min(d, 1.0)
        w = (1 - t) * a + t * b if d > .9995 else (np.sin((1 - t) * np.arccos(d)) * a + np.sin(t * np.arccos(d)) * b) / np.sin(np.arccos(d))
        return w / np.linalg.norm(w)
    keys, out = sorted(observed), []
    for f in range(count):
        lower, upper = [k for k in keys if k <= f], [k for k in keys if k >= f]
        if f in observed or not lower or not upper:
            q = observed[f if f in observed else (lower[-1] if lower else upper[0])].copy()
        else:
            q = slerp(observed[lower[-1]], observed[upper[0]], (f - lower[-1]) / (upper[0] - lower[-1]))
        if (out and q @ out[-1] < 0) or (not out and q[3] < 0):
            q = -q
        out.append(q)
    return np.array(out)


@pytest.mark.parametrize("seed", range(3))
def test_rotation_fill_equals_sequential_rule(spark, seed):
    rng = np.random.default_rng(seed)
    data, expected = [], {}
    for clip in range(8):
        frames = sorted(rng.choice(40, 12, replace=False).tolist())
        quats = rng.normal(size=(12, 4))
        quats /= np.linalg.norm(quats, axis=1, keepdims=True)
        data += [(clip, int(f), q.tolist()) for f, q in zip(frames, quats)]
        expected[clip] = _sequential_fill(dict(zip(frames, quats)), 40)
    df = spark.createDataFrame(data, "clip_id int, frame long, quat array<double>")
    for r in fill.fill_rotations(df, ["clip_id"], "quat", 40, width=8).collect():
        assert r.quat == pytest.approx(expected[r.clip_id][r.frame].tolist(), abs=1e-9)


def test_selection_fixtures(spark):
    s = "clip_id string, frame int, side string, det_idx int, ambiguous boolean"
    df = spark.createDataFrame([
        ("c", 0, "left", 0, True), ("c", 1, "left", 0, True), ("c", 1, "left", 1, False), ("c", 2, "left", 0, True),
        ("c", 2, "left", 1, True), ("c", 3, "left", 0, False), ("c", 3, "left", 1, None)], s)
    got = {r.frame: (r.outcome, r.row.det_idx if r.row else None) for r in selection.classify_groups(df).collect()}
    assert got == {0: ("retained", 0), 1: ("retained", 1), 2: ("excluded", None), 3: ("conflict", None)}
    assert sorted((r.frame, r.det_idx) for r in selection.exclusions(df).collect()) == [(1, 0), (2, 0), (2, 1)]
    assert [(r.clip_id, r.side) for r in selection.missing_sides(df).collect()] == [("c", "right")]


def test_view_summary_fixture(spark):
    s = "clip_id string, frame int, side string, score double, available boolean, outside boolean, has_parameters boolean, blur_flag boolean"
    df = spark.createDataFrame([("c", 0, "left", .9, True, False, True, False), ("c", 1, None, None, True, None, None, False),
                                ("c", 2, None, None, False, None, None, None)], s)
    frames = timeline.view_frames(df, ["clip_id"], 0.5)
    r = timeline.view_summary(frames, ["clip_id"]).collect()[0]
    assert (r.timeline_frames, r.available_frames, r.valid_frames, r.valid_frame_rate, r.both_sides_frames) == (3, 2, 1, .5, 0)
    assert [(x.start, x.end) for x in timeline.review_ranges(frames, ["clip_id"]).filter("reason = 'review'").collect()] == [(0, 1)]
    none = timeline.view_summary(frames.filter("not available"), ["clip_id"]).collect()[0]
    assert none.valid_frame_rate is None and none.mean_score is None


def test_hopping_windows_are_right_aligned(spark):
    for n in (4, 15, 17, 33):
        df = spark.createDataFrame([(f,) for f in range(n)], "frame long")
        got = {(r.window_start, r.frame) for r in timeline.hopping_windows(df, n).collect()}
        size = min(15, n)
        starts = set(range(0, max(1, n - size + 1), 5)) | {max(0, n - size)}
        assert got == {(s, f) for s in starts for f in range(s, s + size)}


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    powers = 2.0 ** rng.integers(-1074, 1023, 3000)
    groups = {"big": rng.integers(0, 400, 5000) / 7, "small": rng.normal(size=9), "one": np.array([4.0]), "ties": np.ones(800),
              "outlier": np.concatenate([rng.normal(size=2000), [1e300, -1e300]]),
              "powers": np.concatenate([powers, np.nextafter(powers, 0), -np.nextafter(powers, np.inf)]),
              "close": 1.0 + rng.integers(0, 500, 3000) * 2.0**-52,  # one fine bin
              "zeros": np.array([-0.0, 0.0, 0.0, -1e-320, 1e-320]), None: rng.normal(size=50)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs]
                               + [("big", None), ("big", float("nan")), ("absent", None)], "k string, v double").repartition(5)
    probs = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], F.col("v"), probs).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(float(np.quantile(vs, p)), rel=1e-14, abs=1e-323), (k, name)


def test_exact_quantiles_at_the_ends_of_the_doubles(spark):
    ends = [float("inf")] * 3 + [1.7976931348623157e308] * 3 + [5e-324] * 3 + [-5e-324] * 3 + [-1.7976931348623157e308] * 3 + [float("-inf")] * 3
    got = exact_quantiles(spark.createDataFrame([(v,) for v in ends], "v double"), [], F.col("v"),
                          {str(i): i / 17 for i in range(18)}).collect()[0]
    assert got.n == 18 and [got[str(i)] for i in range(18)] == sorted(ends)
    empty = exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], F.col("v"), {"m": .5})
    assert empty.columns == ["k", "n", "m"] and empty.count() == 0


def test_exact_quantiles_read_their_source_once(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(20000).selectExpr("id % 3 AS k", "sqrt(id) AS v").write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.read.parquet(path).mapInArrow(seen, "k long, v double")
    assert exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5, "p": 0.9}).count() == 3
    assert read.value == 20000


def test_union_length_and_difference(spark):
    rng = random.Random(11)
    data = [("k", a, a + rng.randrange(-1, 9), rng.random() < .5) for a in (rng.randrange(60) for _ in range(40))]
    df = spark.createDataFrame(data, "k string, lo long, hi long, first boolean")
    px = {True: set(), False: set()}
    for _, lo, hi, first in data:
        px[first] |= set(range(lo, hi))
    assert ranges.union_length(df, ["k"], "lo", "hi", 8).collect()[0].covered == len(px[True] | px[False])
    got = {"a_only": set(), "b_only": set()}
    for r in ranges.interval_difference(df, ["k"], "lo", "hi", F.col("first"), 8).collect():
        got[r.part] |= set(range(r.lo, r.hi))
    assert got == {"a_only": px[True] - px[False], "b_only": px[False] - px[True]}
