"""Identity tracking, lifecycle and their streaming forms."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiontables.operators import identity, lifecycle
from motiontables.operators.identity import observation, track_frame
from motiontables.streaming import stateful, windows

SCHEMA = "clip_id string, view_id string, timestamp_ms long, det_idx int, side string, score double, landmarks array<array<double>>"


def hand(x, y=.5, size=.08):
    pts = [[x + t, y + math.sin(a) * size, 0.0] for t, a in zip(np.linspace(-size, size, 21), np.linspace(0, 2 * math.pi, 21))]
    pts[0] = [x, y, 0.0]
    return [[float(v) for v in p] for p in pts]


def run(frames):
    state, out = identity.new_state(), []
    for ts, hands in frames:
        out.append(track_frame(state, [observation(s, c, hand(x)) for s, c, x in hands], ts))
    return out


def test_native_flip_is_corrected():
    first, second = run([(0, [("left", .9, .25)]), (33, [("right", .99, .26)])])
    assert second[0]["track_id"] == first[0]["track_id"] and second[0]["side"] == "left"
    assert second[0]["corrected"] and not second[0]["ambiguous"]


def test_geometry_wins_over_order():
    first, second = run([(0, [("left", .9, .2), ("right", .9, .8)]), (33, [("right", .9, .79), ("right", .9, .21)])])
    assert [r["side"] for r in second] == ["right", "left"]
    assert [r["track_id"] for r in second] == [first[1]["track_id"], first[0]["track_id"]]


def test_cold_start_conflict_stays_native():
    (out,) = run([(0, [("right", .9, .2), ("right", .9, .8)])])
    assert [r["side"] for r in out] == ["right", "right"] and [r["ambiguous"] for r in out] == [False, True]


def test_gap_and_jump_open_new_tracks():
    a, b = run([(0, [("left", .9, .3)]), (2000, [("left", .9, .3)])])
    assert b[0]["track_id"] != a[0]["track_id"] and b[0]["source"] == "new_track_after_expiry"
    a, b = run([(0, [("left", .9, .1)]), (33, [("left", .9, .9)])])
    assert b[0]["track_id"] != a[0]["track_id"] and b[0]["source"] == "new_track_after_spatial_rejection"


def test_late_frame_changes_nothing():
    state = identity.new_state()
    track_frame(state, [observation("left", .9, hand(.3))], 100)
    before = json.dumps(state, default=float)
    assert track_frame(state, [observation("left", .9, hand(.9))], 100) is None
    assert json.dumps(state, default=float) == before


def recording(seed, frames=60):
    """A random walk of two hands with empty frames, long gaps, crossings and label noise."""
    rng = random.Random(seed)
    ts, out, xs = 0, [], {"left": .3, "right": .7}
    for _ in range(frames):
        ts += rng.choice((33, 33, 33, 150, 700, 1200, 1201, 1500))
        hands = []
        for side in xs:
            xs[side] = min(max(xs[side] + rng.uniform(-.08, .08), .05), .95)
            if rng.random() < .75:
                label = side if rng.random() < .85 else ("left" if side == "right" else "right")
                hands.append((label, round(rng.uniform(.3, 1), 3), xs[side]))
        out.append((ts, hands))
    return out


def put(path, lines, order):
    """Write a stream file; the modification time fixes the arrival order."""
    path.write_text("\n".join(lines))
    os.utime(path, (1_700_000_000 + order, 1_700_000_000 + order))


COMPARED = ("timestamp_ms", "det_idx", "side", "track_id", "track_side", "ambiguous", "source", "gap_ms")


def reference_rows(clip, frames):
    return {(clip, ts, i): tuple(r[k] for k in COMPARED[2:]) for (ts, _), results in zip(frames, run(frames)) for i, r in enumerate(results)}


def test_batch_equals_frame_by_frame(spark):
    rows, expected = [], {}
    for seed in range(6):
        clip, frames = f"c{seed}", recording(seed)
        expected |= reference_rows(clip, frames)
        for ts, hands in frames:
            rows += [(clip, "v", ts, i, s, c, hand(x)) for i, (s, c, x) in enumerate(hands)] or [(clip, "v", ts, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.clip_id, r.timestamp_ms, r.det_idx): tuple(r[k] for k in COMPARED[2:])
           for r in identity.track_identities(df, width=5000).collect()}
    assert got == expected


def test_stream_equals_frame_by_frame(spark, tmp_path):
    source, expected = tmp_path / "in", {}
    source.mkdir()
    clips = {f"c{s}": recording(s, 25) for s in range(3)}
    for clip, frames in clips.items():
        expected |= reference_rows(clip, frames)
    for part in range(3):
        lines = []
        for clip, frames in clips.items():
            for ts, hands in frames[part * 9:(part + 1) * 9]:
                lines.append(json.dumps({"clip_id": clip, "view_id": "v", "timestamp_ms": ts, "hands": [
                    {"det_idx": i, "side": s, "score": c, "landmarks": hand(x)} for i, (s, c, x) in enumerate(hands)]}))
        put(source / f"part{part}.json", lines, part)
    frames = spark.readStream.schema(stateful.FRAME_ROWS).option("maxFilesPerTrigger", 1).json(str(source))
    q = (stateful.track_stream(frames).writeStream.format("memory").queryName("tracked").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(240)
    got = {(r.clip_id, r.timestamp_ms, r.det_idx): tuple(r[k] for k in COMPARED[2:]) for r in spark.table("tracked").collect()}
    assert got == expected


# ---- lifecycle ----------------------------------------------------------

MEMBERSHIP = "clip_id string, frame int, groups array<array<string>>"
AB, A_B = [["a", "b"]], [["a"], ["b"]]
TIMELINES = {
    "split_merge": [AB, AB, A_B, A_B, AB, AB],
    "short": [A_B, A_B, AB, None, AB],
    "gap": [A_B, A_B, None, None, AB, AB],
    "flicker": [AB, AB, None, A_B, AB, A_B, A_B],
    "many": [[["a", "b"], ["c", "d"]]] * 2 + [[["a", "c"], ["b", "d"]]] * 4 + [[["a", "b", "c", "d"]]] * 2,
}


@pytest.fixture(scope="module")
def lifecycles(spark):
    rows = [(n, f, g) for n, t in TIMELINES.items() for f, g in enumerate(t)]
    df = spark.createDataFrame(rows, MEMBERSHIP)
    changes = lifecycle.lifecycle_changes(df, confirmation=2, width=3)
    nodes = {(r.clip_id, r.members, r.birth_frame, r.death_frame) for r in lifecycle.lifecycle_nodes(changes, df).collect()}
    events = {(r.clip_id, r.kind, r.frame, r.confirmed_at, r.bracket.first_possible, r.bracket.last_possible)
              for r in lifecycle.lifecycle_events(changes).collect()}
    tail = {(r.clip_id, r.start, r.value) for r in lifecycle.terminal_pending(df, confirmation=2, width=3).collect()}
    return nodes, events, tail


def test_lifecycle_fixtures(lifecycles):
    nodes, events, tail = lifecycles
    of = lambda name, rows: {r[1:] for r in rows if r[0] == name}
    assert {(b, d) for _, b, d in of("split_merge", nodes)} == {(0, 1), (2, 3), (4, 5)}
    assert {(k, f, c) for k, f, c, *_ in of("split_merge", events)} == {("split", 2, 3), ("merge", 4, 5)}
    assert of("short", events) == set() and {d for _, _, d in of("short", nodes)} == {4}
    assert of("gap", events) == {("merge", 4, 5, 2, 4)}
    assert of("flicker", events) == {("split", 5, 6, 5, 5)}
    assert {e[0] for e in of("many", events)} == {"unresolved", "merge"}
    assert sum(e[0] == "unresolved" for e in of("many", events)) == 2
    assert of("short", tail) == {(4, "a,b")}


def test_a_change_is_not_confirmed_over_a_hole(spark):
    rows = [("c", f, AB) for f in (0, 1)] + [("c", f, A_B) for f in (2, 9)] + [("d", f, g) for f, g in ((0, AB), (1, AB), (2, A_B), (9, A_B), (10, A_B))]
    changes = lifecycle.lifecycle_changes(spark.createDataFrame(rows, MEMBERSHIP), confirmation=2).filter("previous IS NOT NULL")
    assert [(r.clip_id, r.start, r.confirmed_at, r.last_old) for r in changes.collect()] == [("d", 9, 10, 1)]


def test_lifecycle_equals_sequential_machine(spark):
    rng = random.Random(2)
    shapes = [[["a", "b", "c"]], [["a", "b"], ["c"]], [["a"], ["b"], ["c"]], [["a", "c"], ["b"]], None]
    rows, expected = [], {}
    for clip in range(20):
        state, events, frame = stateful.fresh_lifecycle(), [], 0
        for _ in range(12):
            shape = rng.choice(shapes)
            for _ in range(rng.choice((1, 1, 2, 3, 4, 5))):
                rows.append((f"c{clip}", frame, shape))
                text = None if shape is None else "|".join(sorted(",".join(sorted(g)) for g in shape))
                events += stateful.lifecycle_step(state, frame, text, 2)
                frame += 1 if clip % 2 else rng.choice((1, 1, 1, 3))  # every second clip has holes
        events += stateful.lifecycle_finish(state)
        expected[f"c{clip}"] = (
            {(e["event"], e["frame"], e["confirmed_at"]) for e in events if e["event"] in ("split", "merge", "unresolved")},
            {(e["members"], e["birth_frame"], e["death_frame"]) for e in events if e["event"] == "node"})
    df = spark.createDataFrame(rows, MEMBERSHIP)
    changes = lifecycle.lifecycle_changes(df, confirmation=2, width=7).cache()
    got_events, got_nodes = {}, {}
    for r in lifecycle.lifecycle_events(changes).collect():
        got_events.setdefault(r.clip_id, set()).add((r.kind, r.frame, r.confirmed_at))
    for r in lifecycle.lifecycle_nodes(changes, df).collect():
        got_nodes.setdefault(r.clip_id, set()).add((r.members, r.birth_frame, r.death_frame))
    for clip, (events, nodes) in expected.items():
        assert got_events.get(clip, set()) == events, clip
        assert got_nodes.get(clip, set()) == nodes, clip


def test_lifecycle_stream_flushes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    texts = ["a,b", "a,b", "a|b", "a|b", "a,b", "a,b", "a|b"]
    lines = [json.dumps({"clip_id": "c", "frame": f, "partition": t, "finished": False}) for f, t in enumerate(texts)]
    put(source / "0.json", lines[:3], 0)
    put(source / "1.json", lines[3:] + [json.dumps({"clip_id": "c", "frame": 7, "partition": None, "finished": True})], 1)
    rows = spark.readStream.schema("clip_id string, frame long, partition string, finished boolean").option(
        "maxFilesPerTrigger", 1).json(str(source))
    q = (stateful.lifecycle_stream(rows, 2).writeStream.format("memory").queryName("lived").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(240)
    got = spark.table("lived").collect()
    assert {(r.event, r.frame, r.confirmed_at) for r in got if r.event in ("split", "merge")} == {("split", 2, 3), ("merge", 4, 5)}
    assert {(r.members, r.birth_frame, r.death_frame) for r in got if r.event == "node"} == {
        ("a,b", 0, 1), ("a", 2, 3), ("b", 2, 3), ("a,b", 4, 6)}
    assert [r.members for r in got if r.event == "unconfirmed_terminal_partition"] == ["a|b"]


def test_membership_rules(spark):
    rows = [("c", 0, AB, True, "k", "d"), ("c", 1, AB, True, "k", "d"), ("c", 2, None, True, "k", "d"), ("c", 3, [["a"], ["a"]], True, "k", "d"),
            ("c", 4, [["a", "x y"]], True, "", "d"), ("c", 6, AB, None, "k", "d")]
    df = spark.createDataFrame(rows, MEMBERSHIP + ", supported boolean, kind string, description string")
    got = {(r.frame, r.message) for r in lifecycle.membership_issues(df, confirmation=2).collect()}
    assert {(2, "support flag contradicts groups"), (3, "groups are not disjoint"), (3, "member set changed"), (4, "unsafe member id"),
            (4, "member set changed"), (4, "evidence text missing"), (6, "frames must be consecutive"),
            (6, "support flag not explicit")} == got


def test_session_edges_and_publish(spark, tmp_path):
    df = spark.createDataFrame([("c", t) for t in (0, 1200, 2401)], "clip_id string, ms long")
    got = identity.track_sessions(df, ["clip_id"], "ms", 1200, width=500).orderBy("ms").collect()
    assert [r.session for r in got] == [1, 1, 2]
    w = windows.sessions(df.withColumn("t", windows.as_event_time(F.col("ms"))), ["clip_id"], "t").collect()
    assert sorted(r["rows"] for r in w) == [1, 2]
    write = windows.publisher(str(tmp_path / "out"))
    for _ in range(2):
        write(df, 7)
    write(df.limit(1), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.batch_id: r["count"] for r in back.groupBy("batch_id").count().collect()} == {7: 3, 8: 1}


def test_hopping_quality_and_progress(spark):
    frames = spark.createDataFrame([("c", f, f / 40, f % 2 == 0) for f in range(40)], "clip_id string, frame long, score double, blur_flag boolean")
    full = [r for r in windows.hopping_quality(frames, ["clip_id"], 20.0).collect() if r.frames == 15]
    assert len(full) == 6 and {round(r.mean_score * 40, 6) for r in full} == {7.0, 12.0, 17.0, 22.0, 27.0, 32.0}
    totals = spark.createDataFrame([("c", 80)], "clip_id string, frames_total long")
    assert windows.running_progress(frames, totals).collect()[0].fraction == 0.5


def test_refused_frames_touch_no_track(spark):
    """Crowded frames, unknown sides, broken landmarks: rejected rows; the tracks go on as if they had not been."""
    good = [(0, [("left", .9, .25), ("right", .8, .7)]), (33, [("left", .9, .26)]), (100, [("left", .9, .27), ("right", .9, .7)])]
    rows = [("c", "v", ts, i, s, c, hand(x)) for ts, hands in good for i, (s, c, x) in enumerate(hands)]
    rows += [("c", "v", 50, i, "left", .9, hand(.2 + i / 10)) for i in range(3)]
    rows += [("c", "v", 60, 0, "both", .9, hand(.3)), ("c", "v", 60, 1, "left", .9, hand(.3))]
    rows += [("c", "v", 70, 0, "left", .9, [[float("nan")] * 3] * 21), ("c", "v", 80, 0, "left", .9, [[.1, .1, .1]] * 20),
             ("c", "v", 85, 0, "left", None, hand(.3)), ("c", "v", 90, 0, None, .9, hand(.3))]
    got = identity.track_identities(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = {("c", r.timestamp_ms, r.det_idx): tuple(r[k] for k in COMPARED[2:]) for r in got if not r.source.startswith("rejected")}
    assert kept == reference_rows("c", good)
    refused = sorted((r.timestamp_ms, r.det_idx, r.source) for r in got if r.track_id is None)
    crowd, flaw = "rejected_more_than_two_detections", "rejected_invalid_detection"
    assert refused == [(50, 0, crowd), (50, 1, crowd), (50, 2, crowd), (60, 0, flaw), (60, 1, flaw), (70, 0, flaw),
                       (80, 0, flaw), (85, 0, flaw), (90, 0, flaw)]


def test_identity_decisions():
    """Crossing hands keep their native side, a separate second hand is inferred, a suspicion is settled later."""
    first, crossing = run([(0, [("left", .9, .45), ("right", .9, .55)]), (33, [("left", .9, .5), ("right", .9, .5)])])
    assert all(r["ambiguous"] and r["side"] == r["native_side"] for r in crossing)
    a, b, c = run([(0, [("left", .9, .2)]), (33, [("left", .9, .2), ("left", .8, .8)]), (66, [("left", .9, .2), ("right", .8, .8)])])
    assert b[1]["source"] == "new_track_opposite_hand_inference" and b[1]["side"] == "right" and b[1]["opposite_inferred"]
    assert not c[1]["ambiguous"] and c[1]["track_id"] == b[1]["track_id"]
    with pytest.raises(ValueError):
        run([(0, [("left", .9, .1), ("left", .9, .5), ("right", .9, .9)])])
    for bad in ({"max_gap_ms": 0}, {"max_gap_ms": True}, {"ambiguity_margin": -1.0}):
        with pytest.raises(ValueError):
            identity.TrackingRules(**bad)
