"""Gates, sweep, scale, geometry, masks, views and profiles against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motiontables.functions import camera, rotation
from motiontables.operators import candidates, gates, geometry, lineage, masks, motion, profiles, scale, sweep, views
from motiontables.operators.gates import GeometryCriteria
from motiontables.plans.registry import full_catalog
from motiontables.sources import sinks


def assess(spark, frames, length=1.0, known=True):
    rows = [("c", i, l, r, l is not None, r is not None) for i, (l, r) in enumerate(frames)]
    df = spark.createDataFrame(rows, "clip_id string, frame int, left array<double>, right array<double>, left_valid boolean, right_valid boolean")
    states = gates.geometry_states(df, ["clip_id"], F.lit(length), known=F.lit(known))
    return {r.check: r for r in gates.gate_summary(states, ["clip_id", "check"]).collect()}


GOOD = ([0., 0., 5.], [1., 0., 5.])


def test_gate_fixtures(spark):
    assert all(r.status == "passed" for r in assess(spark, [GOOD]).values())
    assert assess(spark, [([0., 0., 5.], [1.5, 0., 5.])])["wrist_distance"].status == "failed"
    edge = assess(spark, [([0., 0., 2.], [1., 0., 2.]), ([0., 0., 10.], [1., 0., 10.])])
    assert edge["left_depth"].status == edge["right_depth"].status == "passed"
    assert assess(spark, [([0., 0., 5.], [0., 0., 7.])])["depth_difference"].status == "failed"
    many = assess(spark, [GOOD] * 98 + [([0., 0., 5.], [3., 0., 5.])])["wrist_distance"]
    assert many.status == "failed" and many.median == 1 and many.failed_frames == 1
    assert assess(spark, [GOOD, ([0., 0., 5.], None)])["wrist_distance"].status == "unassessable"
    nan = assess(spark, [([0., 0., float("nan")], [1., 0., 5.])])
    assert nan["left_depth"].status == "unassessable" and nan["left_depth"].median is None
    unknown = assess(spark, [GOOD], known=False)
    assert all(r.status == "unassessable" and r.minimum is None for r in unknown.values())
    scaled = assess(spark, [([0., 0., 35.], [7., 0., 35.])], length=7.0)
    assert all(r.status == "passed" for r in scaled.values())


def brute_focal(lc, rc, ls, rs, length, c):
    """Score every boundary, interval centre and end by direct evaluation."""
    bounds = [(t * length - x[:, 2]) / s for x, s in ((lc, ls), (rc, rs)) for t in (c.depth_min, c.depth_max)]
    d, ds = lc - rc, ls - rs
    move = ds != 0
    rest = (c.wrist_distance_max * length) ** 2 - (d[:, :2] ** 2).sum(1)
    for sign in (-1, 1):
        bounds.append((sign * c.depth_difference_max * length - d[move, 2]) / ds[move])
        ok = move & (rest >= 0)
        bounds.append((sign * np.sqrt(rest[ok]) - d[ok, 2]) / ds[ok])
    b = np.unique([x for x in np.concatenate(bounds) if x > 0 and np.isfinite(x)])
    mid = (c.depth_min + c.depth_max) / 2 * length
    pref = np.concatenate([(mid - lc[:, 2]) / ls, (mid - rc[:, 2]) / rs])
    preferred = float(np.median(pref[pref > 0]))
    options = [(x, True, 0.0) for x in b] + [(b[0] / 2, False, math.log(2)), (b[-1] * 2, False, math.log(2))]
    options += [(math.sqrt(lo * hi), False, math.log(math.sqrt(hi / lo))) for lo, hi in zip(b, b[1:])]

    def score(o):
        f, edge, clear = o
        lz, rz = lc[:, 2] + f * ls, rc[:, 2] + f * rs
        dz = lz - rz
        bad = np.stack([np.sqrt((d[:, :2] ** 2).sum(1) + dz ** 2) / length >= c.wrist_distance_max,
                        (lz / length < c.depth_min) | (lz / length > c.depth_max), (rz / length < c.depth_min) | (rz / length > c.depth_max),
                        np.abs(dz) / length >= c.depth_difference_max])
        return (int(bad.any(0).sum()), int(bad.sum()), edge, round(-clear, 9), round(abs(math.log(f / preferred)), 9), f)

    return min(score(o) for o in options), preferred


@pytest.mark.parametrize("seed", range(2))
def test_sweep_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for clip in range(4):
        n = 25
        lc, rc = rng.normal(size=(n, 3)), rng.normal(size=(n, 3))
        ls = rng.uniform(.002, .006, n)
        rs = ls.copy() if clip == 3 else rng.uniform(.002, .006, n)
        data[clip] = (lc, rc, ls, rs)
        rows += [(clip, i, lc[i].tolist(), rc[i].tolist(), float(ls[i]), float(rs[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "clip_id int, frame int, lc array<double>, rc array<double>, ls double, rs double")
    for r in sweep.select_focal(df, ["clip_id"], 1.0).collect():
        best, preferred = brute_focal(*data[r.clip_id], 1.0, GeometryCriteria())
        assert r.preferred == pytest.approx(preferred)
        assert (r.failed_frames, r.failed_gates, r.at_boundary) == best[:3]
        assert r.focal == pytest.approx(best[-1])


def test_sweep_without_boundaries(spark):
    df = spark.createDataFrame([("c", 0, [0., 0., 20.], [0., 0., 20.], .01, .01)],
                               "clip_id string, frame int, lc array<double>, rc array<double>, ls double, rs double")
    r = sweep.select_focal(df, ["clip_id"], 1.0).collect()[0]
    assert r.focal == pytest.approx(100.0) and (r.failed_frames, r.failed_gates) == (1, 2)


def test_scale_outlier_does_not_move_the_median(spark):
    rows = [("g", f, 2.0) for f in range(5)] + [("g", 5, 9.0), ("g", 5, 9.0), ("g", 0, 2.0)]
    frames = scale.frame_medians(spark.createDataFrame(rows, "scale_group string, frame int, r double"), ["scale_group"], ["frame"], F.col("r"))
    s = scale.robust_scale(frames, ["scale_group"])
    r = s.collect()[0]
    assert (r.frames, r.factor, r.mad) == (6, 2.0, 0.0) and r.threshold == pytest.approx(.1)
    assert [x.frame for x in scale.scale_outliers(frames, s, ["scale_group"]).collect()] == [5]
    groups = spark.createDataFrame([("g",), ("m",), ("u",)], "scale_group string")
    measured = spark.createDataFrame([("m", .18, 2.0), ("m", .18, 1.5), ("g", 1.0, 1.0)], "scale_group string, measured_length double, neutral_length double")
    got = {x.scale_group: (x.anchor_method, x.meters_per_unit, x.global_factor) for x in scale.scale_fallback(groups, ["scale_group"], s, measured).collect()}
    assert got["g"] == ("card_pnp", 2.0, 2.0) and got["u"] == (None, None, 1.0)
    assert got["m"][0] == "user_measured" and got["m"][1] == pytest.approx((.09 + .12) / 2)


def test_anchor_reasons(spark):
    ok = dict(kind="same_segment", source_points=[[0., 0., 1.], [.03175, 0., 1.]], metric_points=[[0., 0., 2.], [.0635, 0., 2.]], candidate_id="a",
              near_best=["a", "b"], accepted=True, calibrated=True, full_face=True, eligible=True, independent=True,
              method="independent_scene_reconstruction", camera_evidence=True, correspondence_evidence=True, face_evidence=True, dimension_evidence=True,
              candidate_valid=True, source_camera_frame="s", metric_camera_frame="s")
    schema = ("kind string, source_points array<array<double>>, metric_points array<array<double>>, candidate_id string, near_best array<string>, "
              "accepted boolean, calibrated boolean, full_face boolean, eligible boolean, independent boolean, method string, camera_evidence boolean, "
              "correspondence_evidence boolean, face_evidence boolean, dimension_evidence boolean, candidate_valid boolean, source_camera_frame string, metric_camera_frame string")
    point = {**ok, "kind": "same_camera_point", "source_points": [[0., 0., 1.]], "metric_points": [[0., 0., 2.]]}
    rows = [ok, {**ok, "near_best": ["b"], "calibrated": None}, point, {**point, "metric_points": [[1., 0., 2.]]}]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = df.select(scale.anchor_reasons().alias("why"), scale.anchor_ratio().alias("ratio")).collect()
    assert got[0].why == [] and got[0].ratio == pytest.approx(2.0)
    assert got[1].why == ["candidate_not_near_best", "unconfirmed_calibrated"]
    assert got[2].why == [] and got[2].ratio == pytest.approx(2.0)
    assert got[3].why == ["points_are_no_multiples"]


def test_quad_focal_recovers_a_known_camera(spark):
    w, h, f = 6.35, 8.89, 900.0
    a, b = math.radians(35), math.radians(20)
    r = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]]) @ np.array(
        [[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    pts = np.array([[-w, -h, 0], [w, -h, 0], [w, h, 0], [-w, h, 0]]) / 2 @ r.T + [1, -2, 40]
    px = (pts[:, :2] / pts[:, 2:] * f + [640, 360]).tolist()
    flat = [[0., 0.], [100., 0.], [100., 140.], [0., 140.]]
    df = spark.createDataFrame([(px,), (flat,)], "c array<array<double>>")
    got = [r.f for r in df.select(camera.quad_focal(F.col("c"), F.lit(w), F.lit(h), F.array(F.lit(1280.0), F.lit(720.0))).alias("f")).collect()]
    assert got[0].accepted and got[0].focal_px == pytest.approx(f, rel=1e-9)
    assert not got[1].accepted and got[1].reasons == ["focal_unidentifiable_projection"]


def test_rotation_round_trips(spark):
    rng = np.random.default_rng(0)
    q = rng.normal(size=(50, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q[q[:, 3] < 0] *= -1
    df = spark.createDataFrame([(x.tolist(),) for x in q] + [([0., 0., 0., 1.],)], "q array<double>")
    got = df.select("q", rotation.matrix_to_quat(rotation.quat_to_matrix(F.col("q"))).alias("m"),
                    rotation.axis_angle_to_quat(rotation.quat_to_axis_angle(F.col("q"))).alias("v"),
                    rotation.engine_rotation_to_model(rotation.model_rotation_to_engine(F.col("q"))).alias("e")).collect()
    for r in got:
        assert r.m == pytest.approx(r.q) and r.v == pytest.approx(r.q) and r.e == r.q


def test_hull_and_greedy_selection(spark):
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(300, 2))
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in pts], "k string, x double, y double").repartition(5)
    direct = motion.hull(pts)
    area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(direct, np.roll(direct, -1, axis=0)))) / 2
    assert motion.hull_area(df, ["k"]).collect()[0].hull_area == pytest.approx(area)
    span = max(math.dist(a, b) for a in pts for b in pts)
    assert views.centre_span(df, ["k"]).collect()[0].span == pytest.approx(span)
    vecs = rng.uniform(0, 1, size=(120, 4))
    v = spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(vecs)], "k string, id int, v array<double>")
    pairs = views.near_pairs(v, ["k"], "id", "v", 4, .25, points=2)
    rms = lambda a, b: math.sqrt(((a - b) ** 2).sum() / 2)
    assert {(r["first"], r["second"]) for r in pairs.collect()} == {(i, j) for i in range(120) for j in range(i + 1, 120) if rms(vecs[i], vecs[j]) < .25}
    kept = []
    for i in range(120):
        if all(rms(vecs[i], vecs[j]) >= .25 for j in kept):
            kept.append(i)
    assert sorted(r.id for r in views.keep_first(v, pairs, ["k"], "id").filter("kept").collect()) == kept


def test_grid_flips_find_reversed_views(spark):
    grid = np.arange(12, dtype=float).reshape(2, 3, 2) ** 1.3
    rows = [("c", 0, grid.ravel().tolist()), ("c", 1, grid[::-1, ::-1].ravel().tolist()), ("c", 2, (grid + 50).ravel().tolist())]
    v = spark.createDataFrame(rows, "k string, id int, v array<double>")
    got = views.near_pairs(v, ["k"], "id", "v", 12, .01, points=6, variants=views.grid_flips(F.col("v"), 2, 3)).collect()
    assert [(r["first"], r["second"]) for r in got] == [(0, 1)]


def test_kinematics_and_positions(spark):
    rng = np.random.default_rng(8)
    q = rng.normal(size=(16, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    off = rng.normal(size=(16, 3))

    def matrix(x, y, z, w):
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
                         [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    world, pos = [], []
    for j, p in enumerate(geometry.JOINT_PARENTS):
        world.append(matrix(*q[j]) if p < 0 else world[p] @ matrix(*q[j]))
        pos.append(off[j] if p < 0 else pos[p] + world[p] @ off[j])
    df = spark.createDataFrame([(q.tolist(), off.tolist())], "q array<array<double>>, o array<array<double>>")
    found = geometry.forward_kinematics(df.withColumn("k", F.lit(7)), "q", "o").withColumn("m", rotation.quat_to_matrix(F.col("world"))).orderBy("joint").collect()
    assert [(r.k, r.joint) for r in found] == [(7, j) for j in range(16)]
    assert np.allclose([r.position for r in found], pos) and np.allclose(np.array([r.m for r in found]).reshape(16, 3, 3), world)
    holed = df.withColumn("q", F.transform("q", lambda v, i: F.when(i != 1, v)))
    below = {r.joint for r in geometry.forward_kinematics(holed, "q").collect() if r.world is None}
    assert below == {j for j, c in enumerate(geometry._chains(geometry.JOINT_PARENTS)) if 1 in c}
    assert [r.world for r in geometry.forward_kinematics(df.withColumn("q", F.lit(None).cast("array<array<double>>")), "q").collect()] == [None] * 16


def test_mask_fixtures(spark):
    runs = [("c", 0, "big", y, 0, 40) for y in range(20)] + [("c", 0, "small", y, 5, 15) for y in range(10)]
    df = spark.createDataFrame(runs, "clip_id string, frame int, object_id string, y int, x0 int, x1 int")
    r = masks.pair_overlaps(df).collect()[0]
    assert (r.intersection_px, r.union_px, r.coverage, r.status) == (100, 800, 1.0, "identity_ambiguous_containment") and r.mask_iou < .2
    rng = random.Random(1)
    px = {}
    rows = []
    for obj in "abc":
        for y in range(6):
            for _ in range(3):
                a = rng.randrange(150)
                b = a + rng.randrange(1, 90)
                rows.append(("c", 0, obj, y, a, b))
                px.setdefault(obj, set()).update((y, x) for x in range(a, b))
    norm = masks.normalise_runs(spark.createDataFrame(rows, df.schema))
    got = {(r.first_id, r.second_id): r.intersection_px for r in masks.intersections(norm).collect()}
    assert got == {(a, b): len(px[a] & px[b]) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))}
    assert masks.mask_union_area(norm).collect()[0].area_px == len(px["a"] | px["b"] | px["c"])


def test_edge_clusters(spark):
    quads = spark.createDataFrame([("q", [[0., 0.], [100., 0.], [100., 60.], [0., 60.]])], "quad_id string, corners array<array<double>>")
    segs = [(0, [5., 1.], [45., 1.]), (1, [40., 1.5], [90., 1.]), (2, [10., 9.], [30., 9.]), (3, [50., 30.], [60., 35.]), (4, [99., 5.], [99.5, 50.])]
    s = spark.createDataFrame([("q", *x) for x in segs], "quad_id string, line_id int, a array<double>, b array<double>")
    assoc = candidates.edge_associations(s, quads, ["quad_id"])
    assert {(r.line_id, r.edge) for r in assoc.collect()} == {(0, 0), (1, 0), (2, 0), (4, 1)}
    near = candidates.collinear_members(assoc, ["quad_id"])
    best = candidates.collinear_clusters(near, ["quad_id"])
    by_edge = {r.edge: r for r in best.collect()}
    assert by_edge[0].members == 2 and by_edge[0].seed == 0 and by_edge[0].covered == pytest.approx(85.0) and by_edge[1].seed == 4
    picked = candidates.selected_segments(near, best, ["quad_id"]).collect()
    assert {r.line_id for r in picked} == {0, 1, 4} and {r.line_id: r.weight for r in picked}[0] == pytest.approx(40 / 85)


def test_collinear_members_are_all_pairs_by_brute_force(spark):
    rng = random.Random(4)
    corners = [[10., 20.], [410., 50.], [400., 300.], [0., 280.]]
    segs = []
    for i in range(240):
        (px, py), (qx, qy) = corners[i % 4], corners[(i % 4 + 1) % 4]
        s, e, u, v = rng.random() * 1.2 - .1, rng.random() * 1.2 - .1, rng.uniform(-9, 9), rng.uniform(-9, 9)
        n = math.hypot(qx - px, qy - py)
        nx, ny = -(qy - py) / n, (qx - px) / n
        segs.append((i, [px + s * (qx - px) + u * nx, py + s * (qy - py) + u * ny], [px + e * (qx - px) + v * nx, py + e * (qy - py) + v * ny]))
    segs += [(500 + i, *segs[3][1:]) for i in range(5)] + [(600, [50., 50.], [50., 50.])]
    quads = spark.createDataFrame([("q", corners)], "quad_id string, corners array<array<double>>")
    lines = spark.createDataFrame([("q", *x) for x in segs], "quad_id string, line_id int, a array<double>, b array<double>")
    assoc = candidates.edge_associations(lines, quads, ["quad_id"])
    got = candidates.collinear_members(assoc, ["quad_id"]).collect()
    rows = assoc.collect()
    leader = {}
    for r in sorted(rows, key=lambda r: r.line_id):
        leader.setdefault((r.edge, tuple(r.a), tuple(r.b)), r.line_id)
    want = set()
    for s in rows:
        if leader[s.edge, tuple(s.a), tuple(s.b)] != s.line_id:
            continue
        ux, uy = (s.b[0] - s.a[0]) / s.length, (s.b[1] - s.a[1]) / s.length
        for m in rows:
            cosine = abs((m.b[0] - m.a[0]) * ux + (m.b[1] - m.a[1]) * uy) / m.length
            far = max(abs((y - s.a[1]) * ux - (x - s.a[0]) * uy) for x, y in (m.a, m.b))
            if m.edge == s.edge and math.degrees(math.acos(min(cosine, 1.))) <= 5 and far <= 2.5:
                want.add((s.edge, s.line_id, m.line_id))
    assert len(got) == len(want) > len(rows) and {(r.edge, r.seed, r.line_id) for r in got} == want


def test_strip_texture(spark):
    rows = [("s", r, c, 128 + 48 * math.cos(2 * math.pi * r / 8)) for r in range(96) for c in range(8)]
    px = spark.createDataFrame(rows, "strip_id string, row int, col int, v double")
    prof = profiles.row_profile(px, ["strip_id"])
    sig = profiles.detrend(prof, ["strip_id"])
    peak = profiles.spectral_peak(profiles.periodogram(sig, ["strip_id"], "row", F.col("samples")), ["strip_id"]).collect()[0]
    assert abs(peak.period - 8) < .15 and abs(96 / peak.period - 12) < .25 and peak.concentration > .9
    assert profiles.lag_correlation(sig, ["strip_id"], "row", F.lit(8)).collect()[0].lag_correlation > .99
    lateral = profiles.lateral_correlations(px, prof, ["strip_id"], F.lit(8)).collect()
    assert len(lateral) == 4 and min(r.correlation for r in lateral) > .99


def test_neutral_length(spark):
    template = spark.createDataFrame([(s, a, float(s) if a == 1 else 0.0) for s in range(5) for a in range(3)], "seq int, axis int, value double")
    basis = spark.createDataFrame([(s, a, i, .1 * s if a == 0 and i == 0 else 0.0) for s in range(5) for a in range(3) for i in range(10)], "seq int, axis int, i int, weight double")
    betas = spark.createDataFrame([("g", i, 5.0 if i == 0 else 1.0) for i in range(10)], "scale_group string, i int, beta double")
    r = scale.neutral_hand_length(template, basis, betas, ["scale_group"]).collect()[0]
    assert r.chain_length == pytest.approx(4 * math.hypot(1, .5)) and r.chord_length == pytest.approx(4 * math.hypot(1, .5))


def test_inventory_and_sinks(spark, tmp_path):
    for n in ("0001.jpg", "0002.jpg"):
        (tmp_path / n).write_bytes(n.encode())
    inv = lineage.file_inventory(spark, str(tmp_path), "*.jpg")
    refs = inv.select("path", F.when(F.col("path").endswith("2.jpg"), F.lit("0" * 64)).otherwise(F.col("sha256")).alias("declared_sha256"))
    assert [r.path[-8:] for r in lineage.unbound_references(refs, inv).collect()] == ["0002.jpg"]
    before = spark.createDataFrame(inv.collect(), inv.schema)
    (tmp_path / "0001.jpg").write_bytes(b"changed")
    assert lineage.changed_inputs(before, lineage.file_inventory(spark, str(tmp_path), "*.jpg")).count() == 1
    df = spark.createDataFrame([("c", 1), ("d", 2)], "clip_id string, frame int")
    sinks.write_facts(df, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 2
    with pytest.raises(Exception):
        sinks.write_facts(df, str(tmp_path / "facts"))


def test_every_sql_belongs_to_a_query():
    cat = full_catalog()
    assert set(cat.sql) <= set(cat.queries) and len(cat.queries) >= 90
