"""Contract by mutation: one valid document, one changed field, the expected path."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from motiontables.operators import contract
from motiontables.rules import bone_names
from motiontables.sources import captures as docs

Q = [0.0, 0.0, 0.0, 1.0]


def base():
    frame = {"frame": 0, "confidence": .8, "global_trans_cm": [1, 2, 3], "global_rot_quat": Q,
             "joint_positions_cm": [[0.0, 0.0, 0.0]] * 21, "bone_rotations": {b: Q for b in bone_names("left")[1:]}, "occluded_joints": [3]}
    return {"format_version": "1.0",
            "meta": {"source_video": "v", "fps": 24, "frame_count": 3, "resolution": [800, 600], "processed_at": "t", "pipeline_version": "p"},
            "camera": {"intrinsics": {"fx": 710, "fy": 705, "cx": 401, "cy": 299}, "distortion": [0, 0, 0, 0, 0], "calibrated": False},
            "scale": {"meters_per_unit": 1, "anchor_method": "card_pnp", "confidence": .5, "anchor_frames": [0]},
            "hands": [{"side": "left", "mano_shape": [0] * 10, "frames": [frame]}],
            "packets": [{"id": "P1", "birth_frame": 0, "death_frame": 2, "card_count_estimate": 1, "card_count_confidence": .5,
                         "dimensions_cm": [6.35, 8.89, .03], "frames": [{
                             "frame": 1, "confidence": .5, "position_cm": [0, 0, 1], "rotation_quat": Q, "linear_velocity_cm_s": [0, 0, 0],
                             "angular_velocity_rad_s": [0, 0, 0], "contact_state": "Free", "contact_bones": ["Index_01_L"], "reprojection_error_px": 1}]},
                        {"id": "p2", "birth_frame": 0, "death_frame": 2, "card_count_estimate": 2, "card_count_confidence": .5, "dimensions_cm": [6, 9, 1], "frames": []},
                        {"id": "p3", "birth_frame": 0, "death_frame": 2, "card_count_estimate": 2, "card_count_confidence": .5, "dimensions_cm": [6, 9, 1], "frames": []}],
            "events": {"splits": [{"frame": 1, "source": "p1", "results": ["P2", "p3"]}], "merges": [], "releases": []},
            "quality": {"mean_hand_confidence": .5, "low_confidence_ranges": [[0, 1]], "mean_reprojection_error_px": None, "warnings": []}}


def v12():
    d = base()
    d["format_version"] = "1.2"
    d["camera"]["distortion"] = None
    d["scale"] = {"meters_per_unit": None, "anchor_method": None, "confidence": None, "anchor_frames": []}
    d["provenance"] = {"camera_intrinsics": "inferred", "camera_distortion": "unobservable", "metric_scale": "unobservable",
                       "hand_geometry": "inferred", "coordinate_units": "conditional_ue_units", "assumptions": ["a"]}
    d["validity"] = {"camera_intrinsics": True, "camera_distortion": False, "metric_scale": False}
    d["hands"][0]["frames"][0].update(sample_kind="interpolated", validity={"pose": True})
    return d


def v13():
    d = v12()
    d["format_version"] = "1.3"
    d["camera"]["intrinsics"] = None
    d["provenance"].update(camera_intrinsics="unobservable", coordinate_frame="per_hand_wrist_local")
    d["validity"].update(camera_intrinsics=False, inter_hand_transform=False)
    d["hands"][0]["frames"][0].update(global_trans_cm=None, validity={"pose": True, "global_translation": False})
    d["packets"], d["events"]["splits"] = [], []
    return d


def put(document, path, value):
    d = copy.deepcopy(document)
    *parents, last = path
    node = d
    for p in parents:
        node = node[p]
    if value is KeyError:
        del node[last]
    else:
        node[last] = value
    return d


H, P = ("hands", 0, "frames", 0), ("packets", 0, "frames", 0)
HP, PP = "$.hands[0].frames[0]", "$.packets[0].frames[0]"
CASES = [
    ("ok10", base(), None), ("ok12", v12(), None), ("ok13", v13(), None),
    ("null_count_10", put(put(base(), ("packets", 0, "card_count_estimate"), None), ("packets", 0, "card_count_confidence"), None), "$.packets[0].card_count_estimate"),
    ("null_count_11", put(put(put(base(), ("packets", 0, "card_count_estimate"), None), ("packets", 0, "card_count_confidence"), None), ("format_version",), "1.1"), None),
    ("null_thick_10", put(base(), ("packets", 0, "dimensions_cm", 2), None), "$.packets[0].dimensions_cm[2]"),
    ("null_thick_11", put(put(base(), ("packets", 0, "dimensions_cm", 2), None), ("format_version",), "1.1"), None),
    ("null_width_11", put(put(base(), ("packets", 0, "dimensions_cm", 0), None), ("format_version",), "1.1"), "$.packets[0].dimensions_cm[0]"),
    ("null_width_12", put(v12(), ("packets", 0, "dimensions_cm", 0), None), None),
    ("bool_number", put(base(), ("meta", "fps"), True), "$.meta.fps"),
    ("text_number", put(base(), ("meta", "fps"), "30"), "$.meta.fps"),
    ("fractional", put(base(), ("meta", "frame_count"), 2.5), "$.meta.frame_count"),
    ("integral_float", put(base(), ("meta", "frame_count"), 3.0), None),
    ("missing", put(base(), ("quality", "mean_reprojection_error_px"), KeyError), "$.quality.mean_reprojection_error_px"),
    ("empty_text", put(base(), ("meta", "source_video"), ""), "$.meta.source_video"),
    ("version", put(base(), ("format_version",), "2.0"), "$.format_version"),
    ("quaternion", put(base(), (*H, "global_rot_quat"), [0, 0, 0, 1.1]), f"{HP}.global_rot_quat"),
    ("joints", put(base(), (*H, "joint_positions_cm"), [[0, 0, 0]] * 20), f"{HP}.joint_positions_cm"),
    ("bones", put(base(), (*H, "bone_rotations", "hand_l"), Q), f"{HP}.bone_rotations"),
    ("occluded", put(base(), (*H, "occluded_joints"), [1, 1]), f"{HP}.occluded_joints"),
    ("frame_range", put(base(), (*H, "frame"), 3), f"{HP}.frame"),
    ("unknown_10", put(base(), (*P, "contact_state"), "UNKNOWN"), f"{PP}.contact_state"),
    ("contact_bone", put(base(), (*P, "contact_bones"), ["elbow"]), f"{PP}.contact_bones"),
    ("packet_frame", put(base(), ("packets", 0, "birth_frame"), 2), f"{PP}.frame"),
    ("event_unknown", put(base(), ("events", "splits", 0, "results"), ["p2", "p9"]), "$.events.splits[0]"),
    ("event_self", put(base(), ("events", "splits", 0, "results"), ["p1", "p2"]), "$.events.splits[0]"),
    ("event_single", put(base(), ("events", "splits", 0, "results"), ["p2"]), "$.events.splits[0]"),
    ("packet_twice", put(base(), ("packets", 1, "id"), "P1"), "$.packets[*].id"),
    ("ranges", put(base(), ("quality", "low_confidence_ranges"), [[0, 1], [1, 1]]), "$.quality.low_confidence_ranges[1]"),
    ("mask", put(v12(), ("validity", "metric_scale"), True), "$.validity.metric_scale"),
    ("units", put(v12(), ("provenance", "coordinate_units"), "ue_centimeters"), "$.provenance.coordinate_units"),
    ("assumptions", put(v12(), ("provenance", "assumptions"), []), "$.provenance.assumptions"),
    ("calibrated", put(v12(), ("camera", "calibrated"), True), "$.camera.calibrated"),
    ("pose", put(v12(), (*H, "sample_kind"), "missing"), f"{HP}.validity.pose"),
    ("kind_missing", put(v12(), (*H, "sample_kind"), KeyError), f"{HP}.sample_kind"),
    ("local_translation", put(v13(), (*H, "global_trans_cm"), [0, 0, 0]), f"{HP}.global_trans_cm"),
    ("local_wrist", put(v13(), (*H, "joint_positions_cm"), [[0, 0, 1e-3]] + [[0, 0, 0]] * 20), f"{HP}.joint_positions_cm[0]"),
    ("local_camera", put(v13(), ("camera", "intrinsics"), {"fx": 1, "fy": 1, "cx": 0, "cy": 0}), "$.camera"),
    ("local_packets", put(v13(), ("packets",), base()["packets"]), "$.packets"),
    ("inter_hand", put(v13(), ("validity", "inter_hand_transform"), True), "$.validity.inter_hand_transform"),
]
RAW = [("nan", json.dumps(base()).replace('"fps": 24', '"fps": NaN')), ("twice", '{"a": 1, "A": 2}'), ("broken", '{"a": ')]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(n, json.dumps(d)) for n, d, _ in CASES] + RAW
    v = contract.validate(spark.createDataFrame(rows, "doc_id string, text string"))
    out = {}
    for r in v.collect():
        out.setdefault(r.doc_id, set()).add(r.path)
    return out


@pytest.mark.parametrize("name,path", [(n, p) for n, _, p in CASES])
def test_mutations(found, name, path):
    if path is None:
        assert found.get(name, set()) == set()
    else:
        assert path in found.get(name, set())


@pytest.mark.parametrize("name", [n for n, _ in RAW])
def test_unreadable_documents(found, name):
    assert "$" in found[name]


def test_keys_are_folded_and_facts_survive(spark):
    text = "﻿" + json.dumps(base()).replace('"hands"', '"Hands"')
    d = spark.createDataFrame([("x", text.lstrip("﻿"))], "doc_id string, text string")
    caps = docs.typed(d)
    assert docs.hand_samples(caps).count() == 1 and docs.packet_frames(caps).count() == 1 and docs.events(caps).count() == 1
    s = contract.contract_summary(caps).collect()[0]
    assert (s.hands, s.hand_samples, s.packets, s.packet_samples, s.splits) == (1, 1, 3, 1, 1)
    assert contract.retarget_issues(caps).count() == 1


def test_files_and_upgrade(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(base()).encode())
    d = docs.read_documents(spark, str(tmp_path))
    up = docs.upgrade_version(d)
    assert json.loads(up.collect()[0].text)["format_version"] == "1.1"
    assert docs.preserved(d, up).count() == 0
    changed = up.withColumn("text", F.regexp_replace("text", '"fps": 24', '"fps": 24.0'))
    assert [r.path for r in docs.preserved(d, changed).collect()] == ["$.meta.fps"]


def test_default_mapping_is_valid(spark):
    m = contract.bone_mapping(spark)
    assert m.count() == 32 and contract.mapping_violations(m).count() == 0
    bad = m.withColumn("bone_name", F.when(F.col("joint") == 3, "HAND_L").otherwise(F.col("bone_name")))
    assert contract.mapping_violations(bad).count() == 3


def test_estimates_prompts_and_seeds(spark):
    pts = [[0.1, 0.2, 0.3]] * 21
    s = ("side string, handedness_confidence double, image_landmarks array<array<double>>, world_landmarks_m array<array<double>>, "
         "world_coordinate_system string, joint_confidences array<double>, global_orient array<double>, hand_pose array<double>, shape array<double>")
    rows = [("left", .5, pts, pts, "w", None, None, None, [0.0] * 10), ("top", 1.5, pts[:20], pts, "", [2.0] * 21, None, None, [0.0] * 9),
            ("right", float("nan"), pts, pts, "w", None, None, None, None)]
    got = [r.i for r in spark.createDataFrame(rows, s).select(contract.estimate_issues().alias("i")).collect()]
    assert got[0] == [] and len(got[1]) == 6 and got[2] == ["confidence must be in [0, 1]"]
    prompts = spark.createDataFrame([
        ("c", 0, "a", [[1.0, 1.0]], [1], None, "k", "d", False), ("c", 0, "b", [[700.0, 1.0]], [2], [5.0, 5.0, 1.0, 9.0], "k", "d", True),
        ("c", 9, "z", None, None, None, None, "d", None)],
        "clip_id string, frame int, object_id string, points array<array<double>>, labels array<int>, box array<double>, provenance_kind string, description string, is_ground_truth boolean")
    objects = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "n n")], "clip_id string, object_id string")
    sources = spark.createDataFrame([("c", 640, 480, 3)], "clip_id string, width int, height int, frame_count int")
    got = {(r.object_id, r.message) for r in contract.prompt_violations(prompts, objects, sources).collect()}
    assert got == {("b", "point outside image"), ("b", "label must be 0 or 1"), ("b", "invalid box"), ("b", "ground-truth flag must be false"),
                   ("z", "frame outside timeline"), ("z", "prompt needs points or a box"), ("z", "provenance required"),
                   ("z", "ground-truth flag must be false"), ("z", "unknown object"), ("n n", "object has no prompt"), ("n n", "unsafe object id")}
    seeds = spark.createDataFrame([("c", "a", 0, 10, 10, "0" * 64, "k", "s"), ("c", "b", 1, 10, 9, "zz", "k", None)],
                                  "clip_id string, object_id string, frame int, area_px int, recorded_area_px int, mask_sha256 string, provenance_kind string, selection_provenance string")
    got = {(r.object_id, r.message) for r in contract.seed_violations(seeds).collect()}
    assert got == {("a", "seeds must share one reference frame"), ("b", "seeds must share one reference frame"), ("b", "recorded area differs"),
                   ("b", "invalid mask hash"), ("b", "provenance required")}


@pytest.mark.parametrize("text", ['{"a": 1} x', '{"a": 1}{"b": 2}', '{"a": 1}}', '{"a": 1}, "b": 2', "[1]", "", "null", '{"a": 1e999}', '{"a": {"B": 1, "b": 2}}',
                                  '{"a": ' + "[" * 14 + '"x", 1' + "]" * 14 + "}"])
def test_only_one_strict_object_is_a_document(spark, text):
    d = spark.createDataFrame([("x", text)], "doc_id string, text string")
    assert [(r.path, r.kind) for r in docs.leaves(d).collect()] == [("$", "invalid")] and docs.typed(d).count() == 0


def test_leaves_keep_kinds(spark):
    d = spark.createDataFrame([("x", '{"Format_Version": "1.2", "n": 1.0, "l": [1, 2.5], "s": ["a", "b"], "m": [1, "a", null], "t": true}')], "doc_id string, text string")
    got = {r.path: (r.version, r.kind, r.number, r.is_integral, r.size) for r in docs.leaves(d).collect()}
    assert got["$.n"] == ("1.2", "number", 1.0, True, None) and got["$.l"] == ("1.2", "numbers", None, False, 2)
    assert got["$.s"][1] == "strings" and got["$.m"][1] == "list" and got["$.m[2]"][1] == "null" and got["$.t"][1] == "boolean"


def test_bounds_of_events_and_ranges(found_bounds):
    assert found_bounds["late_event"] == {("$.events.splits[0]", "event outside the timeline")}
    assert found_bounds["late_range"] == {("$.quality.low_confidence_ranges[0]", "range beyond the last frame")}


@pytest.fixture(scope="module")
def found_bounds(spark):
    rows = [("late_event", put(base(), ("events", "splits", 0, "frame"), 3)), ("late_range", put(base(), ("quality", "low_confidence_ranges"), [[1, 3]]))]
    v = contract.validate(spark.createDataFrame([(n, json.dumps(d)) for n, d in rows], "doc_id string, text string"))
    out = {}
    for r in v.collect():
        out.setdefault(r.doc_id, set()).add((r.path, r.message))
    return out
