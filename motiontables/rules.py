"""The capture contract as data: one row per field, joined to document leaves.

Fixed values of the interchange format: field names, versions, limits and enumerations.
"""

from __future__ import annotations

from dataclasses import dataclass

VERSIONS = ("1.0", "1.1", "1.2", "1.3")
PROVENANCE_SOURCES = ("observed", "calibrated", "user_measured", "inferred", "unobservable")
SAMPLE_KINDS = ("detected_model_observation", "tracked_roi_model_observation", "interpolated",
                "endpoint_hold", "missing")
CONTACT_STATES = ("gripped", "free", "resting", "sliding")
COORDINATE_FRAMES = ("shared_camera", "per_hand_wrist_local")
COORDINATE_UNITS = ("ue_centimeters", "conditional_ue_units")
ANCHOR_METHODS = ("card_pnp", "hand_prior", "user_measured")
DISTORTION_SIZES = (4, 5, 8, 12, 14)
MAX_INT = 2147483647
QUATERNION_TOLERANCE = 1e-4

JOINTS = ("wrist", "index_1", "index_2", "index_3", "middle_1", "middle_2", "middle_3", "pinky_1", "pinky_2",
          "pinky_3", "ring_1", "ring_2", "ring_3", "thumb_1", "thumb_2", "thumb_3")
JOINT_PARENTS = (-1, 0, 1, 2, 0, 4, 5, 0, 7, 8, 0, 10, 11, 0, 13, 14)
LANDMARK_OF_JOINT = (0, 5, 6, 7, 9, 10, 11, 17, 18, 19, 13, 14, 15, 1, 2, 3)
FINGERS = ("index", "middle", "pinky", "ring", "thumb")


def bone_names(side: str) -> tuple[str, ...]:
    suffix = side[0]
    return (f"hand_{suffix}",) + tuple(f"{finger}_{i:02d}_{suffix}" for finger in FINGERS for i in (1, 2, 3))


@dataclass(frozen=True)
class Rule:
    """``kind``: string, number, integer, boolean, object, list, numbers, integers, strings, quaternion."""

    pattern: str
    kind: str
    since: str = "1.0"
    nullable_since: str | None = None
    low: float | None = None
    high: float | None = None
    positive: bool = False
    sizes: tuple[int, ...] | None = None
    enum: tuple[str, ...] | None = None
    fold: bool = False
    unique: bool = False


def _unit(pattern, **kw):
    return Rule(pattern, "number", low=0.0, high=1.0, **kw)


def _index(pattern, low=0, high=MAX_INT, **kw):
    return Rule(pattern, "integer", low=low, high=high, **kw)


HAND, FRAME = "$.hands[*]", "$.hands[*].frames[*]"
PACKET, POSE = "$.packets[*]", "$.packets[*].frames[*]"

CAPTURE_RULES = (
    Rule("$.format_version", "string", enum=VERSIONS),
    Rule("$.meta", "object"),
    *[Rule(f"$.meta.{k}", "string") for k in ("source_video", "processed_at", "pipeline_version")],
    Rule("$.meta.fps", "number", positive=True),
    _index("$.meta.frame_count", low=1),
    Rule("$.meta.resolution", "integers", low=1, high=MAX_INT, sizes=(2,)),
    Rule("$.camera", "object"),
    Rule("$.camera.intrinsics", "object", nullable_since="1.2"),
    *[Rule(f"$.camera.intrinsics.{k}", "number", positive=True) for k in ("fx", "fy")],
    *[Rule(f"$.camera.intrinsics.{k}", "number") for k in ("cx", "cy")],
    Rule("$.camera.distortion", "numbers", nullable_since="1.2", sizes=DISTORTION_SIZES),
    Rule("$.camera.calibrated", "boolean"),
    Rule("$.scale", "object"),
    Rule("$.scale.meters_per_unit", "number", nullable_since="1.2", positive=True),
    Rule("$.scale.anchor_method", "string", nullable_since="1.2", enum=ANCHOR_METHODS, fold=True),
    _unit("$.scale.confidence", nullable_since="1.2"),
    Rule("$.scale.anchor_frames", "integers", low=0, high=MAX_INT, unique=True),
    Rule("$.provenance", "object", since="1.2"),
    *[Rule(f"$.provenance.{k}", "string", since="1.2", enum=PROVENANCE_SOURCES)
      for k in ("camera_intrinsics", "camera_distortion", "metric_scale", "hand_geometry")],
    Rule("$.provenance.coordinate_units", "string", since="1.2"),
    Rule("$.provenance.assumptions", "strings", since="1.2"),
    Rule("$.provenance.coordinate_frame", "string", since="1.3", enum=COORDINATE_FRAMES),
    Rule("$.validity", "object", since="1.2"),
    *[Rule(f"$.validity.{k}", "boolean", since="1.2") for k in ("camera_intrinsics", "camera_distortion", "metric_scale")],
    Rule("$.validity.inter_hand_transform", "boolean", since="1.3"),
    Rule("$.hands", "list", low=1, high=2),
    Rule(HAND, "object"),
    Rule(f"{HAND}.side", "string", enum=("left", "right"), fold=True),
    Rule(f"{HAND}.mano_shape", "numbers", sizes=(10,)),
    Rule(f"{HAND}.frames", "list"),
    Rule(FRAME, "object"),
    _index(f"{FRAME}.frame"),
    _unit(f"{FRAME}.confidence"),
    Rule(f"{FRAME}.global_trans_cm", "numbers", nullable_since="1.3", sizes=(3,)),
    Rule(f"{FRAME}.global_rot_quat", "quaternion"),
    Rule(f"{FRAME}.joint_positions_cm", "list", sizes=(21,)),
    Rule(f"{FRAME}.joint_positions_cm[*]", "numbers", sizes=(3,)),
    Rule(f"{FRAME}.bone_rotations", "object"),
    Rule(f"{FRAME}.bone_rotations.*", "quaternion"),
    Rule(f"{FRAME}.occluded_joints", "integers", low=0, high=20, unique=True),
    Rule(f"{FRAME}.sample_kind", "string", since="1.2", enum=SAMPLE_KINDS),
    Rule(f"{FRAME}.validity", "object", since="1.2"),
    Rule(f"{FRAME}.validity.pose", "boolean", since="1.2"),
    Rule(f"{FRAME}.validity.global_translation", "boolean", since="1.3"),
    Rule("$.packets", "list"),
    Rule(PACKET, "object"),
    Rule(f"{PACKET}.id", "string"),
    _index(f"{PACKET}.birth_frame"),
    _index(f"{PACKET}.death_frame"),
    _index(f"{PACKET}.card_count_estimate", low=1, nullable_since="1.1"),
    _unit(f"{PACKET}.card_count_confidence", nullable_since="1.1"),
    Rule(f"{PACKET}.dimensions_cm", "list", nullable_since="1.2", sizes=(3,), positive=True),
    Rule(f"{PACKET}.dimensions_cm[*]", "number", nullable_since="1.1", positive=True),
    Rule(f"{PACKET}.frames", "list"),
    Rule(POSE, "object"),
    _index(f"{POSE}.frame"),
    _unit(f"{POSE}.confidence"),
    Rule(f"{POSE}.position_cm", "numbers", sizes=(3,)),
    Rule(f"{POSE}.rotation_quat", "quaternion"),
    *[Rule(f"{POSE}.{k}", "numbers", nullable_since="1.1", sizes=(3,))
      for k in ("linear_velocity_cm_s", "angular_velocity_rad_s")],
    Rule(f"{POSE}.contact_state", "string"),
    Rule(f"{POSE}.contact_bones", "strings", nullable_since="1.1", unique=True),
    Rule(f"{POSE}.reprojection_error_px", "number", nullable_since="1.1", low=0.0),
    Rule("$.events", "object"),
    *[Rule(f"$.events.{k}", "list") for k in ("splits", "merges", "releases")],
    *[_index(f"$.events.{k}[*].frame") for k in ("splits", "merges", "releases")],
    Rule("$.events.splits[*].source", "string"),
    Rule("$.events.splits[*].results", "strings", low=2, unique=True),
    Rule("$.events.merges[*].sources", "strings", low=2, unique=True),
    Rule("$.events.merges[*].result", "string"),
    Rule("$.events.releases[*].packet", "string"),
    Rule("$.events.releases[*].release_velocity_cm_s", "numbers", nullable_since="1.2", sizes=(3,)),
    Rule("$.quality", "object"),
    _unit("$.quality.mean_hand_confidence"),
    Rule("$.quality.warnings", "strings"),
    # Null in every version; a value is checked.
    Rule("$.quality.mean_reprojection_error_px", "number", nullable_since="1.0", low=0.0),
    Rule("$.quality.low_confidence_ranges", "list"),
    Rule("$.quality.low_confidence_ranges[*]", "integers", low=0, high=MAX_INT, sizes=(2,)),
)
