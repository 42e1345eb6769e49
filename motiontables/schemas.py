"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

VEC = "array<double>"
VECS = "array<array<double>>"

# One capture document. Everything is nullable; rules live in a table (see rules.py).
CAPTURE = f"""
format_version string,
meta struct<source_video string, fps double, frame_count int, resolution array<int>, processed_at string,
            pipeline_version string>,
camera struct<intrinsics struct<fx double, fy double, cx double, cy double>, distortion {VEC}, calibrated boolean>,
scale struct<meters_per_unit double, anchor_method string, confidence double, anchor_frames array<int>>,
provenance struct<camera_intrinsics string, camera_distortion string, metric_scale string, hand_geometry string,
                  coordinate_units string, coordinate_frame string, assumptions array<string>>,
validity struct<camera_intrinsics boolean, camera_distortion boolean, metric_scale boolean,
                inter_hand_transform boolean>,
hands array<struct<side string, mano_shape {VEC}, frames array<struct<
   frame int, confidence double, global_trans_cm {VEC}, global_rot_quat {VEC}, joint_positions_cm {VECS},
   bone_rotations map<string, {VEC}>, occluded_joints array<int>, sample_kind string,
   validity struct<pose boolean, global_translation boolean>>>>>,
packets array<struct<id string, birth_frame int, death_frame int, card_count_estimate int,
   card_count_confidence double, dimensions_cm {VEC}, frames array<struct<
   frame int, confidence double, position_cm {VEC}, rotation_quat {VEC}, linear_velocity_cm_s {VEC},
   angular_velocity_rad_s {VEC}, contact_state string, contact_bones array<string>,
   reprojection_error_px double>>>>,
events struct<splits array<struct<frame int, source string, results array<string>>>,
              merges array<struct<frame int, sources array<string>, result string>>,
              releases array<struct<frame int, packet string, release_velocity_cm_s {VEC}>>>,
quality struct<mean_hand_confidence double, low_confidence_ranges array<array<int>>,
               mean_reprojection_error_px double, warnings array<string>>
"""

HAND = f"""struct<side string, handedness_confidence double, image_landmarks {VECS}, image_landmarks_px {VECS},
world_landmarks_m {VECS}, outside_image_joints array<int>, joint_confidences {VEC},
mano struct<global_orient_axis_angle {VEC}, hand_pose_axis_angle {VEC}, shape {VEC}>,
diagnostics struct<ambiguous boolean, corrected boolean, reacquired boolean, box_xyxy_px {VEC},
  box_size_px double, crop_focal_length_px double, crop_image_size_px double,
  crop_weak_perspective_camera {VEC}, crop_camera_translation_m {VEC}>>"""

# Append-only frame log, one row per timeline frame.
FRAME_LOG = f"""clip_id string, frame int, timestamp_ms bigint, time_seconds double,
views map<string, struct<available boolean, source_frame int, blur_flag boolean, blur_variance_256 double,
hands array<{HAND}>>>"""

DETECTION = f"""clip_id string, view_id string, timestamp_ms bigint, det_idx int, side string, score double,
landmarks {VECS}"""

MASK_RUN = "clip_id string, frame int, object_id string, y int, x0 int, x1 int"
MEMBERSHIP = "clip_id string, frame int, groups array<array<string>>, supported boolean, kind string, description string"
JOB_EVENT = "job_id string, event string, stage string, pid int, returncode int, alive boolean, elapsed_seconds double"
METADATA_RECORD = """record_index int, key string, value string, encoding string, atom_path string,
atom_offset bigint, raw_value_sha256 string"""
VIEW_MANIFEST = "clip_id string, primary_view string, views array<struct<id string, video string, offset_seconds double, calibration string>>"
