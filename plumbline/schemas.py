"""Schemas of the scene tables and documents."""

from __future__ import annotations

POINTS = (
    "room string, frame_idx int, v int, u int, x float, y float, z float, conf boolean, r smallint, g smallint, b smallint"
)
CAMERAS = "room string, frame_idx int, frame_id int, pose array<double>, K array<double>, h int, w int"
CLOUD = "x float, y float, z float, r smallint, g smallint, b smallint"
DETECTIONS = (
    "room string, frame_idx int, det_id int, label string, box_2d array<int>, confidence double, mask_b64 string"
)
OBB = "struct<center:array<double>, extent:array<double>, R:array<array<double>>>"

OBSERVATION_DOC = (
    "room string, image_hw array<int>, frames_labeled array<int>, observations array<struct<id:bigint, "
    "object_id:string, frame_idx:int, label:string, vlm_confidence:double, centroid:array<double>, "
    f"obb:{OBB}, n_points:int, support:double, box_px:array<int>>>, _corrupt string"
)
OBJECT_DOC = (
    "room string, units string, scale_verified boolean, n_frames_labeled int, objects array<struct<id:string, "
    f"label:string, aliases:array<string>, centroid:array<double>, obb:{OBB}, confidence:double, "
    "n_observations:bigint, seen_in:array<int>, observation_ids:array<bigint>>>, _corrupt string"
)
LEVEL_DOC = (
    "convention string, applied array<array<double>>, cumulative array<array<double>>, rotation_deg double, "
    "estimate struct<up:array<double>, floor_offset:double, confidence:double, source:string, pose_tilt_deg:double, "
    "floor_inlier_frac:double, agreement_deg:double, notes:array<string>>, _corrupt string"
)
