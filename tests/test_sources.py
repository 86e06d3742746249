import io
import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import fusion, rooms
from plumbline.sources import clouds, detector, documents, folders


@pytest.fixture(scope="module")
def scene(spark):
    clouds.register(spark)
    return spark


def cloud_frame(n):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(n, 3)).astype("float32"), columns=["x", "y", "z"])
    for c in "rgb":
        pdf[c] = rng.integers(0, 256, n).astype("int16")
    return pdf


def test_ply_round_trip(scene, tmp_path):
    pdf = cloud_frame(2500)
    path = str(tmp_path / "scene")
    scene.createDataFrame(pdf).repartition(3).write.format("ply").mode("append").save(path)
    back = scene.read.format("ply").option("rowsPerPartition", 300).load(path)
    assert back.rdd.getNumPartitions() >= 9
    key = ["x", "y", "z"]
    got = back.toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, pdf.sort_values(key).reset_index(drop=True), check_dtype=False)
    counts = clouds.ply_counts(scene, path)
    assert counts.agg(F.sum("n_points")).first()[0] == 2500 and not list((tmp_path / "scene").glob("*.pending"))


def test_ply_of_fixed_layout(scene, tmp_path):
    path = tmp_path / "one.ply"
    path.write_bytes(clouds.ply_header(2) + struct.pack("<fffBBB", 1, 2, 3, 4, 5, 6) + struct.pack("<fffBBB", 7, 8, 9, 255, 0, 1))
    assert [tuple(r) for r in scene.read.format("ply").load(str(path)).collect()] == [(1, 2, 3, 4, 5, 6), (7, 8, 9, 255, 0, 1)]
    for broken in (b"not a ply", b"ply\nformat ascii 1.0\nend_header\n", b"ply\nelement vertex 3\nproperty float x\nend_header\n"):
        with pytest.raises(ValueError):
            clouds.read_ply_header(io.BytesIO(broken))
    # Properties in another order and number, and a header of many comments.
    layout = [("x", "float", "f"), ("nx", "double", "d"), ("red", "uchar", "B"), ("y", "float", "f"), ("green", "uchar", "B"),
              ("z", "float", "f"), ("blue", "uchar", "B")]
    lines = ["ply", "format binary_little_endian 1.0", *["comment " + "c" * 60] * 90, "element vertex 2"]
    lines += [f"property {kind} {name}" for name, kind, _ in layout] + ["element face 0", "property list uchar int vertex_indices", "end_header", ""]
    form = "<" + "".join(f for _, _, f in layout)
    path.write_bytes("\n".join(lines).encode() + struct.pack(form, 1, 0, 4, 2, 5, 3, 6) + struct.pack(form, 7, 0, 1, 8, 2, 9, 3))
    assert [tuple(r) for r in scene.read.format("ply").load(str(path)).collect()] == [(1, 2, 3, 4, 5, 6), (7, 8, 9, 1, 2, 3)]
    assert clouds.ply_counts(scene, str(path)).first()["n_points"] == 2
    path.write_bytes(clouds.ply_header(5) + b"short")
    with pytest.raises(Exception, match="shorter"):
        scene.read.format("ply").load(str(path)).collect()


def test_frame_archive(scene, tmp_path):
    rng = np.random.default_rng(1)
    n, h, w = 3, 4, 5
    data = {
        "images": rng.integers(0, 256, (n, h, w, 3)).astype(np.uint8), "pts3d": rng.normal(size=(n, h, w, 3)).astype(np.float32),
        "conf_mask": rng.random((n, h, w)) < 0.5, "poses": np.tile(np.eye(4, dtype=np.float32), (n, 1, 1)),
        "intrinsics": np.tile(np.eye(3, dtype=np.float32), (n, 1, 1)), "frame_ids": np.array([0, 2, 5], np.int32),
    }
    (tmp_path / "den").mkdir()
    np.savez_compressed(tmp_path / "den" / "frames.npz", **data)
    pts = scene.read.format("framearchive").load(str(tmp_path)).toPandas()
    assert len(pts) == n * h * w and set(pts["room"]) == {"den"}
    row = pts[(pts.frame_idx == 2) & (pts.v == 3) & (pts.u == 1)].iloc[0]
    assert np.allclose([row.x, row.y, row.z], data["pts3d"][2, 3, 1]) and [row.r, row.g, row.b] == data["images"][2, 3, 1].tolist()
    assert bool(row.conf) == bool(data["conf_mask"][2, 3, 1])
    cams = scene.read.format("framearchive").option("table", "cameras").load(str(tmp_path)).orderBy("frame_idx").collect()
    assert [c["frame_id"] for c in cams] == [0, 2, 5] and cams[0]["pose"] == np.eye(4).ravel().tolist() and cams[0]["h"] == h
    seen = scene.createDataFrame([("den", 2, "chair")], "room string, frame_idx int, label string")
    linked = rooms.through_frame_ids(seen, scene.createDataFrame(cams, "room string, frame_idx int, frame_id int, pose array<double>, K array<double>, h int, w int"))
    assert linked.first()["frame_id"] == 5
    data["poses"] = data["poses"][:2]
    (tmp_path / "bad").mkdir()
    np.savez(tmp_path / "bad" / "frames.npz", **data)
    with pytest.raises(Exception, match="expected shape"):
        scene.read.format("framearchive").load(str(tmp_path / "bad")).collect()


def test_trajectory_files(spark, tmp_path):
    (tmp_path / "den").mkdir()
    path = tmp_path / "den" / "trajectory.txt"
    path.write_text("\n0 1 2 3 0 0 0 1\nbroken line\n1 2 2 3 0 0 1 0\n2 9 9 9\n")
    got = documents.read_trajectories(spark, str(path)).orderBy("index").collect()
    assert [(r["room"], r["index"]) for r in got] == [("den", 0), ("den", 2)] and got[1]["position"] == [2, 2, 3]
    assert documents.read_trajectories(spark, str(path), min_fields=4).count() == 3
    poses = documents.trajectory_poses(documents.read_trajectories(spark, str(path)))
    out = str(tmp_path / "out")
    documents.write_trajectories(poses, out)
    rows = documents.read_trajectories(spark, out + "/*/trajectory.txt").orderBy("t").collect()
    assert [(r["room"], r["index"], r["position"]) for r in rows] == [("den", 0, [1, 2, 3]), ("den", 1, [2, 2, 3])]
    assert np.allclose(rows[1]["quaternion"], [0, 0, 1, 0])


def test_trajectory_index_survives_file_splits(spark, tmp_path):
    n = 3_000
    pose = "array(1D, 0D, 0D, id * 0.25D, 0D, 1D, 0D, -id * 0.5D, 0D, 0D, 1D, 0D, 0D, 0D, 0D, 1D)"
    cams = spark.range(2 * n).selectExpr("concat('room ', id % 2) AS room", "cast(id div 2 AS int) AS frame_idx", f"{pose} AS pose")
    out = str(tmp_path / "out")
    settings = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        documents.write_trajectories(cams.repartition(7), out)
        got = documents.read_trajectories(spark, out + "/*/trajectory.txt").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"room 0", "room 1"}
    assert all([f.name for f in p.iterdir()] == ["trajectory.txt"] for p in (tmp_path / "out").iterdir())
    assert sorted((r["room"], r["index"]) for r in got) == [(f"room {k}", i) for k in (0, 1) for i in range(n)]
    assert all(r["index"] == r["t"] and r["position"][0] == (2 * r["index"] + int(r["room"][-1])) * 0.25 for r in got)


def test_room_files_are_replaced_on_commit_only(spark, tmp_path):
    from plumbline.sources.roomfiles import write_room_files

    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "room string, value string")
    write_room_files(rows, str(tmp_path), "t.txt", ["value"])
    bad = spark.createDataFrame([("a", "9"), ("x/y", "9")], "room string, value string").coalesce(1)
    with pytest.raises(Exception, match="not a folder name"):
        write_room_files(bad, str(tmp_path), "t.txt", ["value"])
    assert {p.name: [f.read_text() for f in p.iterdir()] for p in tmp_path.iterdir()} == {"a": ["1\n"], "b": ["2\n"]}
    write_room_files(rows.where("room = 'a'").selectExpr("room", "'3' AS value"), str(tmp_path), "t.txt", ["value"])
    assert (tmp_path / "a" / "t.txt").read_text() == "3\n" and (tmp_path / "b" / "t.txt").read_text() == "2\n"


def test_rejected_documents(spark, tmp_path):
    write_observations(tmp_path / "den")
    broken = {"cut": '{"room": "x", "observations": [{', "none": " \n", "other": '{"rooms": 3}', "list": "[1, 2]", "typed": '{"observations": [{"frame_idx": "first"}]}'}
    for name, body in broken.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "observations.json").write_text(body)
    paths = str(tmp_path / "*" / "observations.json")
    bad = {r["room"]: r for r in documents.rejected(spark, paths, "observations").collect()}
    assert set(bad) == set(broken) and bad["none"]["reason"] == "empty file" and bad["other"]["reason"] == "no observations"
    assert {bad[k]["reason"] for k in ("cut", "list", "typed")} <= {"not a document of this kind", "no observations"}
    assert all(bad[k]["n_bytes"] == len(body) for k, body in broken.items())
    assert {r["room"] for r in documents.read_observations(spark, paths).collect()} == {"den"}
    head, = documents.read_observation_headers(spark, paths).collect()
    assert head["room"] == "den" and head["frames_labeled"] == [0, 1, 2, 3] and head["image_hw"] == [512, 384]


def test_level_documents_come_back(spark, tmp_path):
    from plumbline.operators import level

    points = spark.range(400).selectExpr("'den' AS room", "cast(id % 20 AS double) AS x", "cast(id div 20 AS double) AS y", "cast(id % 7 AS double) AS z")
    estimates = level.forced_up(points, "-z")
    records = level.level_records(estimates, level.levelling_transforms(estimates, points))
    documents.write_documents(documents.level_documents(records), str(tmp_path), "level.json")
    back = documents.read_level_records(spark, str(tmp_path / "*" / "level.json")).first().asDict(recursive=True)
    want = records.first().asDict(recursive=True)
    assert back["room"] == "den" and back["applied"] == want["applied"] and back["cumulative"] == want["cumulative"]
    assert back["estimate"] == want["estimate"] and back["rotation_deg"] == want["rotation_deg"]


def box(at, extent=0.4):
    return {"center": at, "extent": [extent] * 3, "R": np.eye(3).tolist()}


def write_observations(folder):
    folder.mkdir(parents=True, exist_ok=True)
    spots = [("chair", [0, 0.5, 0]), ("chair", [0.05, 0.5, 0.02]), ("chair", [3, 0.5, 0]), ("lamp", [0, 1.5, 0])]
    items = [
        {"frame_idx": i, "label": n, "centroid": p, "obb": box(p), "box_px": [10, 20, 60, 80] if i else None}
        for i, (n, p) in enumerate(spots)
    ]
    doc = {"room": "den", "image_hw": [512, 384], "frames_labeled": [0, 1, 2, 3], "observations": items}
    (folder / "observations.json").write_text(json.dumps(doc))


def test_documents(spark, tmp_path):
    write_observations(tmp_path / "den")
    (tmp_path / "den" / "objects.json").write_text("{broken")
    seen = documents.read_observations(spark, str(tmp_path / "den" / "observations.json"))
    first = seen.orderBy("id").first()
    assert (first["vlm_confidence"], first["n_points"], first["support"], first["box_px"]) == (0.5, 0, 0.0, None)
    assert documents.read_objects(spark, str(tmp_path / "den" / "objects.json")).count() == 0
    objects, members = fusion.fuse(seen)
    assert [r["label"] for r in objects.orderBy("object_id").collect()] == ["chair", "chair", "lamp"]
    owned = rooms.with_owner(seen.drop("object_id"), members)
    assert owned.where("object_id is null").count() == 0
    heads = spark.createDataFrame([("den", False, 4), ("void", True, 0)], "room string, scale_verified boolean, n_frames_labeled int")
    docs = {r["room"]: json.loads(r["document"]) for r in documents.object_documents(fusion.with_lists(objects, members), heads).collect()}
    assert docs["void"]["objects"] == [] and docs["den"]["objects"][0]["observation_ids"] == [0, 1]
    heads = spark.createDataFrame([("den", [512, 384], [3, 0])], "room string, image_hw array<int>, frames_labeled array<int>")
    text = documents.observation_documents(owned, heads)
    back = json.loads(text.first()["document"])
    assert back["frames_labeled"] == [0, 3] and back["observations"][0]["box_px"] is None and len(back["observations"]) == 4
    documents.write_documents(text, str(tmp_path / "docs"), "observations.json")
    again = documents.read_observations(spark, str(tmp_path / "docs" / "den" / "observations.json"))
    assert again.count() == 4 and documents.read_observation_headers(spark, str(tmp_path / "docs" / "*" / "*.json")).first()["frames_labeled"] == [0, 3]


def test_room_listing(spark, tmp_path):
    write_observations(tmp_path / "out" / "den")
    (tmp_path / "out" / "den" / "scene.ply").write_bytes(clouds.ply_header(0))
    (tmp_path / "out" / "other").mkdir()
    (tmp_path / "out" / "other" / "readme.md").write_text("x")
    got = folders.discover_rooms(spark, str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["room"] == "den" and got[0]["has_scene_ply"] and not got[0]["has_frames_npz"]
    videos = tmp_path / "p" / "data" / "rooms"
    videos.mkdir(parents=True)
    (videos / "a.MP4").write_bytes(b"0" * 150_000)
    assert [(r["name"], r["mb"], r["path"]) for r in folders.list_videos(spark, str(tmp_path / "p")).collect()] == [("a.MP4", 0.2, "data/rooms/a.MP4")]
    assert rooms.room_name_ok("den") and not any(map(rooms.room_name_ok, ("", "a/b", "..", "a\\b")))


def test_reconstruction_frames_are_numbered_by_name(spark, tmp_path):
    for name in ("den/b.png", "den/a.jpg", "den/note.txt", "attic/1.png", "attic/0.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = folders.reconstruction_inputs(spark, str(tmp_path)).collect()
    assert sorted((r["room"], r["idx"], r["name"]) for r in got) == [("attic", 0, "0.png"), ("attic", 1, "1.png"), ("den", 0, "a.jpg"), ("den", 1, "b.png")]
    (tmp_path / "attic" / "0.png").unlink()
    with pytest.raises(ValueError, match="attic"):
        folders.reconstruction_inputs(spark, str(tmp_path))


def test_detector_retries(spark):
    frames = spark.createDataFrame([("r", i, bytes([i])) for i in range(4)], "room string, frame_idx int, image binary")

    def factory():
        tries = {}

        def client(image):
            tries[image] = tries.get(image, 0) + 1
            if image == b"\x01" and tries[image] < 3:
                raise RuntimeError("busy")
            if image == b"\x02":
                return "{", "MAX_TOKENS"
            if image == b"\x03":
                return "", "STOP"
            return json.dumps({"objects": [{"label": "desk", "box_2d": [0, 0, tries[image], 9], "confidence": 1}]}), "STOP"

        return client

    got = {r["frame_idx"]: r for r in detector.detect(frames, factory, sleep=lambda s: None).collect()}
    assert got[0]["error"] is None and '1, 9' in got[0]["reply"].replace("0, 0, ", "") and "3, 9" in got[1]["reply"]
    assert "truncated" in got[2]["error"] and got[3]["error"] == "empty response"
    assert detector.pace(10) == 6.0 and detector.pace(10, shared=True) == 12.0 and detector.backoff_seconds(9) == 60.0
