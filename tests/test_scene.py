"""End-to-end room with stub detections, the viewer queries and the run log stream."""

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.config import LabelConfig
from plumbline.plans import labelling, viewer
from plumbline.streaming import runlog

N, H, W = 4, 48, 64
CONFIG = LabelConfig(max_frames=4, min_mask_points=20, mask_erode_px=1)


@pytest.fixture(scope="module")
def room(spark):
    v, u = np.divmod(np.arange(H * W), W)
    left = (v >= 12) & (v < 36) & (u >= 8) & (u < 28)
    right = (v >= 12) & (v < 36) & (u >= 36) & (u < 56)
    frames = []
    for i in range(N):
        frames.append(pd.DataFrame({
            "room": "den", "frame_idx": i, "v": v, "u": u, "x": np.where(right, 2.0, 0.0), "y": 0.0,
            "z": np.where(left | right, 2.0, 6.0), "conf": True, "r": 10, "g": 20, "b": 30,
        }))
    points = spark.createDataFrame(pd.concat(frames))
    poses = []
    for i, x in enumerate(np.linspace(-1, 1, N)):
        pose = np.eye(4)
        pose[0, 3] = x
        poses.append(("den", i, i, pose.ravel().tolist(), H, W))
    cameras = spark.createDataFrame(poses, "room string, frame_idx bigint, frame_id int, pose array<double>, h int, w int")
    return points, cameras


def replies(spark, names=("desk", "lamp")):
    def box(u0, u1):
        return [round(12 / H * 1000), round(u0 / W * 1000), round(36 / H * 1000), round(u1 / W * 1000)]

    rows = []
    for i in range(N):
        first = names[0] if isinstance(names[0], str) else names[0][i % 2]
        doc = {"objects": [
            {"label": first, "box_2d": box(8, 28), "confidence": 0.9}, {"label": names[1], "box_2d": box(36, 56), "confidence": 0.9},
        ]}
        rows.append(("den", i, json.dumps(doc)))
    return spark.createDataFrame(rows, "room string, frame_idx bigint, reply string")


def test_two_objects_at_known_places(spark, room):
    found = labelling.label_scene(*room, labelling.detections_from_replies(replies(spark, (("desk", "table"), "lamp"))), CONFIG)
    objects = {r["label"]: r for r in found.objects.collect()}
    assert set(objects) == {"desk", "lamp"} and all(o["n_observations"] == 4 for o in objects.values())
    assert np.allclose(objects["desk"]["centroid"], [0, 0, 2], atol=0.05) and np.allclose(objects["lamp"]["centroid"], [2, 0, 2], atol=0.05)
    assert found.observations.where("object_id is null").count() == 0 and found.observations.count() == 8
    again, owned = labelling.refuse(found.observations, radius_floor=5.0, min_observations=2)
    assert again.count() == 2 and owned.count() == 8
    with pytest.raises(ValueError):
        labelling.refuse(found.observations, radius_floor=9.0)
    lines = [r["line"] for r in labelling.report_lines(found.objects).collect()]
    assert any(l.startswith("desk ") and "seen=4x" in l for l in lines)


def test_nothing_to_label(spark, room):
    points, cameras = room
    none = labelling.detections_from_replies(replies(spark)).limit(0)
    assert labelling.label_scene(points, cameras, none, CONFIG).objects.count() == 0


def test_frame_choice(spark, room):
    _, cameras = room
    pick = lambda **k: sorted(r["frame_idx"] for r in labelling.choose_frames(cameras, CONFIG, **k).collect())
    assert pick() == [0, 1, 2, 3] and pick(indices=[0, 2]) == [0, 2] and pick(indices=[0, 99, -1]) == [0]
    assert len(pick(max_frames=2)) == 2
    span = labelling.camera_span(cameras, labelling.choose_frames(cameras, CONFIG)).first()
    assert span["span_x"] == 2.0 and span["frames"] == 4


def test_viewer_queries(spark, room):
    points, cameras = room
    blob = viewer.cloud(points, "den", 1000)
    n = struct.unpack("<I", blob[:4])[0]
    assert n == 1000 and len(blob) == 4 + 12 * n + 3 * n
    with pytest.raises(ValueError):
        viewer.cloud(points, "../den")
    stepped, stats = viewer.path_of(cameras, "den")
    row = stats.first()
    assert row["span_max"] == 2.0 and row["n_poses"] == 4 and not row["too_still"]
    eye = np.eye(3).tolist()
    objects = spark.createDataFrame(
        [("den", "obj_000", "desk", [0.0, 0.0, 2.0], ([0.0, 0.0, 2.0], [1.0, 1.0, 1.0], eye)), ("den", "obj_001", "bad", None, None)],
        "room string, object_id string, label string, centroid array<double>, "
        "obb struct<center:array<double>,extent:array<double>,R:array<array<double>>>",
    )
    meta = viewer.plan_meta(points, cameras, objects, "den", up="y", size=300)
    assert meta["up_estimate"]["source"] == "manual" and len(meta["footprints"]) == 1
    assert len(meta["footprints"][0]["hull"]) == 4
    image = viewer.plan_image(points, "den", 1, size=300)
    assert image.startswith(b"\x89PNG")
    assert viewer.up_report(points.limit(3), cameras)["source"] == "none"


def test_plan_of_a_room_that_hangs_down(spark, room):
    _, cameras = room
    points = spark.range(800).selectExpr(
        "'den' AS room", "0 AS frame_idx", "cast(id AS int) AS v", "0 AS u", "cast(id % 20 AS float) AS x", "cast(2.5 * (id div 400) AS float) AS y",
        "cast(id div 20 % 20 AS float) AS z", "true AS conf", "cast(200 * (1 - id div 400) AS smallint) AS r", "cast(9 AS smallint) AS g", "cast(9 AS smallint) AS b",
    )
    flipped = points.withColumn("y", (-F.col("y")).cast("float"))
    upright = viewer.room_plan(points, cameras, "den", up="y", size=300, drop_ceiling=0.6)
    assert viewer.room_plan(flipped, cameras, "den", up="-y", size=300, drop_ceiling=0.6) == upright
    assert viewer.plan_image(flipped, "den", 1, size=300, drop_ceiling=0.6) != upright  # the floor would be cut
    assert viewer.room_plan(points, cameras, "den", size=300).startswith(b"\x89PNG")


def test_run_log_stream_agrees_with_batch(spark, tmp_path):
    events = [
        ("a", 0, "line", "[extract] x"), ("a", 1, "line", " 10%|# "), ("a", 2, "line", "[detect] y"), ("a", 3, "exit", "0"),
        ("b", 0, "line", "hello"), ("b", 1, "cancel", ""), ("b", 2, "exit", "0"), ("c", 0, "line", "[frames] z"), ("d", 0, "line", "x"), ("d", 1, "exit", "2"),
    ]
    source = tmp_path / "log"
    rows = spark.createDataFrame(events, "run_id string, seq bigint, kind string, line string")
    rows.where("seq < 2").coalesce(1).write.mode("append").json(str(source))

    def drain():
        query = (
            runlog.follow(runlog.line_source(spark, str(source)), max_lines=1).writeStream.outputMode("update")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
            .foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "states")) if not df.isEmpty() else None).start()
        )
        query.awaitTermination(120)

    drain()
    rows.where("seq >= 2").coalesce(1).write.mode("append").json(str(source))
    drain()
    states = spark.read.parquet(str(tmp_path / "states")).toPandas()
    last = states.groupby("run_id").last()
    pairs = {k: (r["status"], r["stage"]) for k, r in states.sort_values("total_lines").iterrows() for k in [r["run_id"]]}
    assert ("done", "label") in set(zip(states[states.run_id == "a"]["status"], states[states.run_id == "a"]["stage"]))
    assert set(states[states.run_id == "b"]["status"]) == {"cancelled"} and pairs["c"] == ("running", "starting")
    assert set(states[states.run_id == "d"]["status"]) == {"failed"} and len(last) == 4
    done = states[(states.run_id == "a") & (states.status == "done")].iloc[0]
    assert done["total_lines"] == 2 and list(done["lines"]) == ["[detect] y"]

    ends = spark.createDataFrame([("a", 0, False), ("b", 0, True), ("c", None, False), ("d", 2, False)], "run_id string, returncode int, cancelled boolean")
    batch = {r["run_id"]: (r["status"], r["stage"]) for r in runlog.statuses(rows.where("kind = 'line'"), ends).collect()}
    assert batch == {"a": ("done", "label"), "b": ("cancelled", "starting"), "c": ("running", "starting"), "d": ("failed", "starting")}


def test_run_log_stream_forgets_ended_and_silent_runs(spark, tmp_path):
    source = tmp_path / "log"

    def held(events, **times):
        """Runs that the stream remembers after it has seen these events, and what it said of them."""
        said = []
        spark.createDataFrame(events, "run_id string, seq bigint, kind string, line string").coalesce(1).write.mode("append").json(str(source))
        query = (
            runlog.follow(runlog.line_source(spark, str(source)), clock_slack="0 seconds", **times).writeStream.outputMode("update")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
            .foreachBatch(lambda df, i: said.extend((r["run_id"], r["status"], r["total_lines"]) for r in df.collect())).start()
        )
        query.awaitTermination(120)
        return query.lastProgress["stateOperators"][0]["numRowsTotal"], sorted(said)

    hour = 3_600_000
    assert held([("a", 0, "line", "x"), ("a", 1, "exit", "0"), ("b", 0, "line", "x"), ("c", 0, "cancel", "")], linger_ms=hour) == (
        3, [("a", "done", 1), ("b", "running", 1), ("c", "cancelled", 0)])
    # A late line counts and changes no status; from then on ended runs linger for a millisecond.
    late = [("a", 2, "line", "[detect] y"), ("c", 1, "line", "y"), ("c", 2, "exit", "0")]
    assert held(late, linger_ms=1) == (3, [("a", "done", 2), ("c", "cancelled", 1)])
    held([("d", 0, "line", "x")], silent_ms=1)
    left, said = held([("b", 1, "line", "x")])
    assert left == 1 and said == [("b", "running", 2)]
    # What comes after a run was forgotten begins a new one.
    assert held([("a", 3, "line", "z")]) == (2, [("a", "running", 1)])
