import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import boxes, lift

H, W = 48, 80
IDENTITY = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
# A sloping board, nearest at its left edge, before a far wall.
BOARD = {"top": 12, "bottom": 30, "left": 36, "right": 60}


def grid(spark, *, conf=True, spoil=()):
    row = np.arange(H * W)
    pdf = pd.DataFrame({"room": "r", "frame_idx": 0, "v": row // W, "u": row % W, "conf": conf})
    board = pdf["v"].between(BOARD["top"], BOARD["bottom"] - 1) & pdf["u"].between(BOARD["left"], BOARD["right"] - 1)
    pdf["z"] = np.where(board, 1.2 + 0.01 * (pdf["u"] - BOARD["left"]), 7.5)
    pdf["x"], pdf["y"] = (pdf["u"] - W / 2) * pdf["z"] / 70, (pdf["v"] - H / 2) * pdf["z"] / 70
    for v, u, value in spoil:
        pdf.loc[(pdf["v"] == v) & (pdf["u"] == u), ["x", "y", "z"]] = value
    return spark.createDataFrame(pdf[["room", "frame_idx", "v", "u", "x", "y", "z", "conf"]]), pdf[board]


def scene(spark, top, left, bottom, right):
    """One camera and one detection whose box has these pixel sides."""
    cams = spark.createDataFrame([("r", 0, IDENTITY, H, W)], "room string, frame_idx int, pose array<double>, h int, w int")
    share = [round(1000 * top / H), round(1000 * left / W), round(1000 * bottom / H), round(1000 * right / W)]
    dets = spark.createDataFrame(
        [("r", 0, 0, "board", share, 0.75)],
        "room string, frame_idx int, det_id int, label string, box_2d array<int>, confidence double",
    )
    return cams, dets


def on_board(spark, by=0):
    """The detection of the board, its box drawn `by` pixels too wide on every side."""
    return scene(spark, BOARD["top"] - by, BOARD["left"] - by, BOARD["bottom"] + by, BOARD["right"] + by)


@pytest.mark.parametrize("by", [0, 3])
def test_centroid_is_that_of_the_board(spark, by):
    pts, board = grid(spark)
    row = lift.lift(pts, *on_board(spark, by), erode_px=2, min_points=10).first()
    assert np.allclose(row["centroid"], board[["x", "y", "z"]].median(), atol=0.05)
    assert 0.3 < row["support"] <= 1.0 and (by or row["box_px"] == [36, 12, 60, 30])


def test_unsupported_detections_vanish(spark):
    pts, _ = grid(spark, conf=False)
    assert lift.lift(pts, *on_board(spark), min_points=10).count() == 0
    pts, _ = grid(spark)
    assert lift.lift(pts, *scene(spark, 14, 40, 17, 43), erode_px=0, min_points=40).count() == 0


def test_non_finite_pixels_are_ignored(spark):
    pts, _ = grid(spark, spoil=[(20, 50, np.nan), (21, 41, -np.inf), (15, 39, np.inf)])
    assert np.isfinite(lift.lift(pts, *on_board(spark), erode_px=1, min_points=10).first()["centroid"]).all()


def test_tiled_join_equals_broadcast_join(spark, monkeypatch):
    pts, _ = grid(spark)
    cams, dets = scene(spark, 6, 4, 44, 74)
    run = lambda: lift.lift(pts, cams, dets, erode_px=1, min_points=10, with_box=False).first()
    want = run()
    monkeypatch.setattr(lift, "fits_broadcast", lambda df: False)
    assert run() == want


def test_masks_replace_boxes(spark):
    pts, board = grid(spark)
    asked = len(board)
    masks = spark.createDataFrame(board[["v", "u"]]).selectExpr(
        "'r' AS room", "0 AS frame_idx", "0 AS det_id", "v", "u", f"{asked}L AS n_requested"
    )
    row = lift.lift(pts, *on_board(spark, 5), min_points=10, masks=masks).first()
    assert row["n_points"] == asked and row["support"] == 1.0


@pytest.mark.parametrize("box, want", [
    ([0, 0, 1000, 1000], (0, 0, W, H)), ([250, 500, 750, 1000], (40, 12, 80, 36)),
    ([1000, 900, 0, 100], (8, 0, 72, 48)), ([-1, -9999, 1001, 500], (0, 0, 40, 48)),
])
def test_descale(spark, box, want):
    df = spark.createDataFrame([(box,)], "b array<int>")
    assert tuple(df.withColumns(g.descale_box("b", F.lit(H), F.lit(W))).select("x0", "y0", "x1", "y1").first()) == want


def test_descale_rejects_short_boxes(spark):
    df = spark.createDataFrame([([0, 0, 100],)], "b array<int>")
    with pytest.raises(Exception, match="4 elements"):
        df.select(*g.descale_box("b", F.lit(H), F.lit(W)).values()).collect()


def test_oriented_boxes(spark):
    axis = np.linspace(-1, 1, 12)
    cube = np.array([(a, 2 * b, 3 * c) for a in axis for b in axis for c in axis])
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    pdf = pd.DataFrame(np.concatenate([cube, cube @ q.T + 5, [[1, 2, 3], [3, 2, 1]]]), columns=["x", "y", "z"])
    pdf["k"] = [0] * len(cube) + [1] * len(cube) + [2, 2]
    got = {r["k"]: r["obb"] for r in boxes.oriented_boxes(spark.createDataFrame(pdf), ["k"]).collect()}
    for k, center in ((0, [0, 0, 0]), (1, [5, 5, 5])):
        assert np.allclose(sorted(got[k]["extent"]), [2, 4, 6], atol=1e-6)
        assert np.allclose(got[k]["center"], center, atol=1e-6) and np.linalg.det(np.array(got[k]["R"])) > 0
    assert got[2]["extent"] == [0, 0, 0] and np.allclose(got[2]["R"], np.eye(3))


def test_quaternions_round_trip_in_every_branch(spark):
    quats = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0.5, 0.5, -0.5, 0.5], [0.9, 0.1, 0.2, -0.3], [0, 0, 0, 0]]
    df = spark.createDataFrame([([float(v) for v in q],) for q in quats], "q array<double>")
    for q, row in zip(quats, df.select(g.quat_to_rotation("q").alias("r"), g.rotation_to_quat(g.quat_to_rotation("q")).alias("b")).collect()):
        want = np.array(q if any(q) else [0, 0, 0, 1], dtype=float)
        want /= np.linalg.norm(want)
        back = np.array(row["b"])
        assert min(np.abs(back - want).max(), np.abs(back + want).max()) < 1e-9
        r = np.array(row["r"]).reshape(3, 3)
        assert np.allclose(r @ r.T, np.eye(3), atol=1e-12)
