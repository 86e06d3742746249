import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import imaging
from plumbline.operators import frames as fr
from plumbline.operators import guards, pairs
from plumbline.sources import folders


def noise(seed, size=96):
    return np.random.default_rng(seed).integers(0, 256, (size, size, 3)).astype(np.uint8)


def blurred(image, k=15):
    out = image.astype(float)
    for axis in (0, 1):
        padded = np.pad(out, [(k // 2, k // 2) if a == axis else (0, 0) for a in range(3)], mode="reflect")
        out = np.mean([np.take(padded, range(s, s + image.shape[axis]), axis=axis) for s in range(k)], axis=0)
    return out.astype(np.uint8)


def features(spark, rooms):
    rows = [
        (room, i, imaging.laplacian_variance(f), imaging.thumbnail(f).ravel().tolist())
        for room, frames in rooms.items() for i, f in enumerate(frames)
    ]
    return spark.createDataFrame(rows, "room string, idx bigint, sharpness double, thumb array<double>")


def chosen(df):
    return df.toPandas().groupby("room")["idx"].apply(sorted).to_dict()


def test_selection_rules(spark):
    still = noise(0)
    table = features(spark, {
        "short": [noise(i) for i in range(3)],
        "budget": [noise(i) for i in range(30)],
        "static": [still] * 20 + [noise(i) for i in range(1, 21)],
        "same": [still] * 30,
        "dull": [blurred(noise(i)) for i in range(20)],
    })
    streamed = chosen(fr.select_frames(table, 10, dedup_correlation=0.98))
    rounds = chosen(fr.select_frames(table, 10, dedup_correlation=0.98, stream_rows=5))
    assert streamed == rounds
    assert streamed["short"] == [0, 1, 2] and len(streamed["budget"]) == 10
    assert sum(i < 20 for i in streamed["static"]) <= 2
    assert len(streamed["same"]) == 4 and len(streamed["dull"]) >= 4
    assert all(len(set(v)) == len(v) for v in streamed.values())


def test_sharp_frames_win_their_window(spark):
    mixed = [blurred(noise(i)) if i % 2 == 0 else noise(i) for i in range(24)]
    table = features(spark, {"r": mixed})
    kept = chosen(fr.select_frames(table, 12, dedup_correlation=1.1))["r"]
    assert sum(i % 2 for i in kept) > len(kept) / 2
    assert kept == sorted(r["idx"] for r in fr.sharpest_per_window(table, 12).collect())


def cams(spark, rooms):
    rows = []
    for room, xyz in rooms.items():
        for i, p in enumerate(xyz):
            pose = np.eye(4)
            pose[:3, 3] = p
            rows.append((room, i, pose.ravel().tolist()))
    return spark.createDataFrame(rows, "room string, frame_idx bigint, pose array<double>")


def test_windows_reach_the_end_of_the_video(spark):
    rows = [("r", i, 9.0 if i == 46 else 1.0, [1.0]) for i in range(47)]
    table = spark.createDataFrame(rows, "room string, idx bigint, sharpness double, thumb array<double>")
    picks = fr.sharpest_per_window(table, 24).collect()
    assert len(picks) == 24 and max(r["idx"] for r in picks) == 46
    assert 46 in chosen(fr.select_frames(table, 24, dedup_correlation=1.1))["r"]


def test_pairs_go_by_place_where_numbers_have_holes(spark):
    table = spark.createDataFrame([("r", 0), ("r", 1), ("r", 5)], "room string, frame_idx bigint")
    got = sorted((r["i"], r["j"]) for r in pairs.swin_pairs(table, 1).collect())
    assert got == [(0, 1), (1, 0), (1, 5), (5, 1)]


def test_covering_frames(spark):
    rng = np.random.default_rng(1)
    walk = np.cumsum(rng.normal(size=(40, 3)), axis=0)
    table = cams(spark, {
        "line": [(i * 0.1, 0, 0) for i in range(30)], "walk": walk, "still": [(1, 1, 1)] * 8,
        "few": [(0, 0, 0), (1, 0, 0)], "bad": [(np.nan if i == 3 else i, 0, 0) for i in range(9)],
    })
    got = fr.covering_frames(table, 4).toPandas().groupby("room")["frame_idx"].apply(sorted)
    assert got["few"] == [0, 1] and got["bad"] == [0, 3, 5, 7] and len(got["still"]) == 4
    assert got["line"][0] == 0 and got["line"][-1] == 29
    start = int(np.argmin(np.linalg.norm(walk - walk.mean(axis=0), axis=1)))
    picks = [start]
    while len(picks) < 4:
        gaps = np.min(np.linalg.norm(walk[:, None] - walk[picks], axis=2), axis=1)
        gaps[picks] = -1
        picks.append(int(np.argmax(gaps)))
    assert got["walk"] == sorted(picks)
    in_rounds = fr.covering_frames(table, 4, array_frames=10).toPandas().groupby("room")["frame_idx"].apply(sorted)
    assert in_rounds.to_dict() == got.to_dict()


def test_image_kernels():
    sharp = noise(0)
    assert imaging.laplacian_variance(sharp) > imaging.laplacian_variance(blurred(sharp))
    for pixels in (sharp, sharp[:, :, 0]):
        assert np.array_equal(imaging._decode_png(imaging.encode_png(pixels)), pixels)
    corner = np.zeros((4, 6, 3), np.uint8)
    corner[0, 0] = 255
    assert imaging.turned(corner, 90)[0, -1].all() and imaging.turned(corner, 270)[-1, 0].all()
    assert imaging.turned(corner, 45) is corner
    assert abs(np.linalg.norm(imaging.thumbnail(sharp)) - 1) < 1e-9 and not imaging.thumbnail(np.zeros((50, 50))).any()
    mask = np.zeros((20, 20), bool)
    mask[5:15, 0:10] = True
    kept = imaging.erode(mask, 2)
    assert kept.sum() == 6 * 8 and kept[7, 0] and np.array_equal(imaging.erode(mask, 9), mask)
    import base64
    soft = np.full((10, 10), 200, np.uint8)
    soft[:, 5:] = 10
    text = "data:image/png;base64," + base64.b64encode(imaging.encode_png(soft)).decode()
    full = imaging.decode_mask(text, (4, 2, 14, 12), 30, 40)
    assert full.sum() == 50 and full[2:12, 4:9].all()
    assert imaging.decode_mask(text, (0, 0, 20, 20), 30, 40).sum() > 150


def test_folder_of_images_to_frames(spark, tmp_path):
    src = tmp_path / "kitchen"
    src.mkdir()
    for i in range(6):
        (src / f"{i:02d}.png").write_bytes(imaging.encode_png(noise(i, 48)))
    (src / "notes.txt").write_text("x")
    images = folders.read_images(spark, str(src)).withColumn("f", imaging.frame_features("image"))
    table = images.select("room", "idx", "ts", "image", "f.*")
    assert table.select("room", "h", "w").distinct().collect() == [("kitchen", 48, 48)]
    kept = fr.select_frames(table.select("room", "idx", "sharpness", "thumb"), 5, dedup_correlation=1.1)
    written = folders.write_frames(table.join(kept, ["room", "idx"], "left_semi"), str(tmp_path / "out")).toPandas()
    assert sorted(written["index"]) == list(range(len(written)))
    assert (tmp_path / "out" / "kitchen" / "000.png").exists()
    assert folders.source_kind(str(src)) == "images" and folders.source_kind("a.MOV") == "video"
    with pytest.raises(ValueError):
        folders.source_kind("a.txt")


def test_shape_guard(spark):
    sizes = [(512, 384), (384, 512), (512, 384), (512, 384)]
    df = spark.createDataFrame([("r", i, h, w) for i, (h, w) in enumerate(sizes)], "room string, idx bigint, h int, w int")
    with pytest.raises(guards.MixedShapes, match="1"):
        guards.uniform_shape(df)
    kept = guards.uniform_shape(df, allow_mixed=True).orderBy("idx").collect()
    assert [(r["idx"], r["source_idx"]) for r in kept] == [(0, 0), (1, 2), (2, 3)]
    with pytest.raises(guards.MixedShapes, match="only one"):
        guards.uniform_shape(df.where("idx < 2"), allow_mixed=True)


def test_rescale(spark):
    pts = spark.createDataFrame(
        [("a", 0.0, 0.0, 0.0), ("a", 2.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0)], "room string, x double, y double, z double"
    )
    scaled, moved, factors = guards.rescale(pts, cams(spark, {"a": [(1, 0, 0)], "b": [(1, 0, 0)]}), 4.0)
    assert {r["room"]: r["factor"] for r in factors.collect()} == {"a": 2.0, "b": 1.0}
    assert scaled.where("room = 'a'").agg(F.max("x")).first()[0] == 4.0
    assert {r["room"]: r["pose"][3] for r in moved.collect()} == {"a": 2.0, "b": 1.0}


@pytest.mark.parametrize("n, k", [(1, 3), (3, 3), (4, 3), (24, 3), (8, 1)])
def test_pair_graph(spark, n, k):
    frames = spark.range(n).select(F.lit("r").alias("room"), F.col("id").alias("frame_idx"))
    got = {(r["i"], r["j"]) for r in pairs.swin_pairs(frames, k).collect()}
    assert got == {(i, j) for i in range(n) for j in range(n) if i != j and abs(i - j) <= k}
    row = pairs.pair_counts(frames, k).first()
    assert row["swin_pairs"] == len(got) and row["complete_pairs"] == n * (n - 1)
