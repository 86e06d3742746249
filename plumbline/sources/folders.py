"""Folder listings as tables: images, rooms, videos and encoded frames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rooms
from ..operators.sequences import row_numbers
from .documents import room_of_path

# Accepted file endings.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")
VIDEO_SUFFIXES = ("mp4", "mov", "avi", "mkv", "m4v")
VIDEO_FOLDERS = ("video_examples", "data/rooms", "data")


def _listing(spark: SparkSession, path: str | list[str], *, recursive: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return reader.option("recursiveFileLookup", True).load(path) if recursive else reader.load(path)


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).withColumn("suffix", F.lower(F.element_at(F.split("name", r"\."), -1)))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """`(path, room, name, suffix, bytes)`; file contents are never read."""
    return _named(_listing(spark, path)).select("path", room_of_path().alias("room"), "name", "suffix", F.col("length").alias("bytes"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder, or of one folder per room, in name order with `ts` = position."""
    files = _named(_listing(spark, path)).where(F.col("suffix").isin(*IMAGE_SUFFIXES))
    named = files.select(room_of_path().alias("room"), "name", "path")
    placed = row_numbers(named, ["room"], ["name"])
    contents = files.select("path", F.col("content").alias("image"))
    return placed.join(contents, "path").withColumn("ts", F.col("idx").cast("double"))


def source_kind(source: str) -> str:
    """`images` for a folder, `video` for a known ending, otherwise an error."""
    if os.path.isdir(source):
        return "images"
    if source.rsplit(".", 1)[-1].lower() in VIDEO_SUFFIXES:
        return "video"
    raise ValueError(f"unsupported source: {source} (expected a video or a folder)")


def reconstruction_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Frame files of every room in name order; rooms need at least two."""
    files = list_files(spark, path).where(F.col("suffix").isin("png", "jpg", "jpeg"))
    short = files.groupBy("room").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < 2).limit(1).collect()
    if short:
        raise ValueError(f"room {short[0]['room']} has fewer than 2 frames")
    return row_numbers(files, ["room"], ["name"])


def discover_rooms(spark: SparkSession, path: str) -> DataFrame:
    """Rooms under a folder with the presence of each artifact."""
    return rooms.artifact_presence(list_files(spark, path).select("room", "name"))


def list_videos(spark: SparkSession, project: str) -> DataFrame:
    """Videos below the known folders of a project: `(path, name, mb)`."""
    root = os.path.realpath(project)
    folders = [os.path.join(root, f) for f in VIDEO_FOLDERS if os.path.isdir(os.path.join(root, f))]
    if not folders:
        return spark.createDataFrame([], "path string, name string, mb double")
    # `data/rooms` lies inside `data`: list it once.
    files = _named(_listing(spark, [f for f in folders if not f.endswith("data/rooms") or os.path.join(root, "data") not in folders]))
    shown = F.expr(f"substring(path, instr(path, '{root}') + {len(root) + 1})")
    return files.where(F.col("suffix").isin(*VIDEO_SUFFIXES)).select(
        shown.alias("path"), "name", F.round(F.col("length") / 1e6, 1).alias("mb")
    )


def write_frames(frames: DataFrame, path: str) -> DataFrame:
    """Write encoded frames as `<room>/<position>.png`; returns what was written.

    Each task writes its own files to the shared folder; a repeated task overwrites them
    with the same content.
    """
    placed = row_numbers(frames, ["room"], ["idx"], name="position")

    def run(batches):
        import pandas as pd

        from .clouds import _filesystem

        system, root = _filesystem(path)
        for batch in batches:
            paths = []
            for room, position, image in zip(batch["room"], batch["position"], batch["image"]):
                folder = f"{root}/{room}"
                system.create_dir(folder, recursive=True)
                target = f"{folder}/{position:03d}.png"
                with system.open_output_stream(target) as out:
                    out.write(bytes(image))
                paths.append(target)
            yield pd.DataFrame({
                "room": batch["room"].astype(str), "index": batch["position"], "ts": batch["ts"],
                "sharpness": batch["sharpness"], "path": paths,
            })

    return placed.select("room", "position", "ts", "sharpness", "image").mapInPandas(
        run, "room string, index bigint, ts double, sharpness double, path string"
    )
