"""Text and JSON room files: trajectories, observation, object and level documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry as g
from ..functions.text import object_number
from ..session import durable, lookup_join
from .roomfiles import write_room_files


def room_of_path(path: Column | str = "path") -> Column:
    """The folder that holds a file."""
    return F.element_at(F.split(g.as_col(path), "/"), -2)


def _file_path() -> Column:
    """The path of the file that a row is read from, without percent codes."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """`(path, index, line)`; the index counts from the first line of a file that is not blank.

    Files are read in blocks, and the lines of a block are numbered in their order by one task;
    a block starts after the lines of the blocks before it. Lines are written once, so that
    both steps see the same blocks.
    """
    lines = durable(spark.read.text(paths).select(
        _file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"),
    ))
    blocks = lines.groupBy("path", "block").agg(
        F.min("n").alias("first"), F.count(F.lit(1)).alias("lines"), F.min(F.when(F.col("line").rlike(r"\S"), F.col("n"))).alias("solid")
    )
    in_file = Window.partitionBy("path").orderBy("block")
    before = F.coalesce(F.sum("lines").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("before", before).withColumn("lead", F.min(F.col("solid") - F.col("first") + F.col("before")).over(Window.partitionBy("path")))
    starts = durable(placed.select("path", "block", (F.col("before") - F.col("first") - F.col("lead")).alias("shift")))
    return lookup_join(lines, starts, ["path", "block"]).select("path", (F.col("n") + F.col("shift")).cast("int").alias("index"), "line")


def read_trajectories(spark: SparkSession, paths: str | list[str], *, min_fields: int = 8) -> DataFrame:
    """`(room, index, t, position, quaternion)` from `t x y z qx qy qz qw` lines.

    `index` is the line number, so skipped malformed lines leave gaps; it does not depend on
    how a file is cut for reading. With `min_fields=4` the quaternion may be missing.
    """
    lines = _numbered_lines(spark, paths).select(room_of_path().alias("room"), "index", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"))
    parts = lines.select("room", "index", F.split("line", r"\s+").alias("p")).where(F.size("p") >= min_fields)
    number = lambda i: F.get("p", F.lit(i)).cast("double")
    return parts.select(
        "room", "index", number(0).alias("t"), F.array(*[number(i) for i in range(1, 4)]).alias("position"),
        F.when(F.size("p") >= 8, F.array(*[number(i) for i in range(4, 8)])).alias("quaternion"),
    )


def trajectory_poses(trajectory: DataFrame) -> DataFrame:
    """Camera-to-world poses of trajectory rows, without opening the frame archive."""
    return trajectory.select(
        "room", F.col("index").alias("frame_idx"),
        g.pose_from(g.quat_to_rotation("quaternion"), "position").alias("pose"),
    )


def write_trajectories(cameras: DataFrame, path: str, *, timestamp: Column | None = None) -> None:
    """`<path>/<room>/trajectory.txt` with ordered `t x y z qx qy qz qw` lines; `read_trajectories` reads it back."""
    pose = F.col("pose")
    rotation = F.array(*[pose[4 * i + j] for i in range(3) for j in range(3)])
    turned = cameras.withColumn("_q", g.rotation_to_quat(rotation)).withColumn(
        "_t", (F.col("frame_idx") if timestamp is None else timestamp).cast("double")
    )
    fields = [F.col("_t"), pose[3], pose[7], pose[11], *[F.col("_q")[i] for i in range(4)]]
    lines = turned.select("room", "frame_idx", F.concat_ws(" ", *[f.cast("string") for f in fields]).alias("value"))
    write_room_files(lines, path, "trajectory.txt", ["frame_idx"])


# What a document of each kind must hold besides being readable.
KINDS = {
    "observations": (schemas.OBSERVATION_DOC, "observations"),
    "objects": (schemas.OBJECT_DOC, "objects"),
    "level": (schemas.LEVEL_DOC, "applied"),
}


def _documents(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """Fields of each document with `path`, `n_bytes` and, for one that cannot be used, the `reason`.

    Files of no bytes at all are passed over by Spark's readers and have no row.
    """
    schema, needed = KINDS[kind]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    docs = spark.read.text(paths, wholetext=True).select(
        _file_path().alias("path"), F.octet_length("value").alias("n_bytes"),
        (~F.col("value").rlike(r"\S")).alias("blank"), F.from_json("value", schema, options).alias("d"),
    )
    reason = (
        F.when(F.col("blank"), F.lit("empty file")).when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), F.lit("not a document of this kind"))
        .when(F.col(f"d.{needed}").isNull(), F.lit(f"no {needed}"))
    )
    return docs.select("path", "n_bytes", reason.alias("reason"), "d.*").drop("_corrupt")


def rejected(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """`(room, path, reason, n_bytes)` of the documents that the reader of their kind leaves out."""
    return _documents(spark, paths, kind).where("reason IS NOT NULL").select(room_of_path().alias("room"), "path", "reason", "n_bytes")


def _room() -> Column:
    return F.coalesce(F.nullif("room", F.lit("")), room_of_path())


def read_observation_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """`(room, image_hw, frames_labeled)` of every readable document, also of those without observations."""
    return _documents(spark, paths, "observations").where("reason IS NULL").select(
        _room().alias("room"), F.coalesce("image_hw", F.array(F.lit(0), F.lit(0))).alias("image_hw"),
        F.coalesce("frames_labeled", F.array().cast("array<int>")).alias("frames_labeled"),
    )


def read_observations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Observation rows with the documented defaults; `rejected` has the documents left out."""
    docs = _documents(spark, paths, "observations").where("reason IS NULL")
    items = docs.select(
        _room().alias("room"), F.coalesce("image_hw", F.array(F.lit(0), F.lit(0))).alias("image_hw"),
        F.posexplode("observations").alias("position", "o"),
    )
    return items.select(
        "room", F.col("position").cast("bigint").alias("id"), "o.object_id", "o.frame_idx", "o.label",
        F.coalesce("o.vlm_confidence", F.lit(0.5)).alias("vlm_confidence"), "o.centroid", "o.obb",
        F.coalesce("o.n_points", F.lit(0)).alias("n_points"), F.coalesce("o.support", F.lit(0.0)).alias("support"),
        F.when(F.size("o.box_px") > 0, F.col("o.box_px")).alias("box_px"), "image_hw",
    )


def read_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    docs = _documents(spark, paths, "objects").where("reason IS NULL")
    items = docs.select(
        _room().alias("room"),
        F.coalesce("units", F.lit("meters")).alias("units"),
        F.coalesce("scale_verified", F.lit(False)).alias("scale_verified"), "n_frames_labeled",
        F.explode_outer("objects").alias("o"),
    )
    return items.select("room", "units", "scale_verified", "n_frames_labeled", F.col("o.id").alias("object_id"), "o.*").drop("id")


def read_level_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    docs = _documents(spark, paths, "level").where("reason IS NULL")
    return docs.select(
        room_of_path().alias("room"), "convention", F.flatten("applied").alias("applied"),
        F.flatten("cumulative").alias("cumulative"), "rotation_deg", "estimate",
    )


def _rounded_centroid() -> Column:
    return F.transform("centroid", lambda v: F.round(v, 4))


def object_documents(
    objects: DataFrame, headers: DataFrame, *, units: str = "meters"
) -> DataFrame:
    """`(room, document)`: one JSON text per room of `headers`, also without objects.

    `headers` holds `(room, scale_verified, n_frames_labeled)`; objects come from
    `fusion.with_lists`.
    """
    record = F.struct(
        F.col("object_id").alias("id"), "label", "aliases", _rounded_centroid().alias("centroid"), "obb",
        F.round("confidence", 4).alias("confidence"), "n_observations", "seen_in", "observation_ids",
    )
    ranked = F.array_sort(F.collect_list(F.struct(object_number("object_id").alias("number"), record.alias("record"))))
    grouped = objects.groupBy("room").agg(F.transform(ranked, lambda x: x["record"]).alias("objects"))
    body = F.struct(
        F.col("room").cast("string").alias("room"), F.lit(units).alias("units"), "scale_verified", "n_frames_labeled",
        F.coalesce("objects", F.array().cast(grouped.schema["objects"].dataType)).alias("objects"),
    )
    return headers.join(grouped, ["room"], "left").select("room", F.to_json(body, {"pretty": "true"}).alias("document"))


def observation_documents(observations: DataFrame, headers: DataFrame) -> DataFrame:
    """`(room, document)`; observations carry `object_id` from `rooms.with_owner`.

    `headers` holds `(room, image_hw, frames_labeled)`.
    """
    record = F.struct(
        "id", "object_id", "frame_idx", "label", F.round("vlm_confidence", 4).alias("vlm_confidence"),
        _rounded_centroid().alias("centroid"), "obb", "n_points", F.round("support", 4).alias("support"), "box_px",
    )
    grouped = observations.groupBy("room").agg(F.array_sort(F.collect_list(record)).alias("observations"))
    body = F.struct(
        F.col("room").cast("string").alias("room"), "image_hw", F.array_sort("frames_labeled").alias("frames_labeled"),
        F.coalesce("observations", F.array().cast(grouped.schema["observations"].dataType)).alias("observations"),
    )
    options = {"pretty": "true", "ignoreNullFields": "false"}
    return headers.join(grouped, ["room"], "left").select("room", F.to_json(body, options).alias("document"))


def level_documents(records: DataFrame) -> DataFrame:
    """`(room, document)` of level records, with transforms as rows of four; `read_level_records` reads it back."""
    rows = lambda c: F.array(*[F.slice(c, 4 * i + 1, 4) for i in range(4)])
    body = F.struct("convention", rows("applied").alias("applied"), rows("cumulative").alias("cumulative"), "rotation_deg", "estimate")
    return records.select("room", F.to_json(body, {"pretty": "true"}).alias("document"))


def write_documents(documents: DataFrame, path: str, file: str = "document.json") -> None:
    """`<path>/<room>/<file>` for each room."""
    write_room_files(documents, path, file, [], "document")
