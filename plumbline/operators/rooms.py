"""Room catalogue, summaries and the filters of object views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scores import object_hue
from .quantiles import finite
from .sequences import row_numbers

# Files that make a directory a room.
ARTIFACTS = ("scene.ply", "trajectory.txt", "frames.npz", "objects.json", "observations.json")


def room_name_ok(name: str) -> bool:
    """Room names may not walk the file system."""
    return bool(name) and "/" not in name and "\\" not in name and not name.startswith(".")


def artifact_presence(listing: DataFrame) -> DataFrame:
    """`(room, has_*)` from `(room, name)` rows, rooms without any artifact dropped."""
    has = [F.bool_or(F.col("name") == a).alias("has_" + a.replace(".", "_")) for a in ARTIFACTS]
    return listing.where(F.col("name").isin(*ARTIFACTS)).groupBy("room").agg(*has)


def frame_listing(listing: DataFrame) -> DataFrame:
    """PNG frames of each room with their position in name order."""
    return row_numbers(listing.where(F.lower("name").endswith(".png")), ["room"], ["name"], name="index")


def room_summary(rooms: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """Left-join per-artifact row counts (`n_<part>`) onto the rooms; absent parts are null.

    Each part is counted per room before it is joined.
    """
    out = rooms
    for name, part in parts.items():
        counted = part.groupBy("room").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(counted, ["room"], "left")
    return out


def visible(min_confidence: float = 0.0, min_observations: int = 1, needle: str = "") -> Column:
    """Objects shown under the view's thresholds and text filter."""
    return (
        (F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_confidence)
        & (F.col("n_observations") >= min_observations)
        & text.matches_text("label", "aliases", needle)
    )


def drawable(extent: Column) -> Column:
    """Boxes worth drawing: finite and not degenerate on every axis."""
    sides = [extent[i] for i in range(3)]
    return finite(*sides) & (F.greatest(*sides) > 1e-6)


def with_owner(observations: DataFrame, membership: DataFrame, keys: Sequence[str] = ("room", "id")) -> DataFrame:
    """Tag observations with their object; null where none claims them.

    `keys` name what an object claims: single observations, or with `("room",)` all of a room.
    """
    edges = membership.select(*keys, "object_id")
    return observations.join(edges, list(keys), "left")


def with_display_position(objects: DataFrame) -> DataFrame:
    """Add the position and hue the views colour an object by; ids go by their number."""
    numbered = objects.withColumn("_number", text.object_number("object_id"))
    ranked = row_numbers(numbered, ["room"], ["_number", "object_id"], name="position").drop("_number")
    return ranked.withColumn("hue", object_hue(F.col("position")))


def through_frame_ids(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    """Replace the row index of an observation by the id of the extracted frame.

    The two differ once frames of another shape were dropped, so views must not match
    images by row index.
    """
    return observations.join(cameras.select("room", "frame_idx", "frame_id"), ["room", "frame_idx"], "left")
