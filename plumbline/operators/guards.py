"""Input checks and rescaling ahead of reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, lookup_join
from .quantiles import finite
from .sequences import row_numbers

ROOM = ["room"]


class MixedShapes(ValueError):
    """Frames of one room differ in size."""


def shape_majorities(images: DataFrame) -> DataFrame:
    """`(room, h, w, n, shapes)`: the most frequent size, the first seen on a tie."""
    counts = images.groupBy("room", "h", "w").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    return counts.groupBy("room").agg(
        F.max_by(F.struct("h", "w", "n"), F.struct(F.col("n"), -F.col("first"))).alias("m"),
        F.count(F.lit(1)).alias("shapes"),
    ).select("room", "m.*", "shapes")


def uniform_shape(images: DataFrame, *, allow_mixed: bool = False) -> DataFrame:
    """Keep frames of the majority size, renumbered from 0 with `source_idx` kept.

    Mixed sizes are an error naming up to eight odd frames unless `allow_mixed`; a room
    reduced to a single frame is an error either way.
    """
    majority = durable(shape_majorities(images))
    mixed = majority.where(F.col("shapes") > 1)
    if not allow_mixed:
        bad = mixed.limit(1).collect()
        if bad:
            row = bad[0]
            odd = (
                images.where((F.col("room") == row["room"]) & ~((F.col("h") == row["h"]) & (F.col("w") == row["w"])))
                .orderBy("idx").limit(8).collect()
            )
            names = ", ".join(str(r["name"] if "name" in images.columns else r["idx"]) for r in odd)
            raise MixedShapes(
                f"room {row['room']} mixes {row['shapes']} image sizes, most are {row['h']}x{row['w']}; "
                f"odd ones out: {names}. Supply one orientation or allow mixed input to keep the majority."
            )
    lone = mixed.where(F.col("n") < 2).limit(1).collect()
    if lone:
        raise MixedShapes(f"only one image of room {lone[0]['room']} remains in one orientation; need at least 2")
    kept = lookup_join(images, majority.select("room", "h", "w"), ["room", "h", "w"], "left_semi")
    return row_numbers(kept.withColumnRenamed("idx", "source_idx"), ROOM, ["source_idx"], name="idx")


def rescale_factors(points: DataFrame, target: float) -> DataFrame:
    """`(room, factor)` that makes the largest axis span of all finite points `target`."""
    xyz = [F.col(c).cast("double") for c in "xyz"]
    spans = F.greatest(*[F.max(c) - F.min(c) for c in xyz])
    return points.where(finite(*xyz)).groupBy("room").agg(spans.alias("span")).select(
        "room", F.when(F.col("span") <= 1e-9, F.lit(1.0)).otherwise(F.lit(float(target)) / F.col("span")).alias("factor")
    )


def rescale(points: DataFrame, cameras: DataFrame, target: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scale points and camera positions of every room; returns both and the factors."""
    factors = durable(rescale_factors(points, target))
    by = F.coalesce(F.col("factor"), F.lit(1.0))
    types = dict(points.dtypes)
    scaled = lookup_join(points, factors, ROOM, "left").withColumns(
        {c: (F.col(c) * by).cast(types[c]) for c in "xyz"}
    ).select(*points.columns)
    pose = F.array(*[
        (F.col("pose")[i] * by) if i in (3, 7, 11) else F.col("pose")[i].cast("double") for i in range(16)
    ])
    moved = lookup_join(cameras, factors, ROOM, "left").withColumn("pose", pose).select(*cameras.columns)
    return scaled, moved, factors
