"""Camera path measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .sequences import previous_row

TOO_STILL = 1.0
SMALL_STEP = 0.05


def steps(
    poses: DataFrame, keys: Sequence[str], order: Sequence[str], *, chunk: Column | None = None
) -> DataFrame:
    """Add `first` and `step`: the distance from the previous position, 4 decimals."""
    walked = previous_row(poses, keys, order, ["x", "y", "z"], chunk=chunk)
    away = g.distance3([F.col(c) for c in "xyz"], [F.col(f"prev.{c}") for c in "xyz"])
    return (
        walked.withColumn("first", F.col("prev").isNull())
        .withColumn("step", F.when(F.col("first"), F.lit(0.0)).otherwise(F.round(away, 4)))
        .drop("prev")
    )


def stats(stepped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Span per axis, largest span, path length, mean step and the stillness alert."""
    span = [F.max(c) - F.min(c) for c in "xyz"]
    mean = F.coalesce(F.avg(F.when(~F.col("first"), F.col("step"))), F.lit(0.0))
    return (
        stepped.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_poses"),
            *[F.round(s, 4).alias(f"span_{c}") for s, c in zip(span, "xyz")],
            F.round(F.greatest(*span), 4).alias("span_max"),
            F.round(F.sum("step"), 4).alias("path_length"),
            F.round(mean, 4).alias("mean_step"),
            F.count_if((F.col("step") > 0) & (F.col("step") < SMALL_STEP)).alias("small_steps"),
        )
        .withColumn("too_still", F.col("span_max") < TOO_STILL)
    )


def segments(poses: DataFrame, keys: Sequence[str], order: Sequence[str], **kwargs) -> DataFrame:
    """Line segments between consecutive positions."""
    linked = previous_row(poses, keys, order, ["x", "y", "z"], name="start", **kwargs)
    return linked.where(F.col("start").isNotNull()).withColumn("end", F.struct("x", "y", "z"))
