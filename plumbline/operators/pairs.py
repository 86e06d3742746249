"""Image pair graphs for reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..session import durable
from .sequences import row_numbers


def swin_pairs(frames: DataFrame, window: int, *, symmetric: bool = True) -> DataFrame:
    """`(room, i, j)` for frames at most `window` places apart, in both directions.

    Places are counted along the frames that a room has, so numbers may have holes. Each
    frame expands to the places around it, which are looked up by an equi-join.
    """
    placed = durable(row_numbers(frames.select("room", "frame_idx"), ["room"], ["frame_idx"], name="place"))
    steps = [d for d in range(-window, window + 1) if d > 0 or (symmetric and d < 0)]
    around = placed.select(
        "room", F.col("frame_idx").alias("i"), F.explode(F.array(*[F.col("place") + d for d in steps])).alias("place")
    )
    partners = placed.select("room", "place", F.col("frame_idx").alias("j"))
    return around.join(partners, ["room", "place"]).select("room", "i", "j")


def pair_counts(frames: DataFrame, window: int) -> DataFrame:
    """Pairs of the sliding-window and complete graphs, and the expected minutes."""
    n = F.col("n_frames")
    return frames.groupBy("room").agg(F.count(F.lit(1)).alias("n_frames")).select(
        "room", "n_frames", scores.swin_pair_count(n, window).alias("swin_pairs"),
        scores.complete_pair_count(n).alias("complete_pairs"),
        F.round(scores.run_minutes(n, scores.swin_pair_count(n, window)), 4).alias("minutes"),
    )
