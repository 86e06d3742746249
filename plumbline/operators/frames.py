"""Choose informative frames from a video and covering frames from a trajectory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.imaging import correlation
from ..session import discard, durable, lookup_join, spread
from .quantiles import exact_quantiles, finite

ROOM = ["room"]
# Rooms up to this many rows are chosen by one streaming task each; larger ones in
# rounds, each a distributed search for the next pick of every such room.
STREAM_ROWS = 50_000
# Paths up to this many frames, about a megabyte, are one array row each while covering frames are picked.
ARRAY_FRAMES = 20_000
# Thumbnails are several kilobytes each, so far fewer of them may be broadcast.
THUMB_ROWS = 2_000


def _room_sizes(frames: DataFrame) -> DataFrame:
    return durable(frames.groupBy("room").agg(F.count(F.lit(1)).alias("_n")))


def _window_of(n_frames: int) -> Column:
    """The index window of a frame: `n_frames` windows over all `_n` frames of its room."""
    return F.expr(f"(idx * least({int(n_frames)}, _n)) div _n")


def window_candidates(
    features: DataFrame, n_frames: int, *, blur_percentile: float = 25.0, min_frames: int = 4
) -> DataFrame:
    """Frames of rooms that need choosing, with their index window and usability.

    `n_frames` windows of near-equal length cover the whole video (fewer where it has fewer
    frames). Frames under the room's blur percentile are unusable unless their whole window is.
    """
    sizes = _room_sizes(features)
    large = lookup_join(features, sizes.where(F.col("_n") > min_frames), ROOM)
    cuts = exact_quantiles(
        large, ROOM, {"_floor": ("sharpness", blur_percentile / 100.0)},
        largest=sizes.agg(F.max("_n")).first()[0] or 0,
    )
    marked = lookup_join(large, durable(cuts), ROOM).withColumn("bucket", _window_of(n_frames))
    sharp_enough = F.col("sharpness") >= F.col("_floor")
    rescued = durable(
        marked.groupBy("room", "bucket").agg(F.bool_or(sharp_enough).alias("_any"))
        .where(~F.col("_any")).select("room", "bucket", F.lit(True).alias("_dull"))
    )
    return (
        lookup_join(marked, rescued, ["room", "bucket"], "left")
        .where(sharp_enough | F.col("_dull")).drop("_dull", "_floor")
    )


def sharpest_per_window(features: DataFrame, n_frames: int) -> DataFrame:
    """The sharpest frame of each of `n_frames` index windows, first on ties.

    This is the selection without near-duplicate rejection. The sharpest frame of a
    window is usable whenever any is, so the blur floor cannot change the pick.
    """
    sizes = _room_sizes(features)
    bucketed = lookup_join(features, sizes, ROOM).withColumn("bucket", _window_of(n_frames))
    return (
        bucketed.groupBy("room", "bucket")
        .agg(F.max_by(F.struct("idx", "sharpness"), F.struct(F.col("sharpness"), -F.col("idx"))).alias("_p"))
        .select("room", "bucket", "_p.*")
    )


def _stream_picks(n_frames: int, limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room, kept, done, last = object(), 0, -1, None
        for batch in batches:
            picks = []
            for r, bucket, idx, thumb in zip(batch["room"], batch["bucket"], batch["idx"], batch["thumb"]):
                if r != room:
                    room, kept, done, last = r, 0, -1, None
                if bucket == done or kept >= n_frames:
                    continue
                thumb = np.asarray(thumb, dtype=float)
                if last is not None and min(max(float(thumb @ last), -1.0), 1.0) > limit:
                    continue
                last, done, kept = thumb, bucket, kept + 1
                picks.append((r, idx))
            yield pd.DataFrame(picks, columns=["room", "idx"])

    return run


def _pick_streaming(candidates: DataFrame, n_frames: int, limit: float) -> DataFrame:
    types = dict(candidates.dtypes)
    ordered = (
        spread(candidates.withColumn("_rank", -F.col("sharpness")), "room")
        .sortWithinPartitions("room", "bucket", "_rank", "idx")
    )
    return ordered.select("room", "bucket", "idx", "thumb").mapInPandas(
        _stream_picks(n_frames, limit), f"room {types['room']}, idx {types['idx']}"
    )


def _pick_in_rounds(candidates: DataFrame, n_frames: int, limit: float) -> DataFrame:
    """Each round finds, per room, the first acceptable frame after the last pick."""
    order = F.struct("bucket", -F.col("sharpness"), "idx")
    state, picked = None, None
    for _ in range(n_frames):
        if state is None:
            pool = candidates
        else:
            after = state.select("room", F.col("bucket").alias("_b"), F.col("thumb").alias("_t"))
            pool = lookup_join(candidates, after, ROOM, max_rows=THUMB_ROWS)
            pool = pool.where((F.col("bucket") > F.col("_b")) & (correlation("thumb", "_t") <= limit))
        state = durable(
            pool.groupBy("room").agg(F.min_by(F.struct("bucket", "idx", "thumb"), order).alias("_p")).select("room", "_p.*")
        )
        if state.isEmpty():
            break
        chosen = state.select("room", "idx")
        picked = chosen if picked is None else picked.unionByName(chosen)
    return candidates.select("room", "idx").limit(0) if picked is None else picked


def select_frames(
    features: DataFrame,
    n_frames: int,
    *,
    blur_percentile: float = 25.0,
    dedup_correlation: float = 0.985,
    min_frames: int = 4,
    stream_rows: int = STREAM_ROWS,
) -> DataFrame:
    """`(room, idx)` of the frames to keep, from `(room, idx, sharpness, thumb)`.

    Walking the index windows in order, the sharpest usable frame that does not repeat
    the last kept one is taken until the budget is met. Rooms of at most `min_frames`
    frames are kept whole; a choice that ends below `min_frames` is topped up with the
    sharpest unused frames. Frame numbers of a room run 0..n-1.
    """
    sizes = _room_sizes(features)
    whole = lookup_join(features, sizes.where(F.col("_n") <= min_frames), ROOM, "left_semi").select("room", "idx")
    candidates = window_candidates(
        features, n_frames, blur_percentile=blur_percentile, min_frames=min_frames
    )
    parts = [_pick_streaming(candidates.where(F.col("_n") <= stream_rows), n_frames, dedup_correlation)]
    if not sizes.where((F.col("_n") > stream_rows) & (F.col("_n") > min_frames)).isEmpty():
        parts.append(
            _pick_in_rounds(candidates.where(F.col("_n") > stream_rows), n_frames, dedup_correlation)
        )
    kept = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    kept = durable(kept)
    counts = durable(kept.groupBy("room").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") < min_frames))
    if not counts.isEmpty():
        short = lookup_join(lookup_join(features.select("room", "idx", "sharpness"), counts, ROOM), sizes, ROOM)
        spare = short.where(F.col("_n") > min_frames).join(kept, ["room", "idx"], "left_anti")
        rank = Window.partitionBy("room").orderBy(F.col("sharpness").desc(), "idx")
        # The rank filter becomes a per-partition group limit ahead of the shuffle.
        extra = spare.withColumn("_r", F.row_number().over(rank)).where(
            (F.col("_r") <= min_frames) & (F.col("_r") <= F.lit(min_frames) - F.col("_k"))
        )
        kept = kept.unionByName(extra.select("room", "idx"))
    return kept.unionByName(whole)


# --- covering frames -----------------------------------------------------------------


def _cover_in_arrays(centers: DataFrame, budget: int) -> DataFrame:
    """Farthest-point picks of rooms whose path fits one array: one pass over the rows, no job per pick.

    The state of the fold is each frame's distance to the nearest pick (below zero for a
    pick) and the place of the next pick.
    """
    xyz = ("x", "y", "z")
    # The fold is far more work than its bytes tell, so partitions are not merged.
    rooms = spread(centers, "room").groupBy("room").agg(
        F.sort_array(F.collect_list(F.struct("frame_idx", *xyz))).alias("p"), *[F.avg(c).alias(f"m{c}") for c in xyz]
    )

    def first(values: Column) -> Column:
        return F.array_position(values, F.array_max(values)).cast("int")

    def bound(value: Column, use) -> Column:  # names a value, so that it is computed once
        return F.transform(F.array(value), use)[0]

    def step(state: Column, _: Column) -> Column:
        def gap(frame: Column, i: Column) -> Column:
            pick = F.col("p")[state["next"] - 1]
            away = F.least(state["d"][i], g.distance3([frame[c] for c in xyz], [pick[c] for c in xyz]))
            return F.when((i == state["next"] - 1) | (state["d"][i] < 0), -1.0).otherwise(away)

        return bound(F.transform("p", gap), lambda d: F.struct(d.alias("d"), first(d).alias("next")))

    near = bound(
        F.transform("p", lambda f: -g.distance3([f[c] for c in xyz], [F.col(f"m{c}") for c in xyz])), first
    )
    start = F.struct(F.transform("p", lambda f: F.lit(float("inf"))).alias("d"), near.alias("next"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(budget)), start, step, lambda state: state["d"])
    return rooms.select("room", "p", done.alias("d")).select(
        "room", F.explode(F.filter("p", lambda f, i: F.col("d")[i] < 0)["frame_idx"]).alias("frame_idx")
    )


def _cover_in_rounds(centers: DataFrame, budget: int) -> DataFrame:
    """Farthest-point picks of all rooms at once.

    `_d` is a frame's distance to the nearest pick so far, and below zero for a pick. A round
    reads it for the next pick of every room and writes it anew, so its cost does not grow
    with the picks already made.
    """
    here = [F.col(c) for c in "xyz"]
    rank = F.struct(F.col("_d"), -F.col("frame_idx"))
    means = durable(centers.groupBy("room").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"]))
    away = g.distance3(here, [F.col(f"m{c}") for c in "xyz"])
    now = lookup_join(centers, means, ROOM).select("room", "frame_idx", *"xyz", (-away).alias("_d"))
    picks = None
    for round_ in range(budget):
        best = durable(
            now.where(F.col("_d") >= 0 if round_ else F.lit(True)).groupBy("room")
            .agg(F.max_by(F.struct("frame_idx", *"xyz"), rank).alias("_p")).select("room", "_p.*")
        )
        if best.isEmpty():
            break
        chosen = best.select("room", "frame_idx")
        picks = chosen if picks is None else picks.unionByName(chosen)
        pick = best.select("room", F.col("frame_idx").alias("_f"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
        gap = g.distance3(here, [F.col(f"p{c}") for c in "xyz"])
        nearer = gap if round_ == 0 else F.least("_d", gap)
        after = durable(
            lookup_join(now, pick, ROOM).select(
                "room", "frame_idx", *"xyz",
                F.when((F.col("frame_idx") == F.col("_f")) | ((F.col("_d") < 0) & F.lit(round_ > 0)), -1.0)
                .otherwise(nearer).alias("_d"),
            )
        )
        if round_:
            discard(now)
        now = after
    return picks


def covering_frames(cameras: DataFrame, budget: int, *, array_frames: int = ARRAY_FRAMES) -> DataFrame:
    """`(room, frame_idx)` of frames spread over the camera positions.

    Starts at the camera nearest the mean, then repeatedly takes the farthest one from
    those taken (lowest index on ties). Rooms within the budget keep every frame; rooms
    with a non-finite position are strided evenly. Frame numbers run 0..n-1. Paths longer than
    `array_frames` are picked in rounds over all rows, with the same result.
    """
    # One short row per frame, read by every branch and round below.
    centers = durable(
        cameras.select("room", "frame_idx", *[c.cast("double").alias(n) for c, n in zip(g.camera_center("pose"), "xyz")])
    )
    ok = finite(F.col("x"), F.col("y"), F.col("z"))
    sizes = durable(
        centers.groupBy("room").agg(F.count(F.lit(1)).alias("_n"), F.bool_and(ok).alias("_ok"))
    )
    marked = lookup_join(centers, sizes, ROOM)
    whole = marked.where(F.col("_n") <= budget)
    strided = marked.where(
        (F.col("_n") > budget) & ~F.col("_ok")
        # The first frame of each of `budget` even windows over the whole path.
        & F.expr(f"frame_idx = 0 OR frame_idx * {int(budget)} div _n <> (frame_idx - 1) * {int(budget)} div _n")
    )
    out = whole.unionByName(strided).select("room", "frame_idx")
    roaming = marked.where((F.col("_n") > budget) & F.col("_ok"))
    path = ["room", "frame_idx", "x", "y", "z"]
    out = out.unionByName(_cover_in_arrays(roaming.where(F.col("_n") <= array_frames).select(*path), budget))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= array_frames:
        return out
    picked = _cover_in_rounds(roaming.where(F.col("_n") > array_frames).select(*path), budget)
    return out if picked is None else out.unionByName(picked)


def spare_frames(frames: DataFrame, chosen: DataFrame) -> DataFrame:
    """Frames of the same rooms that were not chosen."""
    return frames.join(chosen.select("room", "frame_idx"), ["room", "frame_idx"], "left_anti")
