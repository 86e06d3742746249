"""Lift 2D detections to 3D observations from per-pixel world points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import durable, fits_broadcast
from .boxes import oriented_boxes
from .islands import dominant_run, value_runs
from .quantiles import exact_quantiles, finite

# Side of the square image tiles that spread one frame over several join partitions.
TILE = 64

BOX = ("x0", "y0", "x1", "y1")
SEARCH = ("sx0", "sy0", "sx1", "sy1")
FRAME = ("room", "frame_idx")
DETECTION = ("room", "frame_idx", "det_id")


def detection_boxes(detections: DataFrame, cameras: DataFrame, erode_px: int) -> DataFrame:
    """Pixel box, eroded search box, requested pixel count and camera centre per detection.

    `cameras` carries `pose`, `h` and `w` per frame.
    """
    frames = cameras.select(*FRAME, "h", "w", F.array(*g.camera_center("pose")).alias("eye"))
    placed = detections.join(frames, list(FRAME))
    boxed = placed.withColumns(g.descale_box("box_2d", F.col("h"), F.col("w")))
    eroded = boxed.withColumns(g.erode_box(erode_px, F.col("h"), F.col("w")))
    return eroded.withColumn("n_requested", g.box_area(*BOX))


def _usable(points: DataFrame) -> DataFrame:
    return points.where(F.col("conf") & finite(F.col("x"), F.col("y"), F.col("z"))).select(
        *FRAME, "u", "v", *[F.col(c).cast("double").alias(c) for c in "xyz"]
    )


def _pixels_in_boxes(points: DataFrame, boxes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Range join pixels to boxes.

    Few boxes are broadcast by frame. Otherwise both sides meet on frame and image tile,
    which spreads the pixels of one frame over several partitions; a box is copied to
    the tiles it touches, a pixel is never copied.
    """
    pixels, wanted = _usable(points), boxes.select(*DETECTION, *SEARCH, *carry)
    if fits_broadcast(wanted):
        return pixels.join(F.broadcast(wanted), list(FRAME)).where(g.in_box("u", "v", SEARCH))
    tile = lambda c: F.floor(c / TILE).cast("int")
    tiled = wanted.withColumn(
        "_tv", F.explode(F.sequence(tile(F.col("sy0")), tile(F.col("sy1") - 1)))
    ).withColumn("_tu", F.explode(F.sequence(tile(F.col("sx0")), tile(F.col("sx1") - 1))))
    pixels = pixels.withColumn("_tv", tile(F.col("v"))).withColumn("_tu", tile(F.col("u")))
    return pixels.join(tiled, [*FRAME, "_tv", "_tu"]).where(g.in_box("u", "v", SEARCH))


def _pixels_in_masks(
    points: DataFrame, boxes: DataFrame, masks: DataFrame, carry: Sequence[str]
) -> DataFrame:
    """Equi-join pixels to mask pixels `(room, frame_idx, det_id, v, u)`."""
    wanted = masks.join(boxes.select(*DETECTION, *carry), list(DETECTION))
    return _usable(points).join(wanted, [*FRAME, "v", "u"])


def lift(
    points: DataFrame,
    cameras: DataFrame,
    detections: DataFrame,
    *,
    erode_px: int = 3,
    depth_eps: float = 0.15,
    min_points: int = 40,
    masks: DataFrame | None = None,
    with_box: bool = True,
) -> DataFrame:
    """One observation per detection that enough confident geometry supports.

    The pixels of a detection are split into depth runs, the largest run (nearest on a
    tie) is kept, and its median is the centroid. The support guard needs to look only
    at the kept run: it is the last and smallest of the three counts it bounds. Given
    `masks` (already eroded, with `n_requested` per detection in `detections`), pixels
    come from them instead of from boxes.
    """
    # One row per detection, far smaller than the pixels; several passes read it.
    boxes = durable(detection_boxes(detections, cameras, erode_px))
    if masks is not None:
        boxes = boxes.drop("n_requested").join(
            masks.groupBy(*DETECTION).agg(F.max("n_requested").alias("n_requested")), list(DETECTION)
        )
        masks = masks.select(*DETECTION, "v", "u")

    def pixels(table: DataFrame, carry: Sequence[str]) -> DataFrame:
        if masks is None:
            met = _pixels_in_boxes(points, table, carry)
        else:
            met = _pixels_in_masks(points, table, masks, carry)
        return met.withColumn("depth", g.distance3([F.col(c) for c in "xyz"], g.vec("eye")))

    runs = value_runs(pixels(boxes, ["eye"]), DETECTION, "depth", depth_eps)
    kept = durable(
        dominant_run(runs, DETECTION).where(F.col("n") >= min_points)
        .join(boxes, list(DETECTION))
        .select(
            *DETECTION, "label", F.col("confidence").alias("vlm_confidence"), *BOX, *SEARCH, "eye",
            F.col("n").alias("n_points"), "lo", "hi",
            (F.col("n") / F.col("n_requested")).alias("support"),
        )
    )
    # The chosen depth range rides along with the box, so no pixel is shuffled by detection.
    members = pixels(kept, ["eye", "lo", "hi"]).where(F.col("depth").between(F.col("lo"), F.col("hi")))
    centroids = exact_quantiles(
        members, DETECTION, {"cx": ("x", 0.5), "cy": ("y", 0.5), "cz": ("z", 0.5)},
        largest=kept.agg(F.max("n_points")).first()[0] or 0,
    )
    result = kept.join(centroids, list(DETECTION)).withColumn("centroid", F.array("cx", "cy", "cz"))
    columns = [
        *DETECTION, "label", "vlm_confidence", "centroid", "n_points", "support",
        F.array(*BOX).alias("box_px"),
    ]
    if with_box:
        fitted = oriented_boxes(members, DETECTION).select(*DETECTION, "obb")
        result, columns = result.join(fitted, list(DETECTION)), [*columns, "obb"]
    return result.select(*columns)
