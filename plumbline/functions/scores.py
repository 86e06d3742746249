"""Confidence scores and run-time estimates as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import as_col


def unit_clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def object_confidence(n: Column, mean_vlm: Column, spread: Column, radius: Column) -> Column:
    """How often seen, how sure the detector was, how tightly the sightings agree."""
    seen = F.lit(1.0) - F.exp(-n / 2.0)
    sure = F.greatest(mean_vlm, F.lit(1e-6))
    tight = F.exp(-spread / F.greatest(radius, F.lit(1e-6)))
    return unit_clip(F.pow(seen, F.lit(0.35)) * F.pow(sure, F.lit(0.40)) * F.pow(tight, F.lit(0.25)))


def merge_radius(mean_diagonal: Column, floor: float, scale: float) -> Column:
    return F.greatest(F.lit(float(floor)), F.lit(float(scale)) * F.coalesce(mean_diagonal, F.lit(0.0)))


def pose_score(tilt_deg: Column) -> Column:
    return unit_clip(F.lit(1.0) - tilt_deg / 60.0)


def up_score(tilt_deg: Column, inlier_frac: Column, agreement_deg: Column) -> Column:
    """Geometric mean of pose steadiness, floor support and their agreement."""
    floor = unit_clip(inlier_frac / 0.35)
    agree = unit_clip(F.lit(1.0) - agreement_deg / 30.0)
    return F.pow(pose_score(tilt_deg) * floor * agree, F.lit(1.0 / 3.0))


# Degrees of snapping beyond which an axis-aligned plan is worthless.
MAX_SNAP_DEG = 20.0


def snap_report(up: Column | str, confidence: Column) -> Column:
    """Nearest axis to an up vector, its sign, and the confidence scaled by the snap."""
    up = as_col(up)
    size = [F.abs(up[i]) for i in range(3)]
    axis = (
        F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0)
        .when(size[1] >= size[2], 1)
        .otherwise(2)
    )
    along = F.element_at(up, axis + 1)
    snap = F.degrees(F.acos(unit_clip(F.abs(along))))
    sign = F.when(along < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    penalty = unit_clip(F.lit(1.0) - snap / MAX_SNAP_DEG)
    levelled = (snap < 1.0) & (axis == 1) & (sign > 0)
    return F.struct(
        axis.alias("axis"), sign.alias("sign"), F.round(snap, 1).alias("snap_deg"),
        F.round(confidence * penalty, 3).alias("confidence"), levelled.alias("levelled"),
        penalty.alias("penalty"),
    )


def run_minutes(n_frames: Column, n_pairs: Column) -> Column:
    """Expected minutes of a reconstruction: 13.5 s per pair, half a minute per frame."""
    return n_pairs * 13.5 / 60.0 + n_frames * 0.5


def swin_pair_count(n: Column, window: int) -> Column:
    """Ordered pairs of the sliding-window graph, in closed form."""
    k = int(window)
    n = n.cast("bigint")
    full = (n - k) * (2 * k) + k * (k - 1)
    return F.when(n > k, full).otherwise(n * (n - 1)).cast("bigint")


def complete_pair_count(n: Column) -> Column:
    return (n.cast("bigint") * (n.cast("bigint") - 1)).cast("bigint")


def object_hue(position: Column) -> Column:
    """Display hue of the i-th object."""
    return F.pmod(position * 47, F.lit(360)).cast("int")
