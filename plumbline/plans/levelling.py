"""Level every geometry table of a store in one step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import level
from ..session import durable
from ..sources.store import SceneStore

IDENTITY = ("frame_idx", "v", "u")


@dataclass(frozen=True)
class LevelResult:
    records: DataFrame
    tables: list[str]
    version: int


def level_tables(
    points: DataFrame, cameras: DataFrame, *, up: str | None = None, previous: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """`(records, transforms)` per room from its confident points and cameras."""
    confident = points.where("conf")
    estimates = level.forced_up(confident, up) if up else level.estimate_up(confident, cameras, IDENTITY)
    estimates = durable(estimates)
    transforms = durable(level.levelling_transforms(estimates, confident))
    return durable(level.level_records(estimates, transforms, previous)), transforms


def level_store(store: SceneStore, *, up: str | None = None) -> LevelResult:
    """Rewrite points, cameras, objects and observations so that +Y is up.

    All tables move to one new version together with the level record; running it again
    composes the transforms.
    """
    present = store.tables()
    if "points" not in present:
        raise FileNotFoundError(f"no points in {store.base}; reconstruct first")
    points, cameras = store.read("points"), store.read("cameras")
    previous = store.read("level").select("room", "cumulative") if "level" in present else None
    records, transforms = level_tables(points, cameras, up=up, previous=previous)
    out = {"points": level.move_points(points, transforms), "cameras": level.move_cameras(cameras, transforms)}
    for name in ("objects", "observations"):
        if name in present:
            moved = level.move_records(store.read(name), transforms)
            out[name] = moved.withColumn("frame", F.lit("y_up_floor_at_zero"))
    out["level"] = records
    return LevelResult(records, sorted(out), store.write(out))
