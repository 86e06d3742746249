"""Merge repeated sightings into unique labelled objects.

The merge is greedy and depends on order, so it cannot be an aggregate. It can be cut
into blocks that never influence each other: a sighting only joins a cluster of a
compatible label whose mean lies within the largest possible merge radius, and the mean
of a cluster stays between its members on every axis. Hence no cluster ever spans a gap
wider than that radius on any axis, and each combination of label class and per-axis
gap-free runs is an independent block. Blocks are found with aggregates, processed as
sorted streams, and everything after the assignment is again relational.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as lab
from ..functions import scores
from ..functions.text import object_id
from ..session import BROADCAST_ROWS, durable, lookup_join, spread
from .boxes import fitted_extent, moment_aggregates, span_aggregates, with_axes
from .islands import _cells, value_runs
from .quantiles import exact_quantiles
from .sequences import row_numbers

ROOM = ["room"]
OBJECT = ["room", "seed"]
_CENTER = ("c0", "c1", "c2")
_BLOCK = ["room", "label_class", "_bx", "_by", "_bz"]


def _prepared(observations: DataFrame, groups: Mapping[str, str] | None) -> DataFrame:
    """Flat sighting columns: position, box diagonal and envelope, label names."""
    classes = lab.merge_classes(groups)
    name = lab.normalize("label")
    flat = observations.select(
        "room", "id", "frame_idx", "n_points", "vlm_confidence", "obb", name.alias("name"),
        *[F.col("centroid")[i].cast("double").alias(f"c{i}") for i in range(3)],
        g.diagonal("obb.extent").alias("diag"), g.envelope("obb").alias("_env"),
    )
    return flat.select(
        *[c for c in flat.columns if c != "_env"],
        *[F.col("_env.lo")[i].alias(f"lo{i}") for i in range(3)],
        *[F.col("_env.hi")[i].alias(f"hi{i}") for i in range(3)],
        F.coalesce(lab.lookup(classes, F.col("name")), F.col("name")).alias("label_class"),
        lab.lookup(dict(groups or {}), F.col("name")).alias("known"),
    )


def _with_blocks(flat: DataFrame, floor: float, scale: float, split_above: int) -> DataFrame:
    """Add the run ids that delimit independent blocks.

    Label classes of a room are blocks already. Only where one of them holds more than
    `split_above` sightings are they cut further at the gaps of each axis.
    """
    keys = ["room", "label_class"]
    none = [F.lit(0).cast("bigint").alias(f"_b{axis}") for axis in "xyz"]
    sizes = flat.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("diag").alias("_diag"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= split_above:
        return flat.select("*", *none)
    reach = durable(
        sizes.select(*keys, "_n", F.greatest(F.lit(float(floor)), F.lit(float(scale)) * F.col("_diag")).alias("_reach"))
    )
    base = lookup_join(flat, reach, keys)
    large = durable(base.where(F.col("_n") > split_above))
    out = large
    for axis, column in zip("xyz", ("c0", "c1", "c2")):
        runs = value_runs(large, [*keys, "_reach"], column, F.col("_reach"), by_cell=True)
        out = (
            out.withColumn("_cell", _cells(F.col(column), F.col("_reach")))
            .join(runs.select(*keys, "_cell", F.col("run").alias(f"_b{axis}")), [*keys, "_cell"])
            .drop("_cell")
        )
    small = base.where(F.col("_n") <= split_above).select("*", *none)
    return out.unionByName(small).drop("_reach", "_n")


# Clusters of a block, and boxes of a cluster, that are looked through as plain numbers. Where there
# are more, arrays mirror them: for a few rows, calls on arrays cost far more than the sums.
FEW = 32


class _Mirror:
    """Rows of numbers in one array, which doubles when full."""

    def __init__(self, rows: Sequence[Sequence[float]]):
        self.size = len(rows)
        self.data = np.empty((2 * self.size, len(rows[0])))
        self.data[:self.size] = rows

    def append(self, row: Sequence[float]) -> None:
        if self.size == len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.size] = row
        self.size += 1

    @property
    def rows(self) -> np.ndarray:
        return self.data[:self.size]


class _Clusters:
    """Running state of one block: sums per cluster plus the boxes of its members."""

    def __init__(self, floor: float, scale: float, min_iou: float, may_meet, few: int = FEW):
        self.floor, self.scale, self.min_iou, self.may_meet, self.few = floor, scale, min_iou, may_meet, few
        self.sums: list[list[float]] = []  # x, y, z, members, sum and number of diagonals above zero
        self.wide: _Mirror | None = None
        self.seeds: list[int] = []
        self.names: list[set] = []
        self.boxes: list[list[tuple]] = []  # lo, hi, volume
        self.stacks: dict[int, _Mirror] = {}

    def _near(self, x: float, y: float, z: float, diag: float) -> list[tuple[float, int, float]]:
        """Distance, cluster and radius where the cluster is in reach, the nearest first."""
        plus, one = (diag, 1.0) if diag > 0 else (0.0, 0.0)
        if self.wide is None:
            near = []
            for j, (sx, sy, sz, count, sized, n) in enumerate(self.sums):
                a, b, c = sx / count - x, sy / count - y, sz / count - z
                distance = math.sqrt(a * a + b * b + c * c)
                radius = max(self.floor, self.scale * (sized + plus) / max(n + one, 1.0))
                if distance <= radius:
                    near.append((distance, j, radius))
            return sorted(near)
        rows = self.wide.rows
        distance = np.linalg.norm(rows[:, :3] / rows[:, 3:4] - (x, y, z), axis=1)
        radius = np.maximum(self.floor, self.scale * (rows[:, 4] + plus) / np.maximum(rows[:, 5] + one, 1.0))
        near = np.flatnonzero(distance <= radius)
        near = near[np.argsort(distance[near], kind="stable")]
        return list(zip(distance[near].tolist(), near.tolist(), radius[near].tolist()))

    def _overlaps(self, cluster: int, box: tuple | None) -> bool:
        if self.min_iou <= 0:
            return True
        if box is None:
            return False
        x0, y0, z0, x1, y1, z1, own = box
        if cluster in self.stacks:
            members = self.stacks[cluster].rows
            side = np.minimum(members[:, 3:6], box[3:6]) - np.maximum(members[:, :3], box[:3])
            shared = np.prod(np.clip(side, 0.0, None), axis=1)
            union = members[:, 6] + own - shared
            iou = np.where((shared > 0) & (union > 0), shared / np.where(union > 0, union, 1.0), 0.0)
            return bool((iou >= self.min_iou).any())
        for a0, b0, c0, a1, b1, c1, volume in self.boxes[cluster]:
            a, b, c = min(a1, x1) - max(a0, x0), min(b1, y1) - max(b0, y0), min(c1, z1) - max(c0, z0)
            if a > 0 and b > 0 and c > 0:
                shared = a * b * c
                union = volume + own - shared
                if shared > 0 and union > 0 and shared / union >= self.min_iou:
                    return True
        return False

    def _add(self, target: int, x: float, y: float, z: float, diag: float, box: tuple | None) -> None:
        total = self.sums[target]
        total[0] += x
        total[1] += y
        total[2] += z
        total[3] += 1.0
        if diag > 0:
            total[4] += diag
            total[5] += 1.0
        if self.wide is not None:
            if target == self.wide.size:
                self.wide.append(total)
            else:
                self.wide.data[target] = total
        elif len(self.sums) > self.few:
            self.wide = _Mirror(self.sums)
        if box is not None:
            held = self.boxes[target]
            held.append(box)
            if target in self.stacks:
                self.stacks[target].append(box)
            elif len(held) > self.few:
                self.stacks[target] = _Mirror(held)

    def place(self, ident: int, name, x: float, y: float, z: float, diag: float, *corners: float) -> int:
        """Add one sighting; returns the id of the sighting that founded its cluster."""
        x0, y0, z0, x1, y1, z1 = corners
        volume = max(x1 - x0, 1e-9) * max(y1 - y0, 1e-9) * max(z1 - z0, 1e-9)
        # A box with a corner that is no number overlaps nothing.
        box = (*corners, volume) if volume == volume else None
        target = -1
        for distance, j, radius in self._near(x, y, z, diag):
            if not any(self.may_meet(name, other) for other in self.names[j]):
                continue
            if distance <= 0.5 * radius or self._overlaps(j, box):
                target = j
                break
        if target < 0:
            target = len(self.seeds)
            self.seeds.append(ident)
            self.names.append(set())
            self.boxes.append([])
            self.sums.append([0.0] * 6)
        self.names[target].add(name)
        self._add(target, x, y, z, diag, box)
        return self.seeds[target]


def _assigner(floor: float, scale: float, min_iou: float, groups: Mapping[str, str] | None, predicate):
    """Stream kernel over partitions sorted by block and merge order."""
    known = dict(groups or {})
    builtin = lab.BUILTIN

    def may_meet(a: str, b: str) -> bool:
        if a == b:
            return True
        ka, kb = known.get(a), known.get(b)
        if ka is not None and kb is not None:
            return ka == kb
        return a in builtin and builtin[a] == builtin.get(b)

    meet = predicate or may_meet
    numeric = ["c0", "c1", "c2", "diag", "lo0", "lo1", "lo2", "hi0", "hi1", "hi2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, state = None, None
        for batch in batches:
            values = batch[numeric].to_numpy(float).tolist()
            ids = batch["id"].to_numpy()
            blocks = zip(*[batch[c].tolist() for c in _BLOCK])
            seeds = np.empty(len(batch), dtype="int64")
            for i, (at, ident, name, row) in enumerate(zip(blocks, ids.tolist(), batch["name"].tolist(), values)):
                if at != block:
                    block, state = at, _Clusters(floor, scale, min_iou, meet)
                seeds[i] = state.place(int(ident), name, *row)
            yield pd.DataFrame({"room": batch["room"], "id": ids, "seed": seeds})

    return run


# Label classes up to this many sightings go to the merge kernel as one block.
SPLIT_ABOVE = 5_000


def _assign(
    flat: DataFrame,
    floor: float,
    scale: float,
    min_iou: float,
    groups: Mapping[str, str] | None,
    predicate: Callable[[str, str], bool] | None,
    split_above: int,
) -> DataFrame:
    blocked = _with_blocks(flat, floor, scale, split_above)
    ordered = (
        spread(blocked.withColumn("_rank", -F.col("n_points")), *_BLOCK)
        .sortWithinPartitions(*_BLOCK, "_rank", "frame_idx", "id")
    )
    room_type = dict(flat.dtypes)["room"]
    kernel = _assigner(floor, scale, min_iou, groups, predicate)
    return ordered.select(
        *_BLOCK, "id", "name", "c0", "c1", "c2", "diag", *[f"lo{i}" for i in range(3)], *[f"hi{i}" for i in range(3)]
    ).mapInPandas(kernel, f"room {room_type}, id bigint, seed bigint")


def _first_widest() -> Column:
    order = F.struct(F.col("diag"), F.col("n_points"), -F.col("frame_idx"), -F.col("id"))
    return F.max_by(F.col("obb"), order)


def fuse(
    observations: DataFrame,
    *,
    radius_floor: float = 0.30,
    radius_scale: float = 0.50,
    min_obb_iou: float = 0.10,
    groups: Mapping[str, str] | None = None,
    predicate: Callable[[str, str], bool] | None = None,
    min_confidence: float = 0.0,
    min_observations: int = 1,
    split_above: int = SPLIT_ABOVE,
) -> tuple[DataFrame, DataFrame]:
    """Objects and the membership relation `(room, object_id, id, frame_idx)`.

    Sightings are taken by falling `n_points`, then frame, then id. `groups` maps labels
    to canonical names where a resolver supplied them; `predicate` replaces the label
    test altogether.

    The confidence and count filters act on finished objects, never on sightings, and
    leave the numbering as it was.
    """
    flat = _prepared(observations, groups)
    if predicate is not None:
        flat = flat.withColumn("label_class", F.lit(""))
    flat = durable(flat)
    placed = _assign(flat, radius_floor, radius_scale, min_obb_iou, groups, predicate, split_above)
    members = durable(
        flat.join(placed, ["room", "id"]).select(
            *OBJECT, "id", "frame_idx", "n_points", "vlm_confidence", "obb", "name", "known", "diag", *_CENTER
        )
    )
    founder = F.col("id") == F.col("seed")
    basics = durable(
        with_axes(
            members.groupBy(*OBJECT).agg(
                F.count(F.lit(1)).alias("n_observations"),
                F.avg(F.when(F.col("diag") > 0, F.col("diag"))).alias("mean_diag"),
                F.avg("vlm_confidence").alias("mean_vlm"),
                _first_widest().alias("widest"),
                F.max(F.when(founder, F.col("n_points"))).alias("seed_points"),
                F.max(F.when(founder, F.col("frame_idx"))).alias("seed_frame"),
                *moment_aggregates(_CENTER),
            )
        )
    )
    count, largest = basics.agg(F.count(F.lit(1)), F.coalesce(F.max("n_observations"), F.lit(0))).first()
    shape = basics.select(*OBJECT, "mean", "axes")
    shape = F.broadcast(shape) if count <= BROADCAST_ROWS else shape
    located = members.select(*OBJECT, *_CENTER).join(shape, OBJECT)
    offset = g.distance3([F.col(c) for c in _CENTER], g.vec("mean"))
    shapes = located.groupBy(*OBJECT).agg(F.avg(offset).alias("spread"), *span_aggregates(_CENTER))
    centroids = exact_quantiles(
        members, OBJECT, {f"q{i}": (c, 0.5) for i, c in enumerate(_CENTER)}, largest=largest
    )
    names = lab.pick_labels(members, OBJECT, "name", mapped=F.col("known") if groups else None)
    wide = F.col("widest")
    grown = F.struct(
        F.col("mean").alias("center"),
        F.array(*[F.greatest(fitted_extent()[i], wide["extent"][i]) for i in range(3)]).alias("extent"),
        wide["R"].alias("R"),
    )
    radius = scores.merge_radius(F.col("mean_diag"), radius_floor, radius_scale)
    built = (
        basics.join(shapes, OBJECT).join(centroids, OBJECT).join(names, OBJECT)
        .select(
            *OBJECT, "label", "aliases", F.array("q0", "q1", "q2").alias("centroid"),
            F.when(F.col("n_observations") >= 3, grown)
            .otherwise(F.struct(wide["center"].alias("center"), wide["extent"].alias("extent"), wide["R"].alias("R")))
            .alias("obb"),
            scores.object_confidence(F.col("n_observations"), F.col("mean_vlm"), F.col("spread"), radius).alias("confidence"),
            "n_observations",
            (-F.col("n_observations")).alias("_o0"), (-F.col("seed_points")).alias("_o1"),
            F.col("seed_frame").alias("_o2"), F.col("seed").alias("_o3"),
        )
    )
    # Chunks of equal size and similar support follow the numbering order and stay small
    # even where a room has countless objects seen once.
    chunk = F.struct(F.col("_o0").alias("a"), F.floor(F.col("_o1") / 64).alias("b"))
    numbered = row_numbers(durable(built), ROOM, ["_o0", "_o1", "_o2", "_o3"], name="position", chunk=chunk)
    objects = numbered.withColumn("object_id", object_id("position")).where(
        (F.col("confidence") >= min_confidence) & (F.col("n_observations") >= min_observations)
    )
    owned = members.select(*OBJECT, "id", "frame_idx").join(objects.select(*OBJECT, "object_id"), OBJECT)
    keep = ["room", "object_id", "label", "aliases", "centroid", "obb", "confidence", "n_observations"]
    return objects.select(*keep), owned.select("room", "object_id", "id", "frame_idx")


def with_lists(objects: DataFrame, membership: DataFrame) -> DataFrame:
    """Add `seen_in` and `observation_ids`, the lists the document form carries."""
    key = ["room", "object_id"]
    frames = (
        membership.select(*key, "frame_idx").distinct().groupBy(*key)
        .agg(F.array_sort(F.collect_list("frame_idx")).alias("seen_in"))
    )
    ids = membership.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("observation_ids"))
    return objects.join(frames, key).join(ids, key)


def radius_summary(observations: DataFrame, keys: Sequence[str], floor: float, scale: float) -> DataFrame:
    """What the two radius knobs amount to, per key."""
    diag = g.diagonal("obb.extent")
    mean = F.coalesce(F.avg(F.when(diag > 0, diag)), F.lit(0.0))
    by_size = F.lit(float(scale)) * F.col("_mean")
    radius = F.greatest(F.lit(float(floor)), by_size)
    return observations.groupBy(*keys).agg(mean.alias("_mean")).select(
        *keys,
        F.round("_mean", 3).alias("mean_obb_diagonal"),
        F.round(radius, 3).alias("effective_radius"),
        F.round(radius * 0.5, 3).alias("merge_distance_no_overlap"),
        F.when(by_size > floor, "size").otherwise("floor").alias("driven_by"),
    )
