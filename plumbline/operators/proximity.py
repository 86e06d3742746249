"""Spatial joins without pair listings: any overlapping member, and the nearest centre in reach."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as lab
from ..session import discard, durable, lookup_join

ROOM = ["room"]
AXES = ("x", "y", "z")
# Members of one grid cell that a task meets with the cell's probes; more are dealt to several tasks.
CELL_ROWS = 4_096
# Members of a room and label class up to which no grid is drawn: all are compared with each probe.
WHOLE_ROWS = 64
# Centres that the fullest cell of the first round may hold, and how often cells are halved for it.
CELL_CENTRES, HALVINGS = 64, 12


def _boxes(rows: DataFrame, groups: Mapping[str, str] | None, columns: Sequence[str]) -> DataFrame:
    name, found = lab.normalize("label"), F.col("name")
    return rows.select(*columns, name.alias("name"), g.envelope("obb").alias("e")).select(
        *columns, "name", F.coalesce(lab.lookup(lab.merge_classes(groups), found), found).alias("label_class"),
        lab.lookup(lab.BUILTIN, found).alias("static"), *([lab.lookup(dict(groups), found).alias("known")] if groups else []),
        *[F.col(f"e.{side}")[i].alias(f"{side}{i}") for side in ("lo", "hi") for i in range(3)],
    )


def _meets(p: str, m: str, groups: Mapping[str, str] | None, min_iou: float) -> Column:
    """`labels.compatible` and `geometry.envelope_iou` of two tables with the columns of `_boxes`."""

    def both(column: str) -> tuple[Column, Column]:
        return F.col(f"{p}.{column}"), F.col(f"{m}.{column}")

    (a, b), (name_a, name_b) = both("static"), both("name")
    static, same = F.coalesce(a == b, F.lit(False)), name_a == name_b
    if groups:
        a, b = both("known")
        named = F.when(same, True).when(a.isNotNull() & b.isNotNull(), a == b).otherwise(static)
    else:
        named = same | static

    def product(parts: Sequence[Column]) -> Column:
        return parts[0] * parts[1] * parts[2]

    los, his = [both(f"lo{i}") for i in range(3)], [both(f"hi{i}") for i in range(3)]
    shared = product([F.greatest(F.least(*hi) - F.greatest(*lo), F.lit(0.0)) for lo, hi in zip(los, his)])
    volume = [product([F.greatest(hi[k] - lo[k], F.lit(1e-9)) for lo, hi in zip(los, his)]) for k in range(2)]
    union = volume[0] + volume[1] - shared
    return named & (F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0)) >= min_iou)


def _in_cells(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each grid cell that a box touches; no box is longer than a cell, so at most eight."""
    out = lookup_join(boxes, sizes, [*ROOM, "label_class"])
    for i in range(3):
        ends = [F.floor(F.col(f"{side}{i}") / F.col("side")) for side in ("lo", "hi")]
        out = out.withColumn(f"g{i}", F.explode(F.sequence(*ends)))
    return out


def _met_in_cells(left: DataFrame, right: DataFrame, carry: Sequence[str], met: Column, cell_rows: int) -> DataFrame:
    """Pairs `(room, id, carry, cluster)` of boxes that meet in a cell of the grid of their room and class."""
    right = right.distinct()
    longest = F.greatest(*[F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(3)], F.lit(1e-6))
    keys = [*ROOM, "label_class"]
    spans = left.groupBy(*keys).agg(F.max(longest).alias("side")).unionByName(right.groupBy(*keys).agg(F.max(longest).alias("side")))
    sizes = durable(spans.groupBy(*keys).agg(F.max("side").alias("side")))
    cell = [*keys, "g0", "g1", "g2"]
    held, asked = _in_cells(right, sizes), _in_cells(left, sizes).drop("side")
    full = durable(held.groupBy(*cell).count().where(F.col("count") > cell_rows).select(*cell, F.ceil(F.col("count") / cell_rows).cast("int").alias("deals")))
    if full.isEmpty():
        held, asked = (t.withColumn("deal", F.lit(0)) for t in (held, asked))
    else:
        deals = F.coalesce("deals", F.lit(1))
        corner = [f"{side}{i}" for side in ("lo", "hi") for i in range(3)]
        held = lookup_join(held, full, cell, "left").withColumn("deal", F.pmod(F.xxhash64("cluster", *corner), deals).cast("int")).drop("deals")
        asked = lookup_join(asked, full, cell, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    for i in range(3):
        met = (F.floor(F.greatest(F.col(f"p.lo{i}"), F.col(f"m.lo{i}")) / F.col("m.side")) == F.col(f"m.g{i}")) & met
    same = [F.col(f"p.{c}") == F.col(f"m.{c}") for c in (*cell, "deal")]
    return asked.alias("p").join(held.alias("m"), [*same, met]).select("p.room", "p.id", *[f"p.{c}" for c in carry], "m.cluster")


def any_member(
    probes: DataFrame,
    members: DataFrame,
    *,
    min_iou: float = 0.10,
    groups: Mapping[str, str] | None = None,
    carry: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
    whole_rows: int = WHOLE_ROWS,
) -> DataFrame:
    """`(room, id, carry, cluster)`: clusters with a member whose label and box meet those of the probe.

    `probes` has `(room, id, label, obb)` and the `carry` columns, `members` has `(room,
    cluster, label, obb)`. Labels meet as `labels.compatible` says, boxes where their
    envelopes have at least `min_iou` (above zero) in common. Rows with a null label or box
    meet nothing, equal members of a cluster are one, and each pair of probe and cluster is
    one row, however many members agree.

    A probe meets all members of its room and label class where they are at most
    `whole_rows`. Otherwise boxes are cut to the cells of a grid as wide as the longest box of
    the room and class, and meet in the cell where their overlap begins. The members of a full
    cell are dealt to several groups, each of which meets a copy of the cell's probes.
    """
    solid = F.col("lo0").isNotNull() & F.col("label_class").isNotNull()
    left = _boxes(probes, groups, [*ROOM, "id", *carry]).where(solid)
    right = _boxes(members, groups, [*ROOM, "cluster"]).where(solid)
    keys = [*ROOM, "label_class"]
    crowded = durable(right.groupBy(*keys).count().where(F.col("count") > whole_rows).select(*keys))
    met = _meets("p", "m", groups, min_iou)
    few, small = left, right
    if dense := not crowded.isEmpty():
        few, small = (lookup_join(t, crowded, keys, "left_anti") for t in (left, right))
    same = [F.col(f"p.{c}") == F.col(f"m.{c}") for c in keys]
    # Members could be few enough to be broadcast, and the pairs would be left to the few tasks that read the probes.
    found = few.alias("p").join(small.alias("m").hint("merge"), [*same, met]).select("p.room", "p.id", *[f"p.{c}" for c in carry], "m.cluster")
    if dense:
        left, right = (lookup_join(t, crowded, keys, "left_semi") for t in (left, right))
        found = found.unionByName(_met_in_cells(left, right, carry, met, cell_rows))
    return found.distinct()


def nearest(
    probes: DataFrame,
    centres: DataFrame,
    radius: float,
    *,
    keys: Sequence[str] = ROOM,
    cell_centres: int = CELL_CENTRES,
) -> DataFrame:
    """`(keys, id, centre, distance)`: the nearest centre of each probe within `radius`, ties by the least centre.

    `probes` has `(keys, id, x, y, z)` with ids that are unique within the keys, `centres` has
    `(keys, centre, x, y, z)`. Probes without a centre in reach have no row, nor have rows
    with a coordinate that is no finite number. Centres at one place are one.

    A round looks at the cell of a probe and the ring of cells around it. A probe is done
    once its best centre is no farther than the width of a cell, as everything beyond the
    ring is; the others go on with cells of twice the width, up to the radius. The first
    width is the largest at which the fullest cell holds `cell_centres`, so that dense places
    are searched in small cells. Only the best centre of a probe leaves a join.
    """
    finite = [~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf")) for c in AXES]
    keys = list(keys)

    def placed(rows: DataFrame, ident: str) -> DataFrame:
        out = rows.select(*keys, ident, *[F.col(c).cast("double").alias(c) for c in AXES])
        return out.where(finite[0] & finite[1] & finite[2])

    held = durable(placed(centres, "centre").groupBy(*keys, *AXES).agg(F.min("centre").alias("centre")))
    todo = durable(placed(probes, "id"))

    def cells(width: float) -> list[Column]:
        return [F.floor(F.col(c) / width).alias(f"g{c}") for c in AXES]

    halved = 0
    while halved < HALVINGS:
        fullest = held.groupBy(*keys, *cells(radius / 2**halved)).count().agg(F.max("count")).first()[0] or 0
        if fullest <= cell_centres:
            break
        halved += 1
    found = None
    ring = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for level in range(halved, -1, -1):
        width = radius / 2**level
        near = held.select(*keys, "centre", *[F.col(c).alias(f"c{c}") for c in AXES], *cells(width))
        around = todo.select(*keys, "id", *AXES, *cells(width))
        for c in AXES:
            around = around.withColumn(f"_{c}", F.explode(ring)).withColumn(f"g{c}", F.col(f"g{c}") + F.col(f"_{c}")).drop(f"_{c}")
        distance = g.distance3([F.col(c) for c in AXES], [F.col(f"c{c}") for c in AXES])
        pairs = around.join(near, [*keys, *[f"g{c}" for c in AXES]]).withColumn("distance", distance).where(F.col("distance") <= radius)
        best = durable(pairs.groupBy(*keys, "id").agg(F.min(F.struct("distance", "centre")).alias("b")).select(*keys, "id", "b.*"))
        final = best if level == 0 else best.where(F.col("distance") <= width)
        found = final if found is None else found.unionByName(final)
        if level:
            left = durable(todo.join(final.select(*keys, "id"), [*keys, "id"], "left_anti"))
            discard(todo)
            todo = left
            if todo.isEmpty():
                break
    return found.select(*keys, "id", "centre", "distance")
