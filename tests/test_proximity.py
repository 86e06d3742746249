"""Spatial joins, held to comparisons of all pairs."""

import math
from itertools import product

import numpy as np
import pytest

from plumbline.operators import proximity

EYE = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
BOX = "struct<center:array<double>,extent:array<double>,R:array<array<double>>>"


def boxes(seed, n, crowd):
    """Boxes of drawn sizes and names in two rooms; a share of them crowds into one place."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        centre = rng.normal(0, 0.05, 3) if rng.random() < crowd else rng.uniform(-3, 3, 3)
        extent = rng.uniform(0.05, 1.5, 3) if i % 9 else np.zeros(3)
        out.append((f"room{i % 2}", i, str(rng.choice(["desk", "Table", "lamp", "sofa"])), centre.tolist(), extent.tolist()))
    return out


def iou(a, b):
    lo, hi = ([np.array(x[3]) + s * np.array(x[4]) / 2 for x in (a, b)] for s in (-1, 1))
    shared = np.prod(np.maximum(np.minimum(*hi) - np.maximum(*lo), 0))
    volume = [np.prod(np.maximum(h - l, 1e-9)) for l, h in zip(lo, hi)]
    return shared / (sum(volume) - shared) if shared > 0 else 0.0


@pytest.mark.parametrize("cell_rows", [proximity.CELL_ROWS, 7])
def test_any_member_equals_all_pairs(spark, cell_rows):
    asked, held = boxes(1, 90, 0.4), boxes(2, 120, 0.4)
    held += held[:40]  # repeated members
    probes = spark.createDataFrame([(r, i, n, (c, e, EYE), i % 5) for r, i, n, c, e in asked], f"room string, id long, label string, obb {BOX}, frame int")
    members = spark.createDataFrame([(r, i % 11, n, (c, e, EYE)) for r, i, n, c, e in held], f"room string, cluster int, label string, obb {BOX}")
    nulls = spark.createDataFrame([("room0", 900, None, None, 1), ("room0", 901, "lamp", None, 1)], probes.schema)
    got = proximity.any_member(probes.unionByName(nulls), members, carry=["frame"], cell_rows=cell_rows).collect()

    def meet(a, b):
        a, b = a.lower(), b.lower()
        return a == b or {a, b} == {"desk", "table"}

    want = {(p[0], p[1], p[1] % 5, m[1] % 11) for p, m in product(asked, held) if p[0] == m[0] and meet(p[2], m[2]) and iou(p, m) >= 0.10}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and want
    assert proximity.any_member(probes.limit(0), members).count() == 0
    assert proximity.any_member(probes, members.limit(0)).count() == 0


@pytest.mark.parametrize("groups", [None, {"lamp": "light", "sofa": "light"}])
def test_rooms_with_few_members_need_no_grid(spark, monkeypatch, groups):
    asked, held = boxes(3, 60, 0.4), boxes(4, 80, 0.4)
    probes = spark.createDataFrame([(r, i, n, (c, e, EYE)) for r, i, n, c, e in asked], f"room string, id long, label string, obb {BOX}")
    members = spark.createDataFrame([(r, i % 11, n, (c, e, EYE)) for r, i, n, c, e in held], f"room string, cluster int, label string, obb {BOX}")
    # In a grid, with some groups in a grid, and with none.
    got = [proximity.any_member(probes, members, groups=groups, whole_rows=n).collect() for n in (0, 12)]

    def no_grid(*_):
        raise AssertionError("a grid was drawn")

    monkeypatch.setattr(proximity, "_in_cells", no_grid)
    got.append(proximity.any_member(probes, members, groups=groups).collect())
    assert set(got[0]) == set(got[1]) == set(got[2]) and len(got[0]) == len(got[1]) == len(got[2]) > 0


@pytest.mark.parametrize("cell_centres", [proximity.CELL_CENTRES, 2])
def test_nearest_equals_all_pairs(spark, cell_centres):
    rng = np.random.default_rng(5)
    spots = [("a", int(i), *np.round(rng.uniform(-2, 2, 3), 1).tolist()) for i in range(150)]
    spots += [("a", 1000 - i, 0.5, 0.5, 0.5) for i in range(60)] + [("b", 7, 0.0, 0.0, 0.0), ("b", 8, math.nan, 0.0, 0.0)]
    asked = [("a", i, *np.round(rng.uniform(-3, 3, 3), 1).tolist()) for i in range(120)]
    asked += [("b", 500, 1.0, 0.0, 0.0), ("b", 501, 1.0000001, 0.0, 0.0), ("b", 502, None, 0.0, 0.0), ("c", 503, 0.0, 0.0, 0.0)]
    names = "room string, {} long, x double, y double, z double"
    probes, centres = spark.createDataFrame(asked, names.format("id")), spark.createDataFrame(spots, names.format("centre"))
    got = {(r["room"], r["id"]): (r["centre"], r["distance"]) for r in proximity.nearest(probes, centres, 1.0, cell_centres=cell_centres).collect()}
    want = {}
    for room, i, *at in asked:
        if None in at:
            continue
        best = min(((math.sqrt(sum((p - q) ** 2 for p, q in zip(at, spot))), c) for r, c, *spot in spots if r == room and not math.isnan(spot[0])), default=None)
        if best and best[0] <= 1.0:
            want[room, i] = (best[1], best[0])
    assert got.keys() == want.keys()
    assert all(got[k][0] == c and got[k][1] == pytest.approx(d) for k, (c, d) in want.items())
    assert proximity.nearest(probes, centres.limit(0), 1.0).count() == 0
