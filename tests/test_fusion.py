import numpy as np
import pytest

from plumbline.functions import labels as lab
from plumbline.operators import fusion

SCHEMA = (
    "room string, id bigint, frame_idx int, label string, vlm_confidence double, centroid array<double>, "
    "obb struct<center:array<double>,extent:array<double>,R:array<array<double>>>, n_points int"
)
EYE = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


def sight(frame, label, at, *, extent=(0.5, 0.5, 0.5), conf=0.9, n=500):
    at = [float(v) for v in at]
    return [frame, label, conf, at, (at, [float(e) for e in extent], EYE), n]


def table(spark, sights, room="r"):
    return spark.createDataFrame([[room, i, *s] for i, s in enumerate(sights)], SCHEMA)


FLOOR, SCALE = 0.30, 0.50
# Two names of one thing, the same name twice, names of different things.
LABEL_PAIRS = (("desk", "table"), ("lamp", "lamp"), ("lamp", "vase"))
SHARES = (0.2, 0.48, 0.52, 0.97, 1.03, 1.6)


def pairs_at_shares(seed=31, sizes=6):
    """Rooms of two sightings of drawn sizes, a share of their merge radius apart in a drawn direction."""
    rng = np.random.default_rng(seed)
    rooms = {}
    for k in range(sizes):
        extents = rng.uniform(0.05, 1.6, (2, 3))
        radius = max(FLOOR, SCALE * np.linalg.norm(extents, axis=1).mean())
        way = rng.normal(size=3)
        start, way = rng.uniform(-4, 4, 3), way / np.linalg.norm(way)
        for names in LABEL_PAIRS:
            for share in SHARES:
                rooms[f"{k} {'-'.join(names)} {share}"] = [
                    sight(i, name, start + i * share * radius * way, extent=extents[i], n=900 - i) for i, name in enumerate(names)
                ]
    return rooms


def fuse_rooms(spark, rooms, **knobs):
    rows = [[room, i, *s] for room, sights in rooms.items() for i, s in enumerate(sights)]
    objects, members = fusion.fuse(spark.createDataFrame(rows, SCHEMA), **knobs)
    found = {}
    for r in fusion.with_lists(objects, members).orderBy("room", "object_id").collect():
        found.setdefault(r["room"], []).append(r.asDict())
    return found


def parts(objects):
    return {tuple(o["observation_ids"]) for o in objects}


def test_pairs_merge_as_their_distance_and_boxes_say(spark):
    rooms = pairs_at_shares()
    found = fuse_rooms(spark, rooms)
    want = {room: plain_merge(sights, FLOOR, SCALE, 0.10) for room, sights in rooms.items()}
    assert {room: parts(objects) for room, objects in found.items()} == want
    merged = {share: sum(len(w) == 1 for room, w in want.items() if room.endswith(f" {share}")) for share in SHARES}
    assert merged[0.2] and merged[0.48] and not merged[1.03] and not merged[1.6]  # the scenes lie on both sides of the rules


def test_objects_list_frames_ids_and_names(spark):
    group = next(g for g in lab.SYNONYM_GROUPS if len(g) > 2)
    names = [group[0], *group]  # the first name has most sightings
    rooms = {"named": [sight(9 - i, name.replace(" ", "_").upper(), (2, 1, 0), n=50) for i, name in enumerate(names)]}
    only, = fuse_rooms(spark, rooms)["named"]
    assert only["object_id"] == "obj_000" and only["n_observations"] == len(names)
    assert only["observation_ids"] == list(range(len(names))) and only["seen_in"] == sorted(9 - i for i in range(len(names)))
    assert only["label"] == group[0] and only["aliases"] == sorted(group[1:])


def test_confidence_grows_with_sightings_and_falls_with_spread_and_doubt(spark):
    radius = max(FLOOR, SCALE * np.linalg.norm((0.5, 0.5, 0.5)))
    rooms = {f"{n} {apart} {conf}": [sight(i, "vase", (apart * radius * (i % 2), 0, 0), conf=conf) for i in range(n)]
             for n, apart, conf in ((1, 0, 0.8), (4, 0, 0.8), (4, 0.4, 0.8), (1, 0, 0.2))}
    single, many, spread, doubtful = (objects[0]["confidence"] for objects in (fuse_rooms(spark, rooms)[r] for r in rooms))
    assert 0 <= doubtful < single < many <= 1 and spread < many


def test_filters_come_after_merging(spark):
    rooms = pairs_at_shares(32, 2)
    found = fuse_rooms(spark, rooms, min_observations=2)
    whole = {room for room, sights in rooms.items() if len(plain_merge(sights, FLOOR, SCALE, 0.10)) == 1}
    assert set(found) == whole and all(o["object_id"] == "obj_000" for objects in found.values() for o in objects)


def test_free_predicate_and_wide_floor(spark):
    found = fuse_rooms(spark, pairs_at_shares(33, 1), predicate=lambda a, b: True, radius_floor=50.0)
    assert all(parts(objects) == {(0, 1)} for objects in found.values())


def test_resolver_groups_stand_against_built_in_ones(spark):
    known = {"qelb": "thing", "zorv": "thing", "desk": "desk", "table": "table"}
    rooms = {f"{a}-{b}": [sight(0, a, (0, 0, 0)), sight(1, b, (0, 0, 0))] for a, b in (("qelb", "zorv"), ("desk", "table"), ("qelb", "desk"))}
    found = fuse_rooms(spark, rooms, groups=known)
    assert {room: len(objects) for room, objects in found.items()} == {"qelb-zorv": 1, "desk-table": 2, "qelb-desk": 2}
    assert found["qelb-zorv"][0]["label"] == "thing"


def test_empty_input(spark):
    objects, members = fusion.fuse(spark.createDataFrame([], SCHEMA))
    assert objects.count() == 0 and members.count() == 0


def plain_merge(sights, floor, scale, min_iou):
    """Direct restatement of the merge rules over a list, for comparison."""
    static = [{"desk", "table"}, {"sofa", "couch"}]

    def meets(a, b):
        return a == b or any(a in s and b in s for s in static)

    def iou(a, b):
        (ca, ea), (cb, eb) = (np.array(a[4][0]), np.array(a[4][1])), (np.array(b[4][0]), np.array(b[4][1]))
        side = np.minimum(ca + ea / 2, cb + eb / 2) - np.maximum(ca - ea / 2, cb - eb / 2)
        shared = np.prod(np.maximum(side, 0))
        return shared / (np.prod(ea) + np.prod(eb) - shared) if shared > 0 else 0.0

    groups = []
    for i in sorted(range(len(sights)), key=lambda i: (-sights[i][5], sights[i][0], i)):
        s, best = sights[i], None
        for group in groups:
            inside = [sights[j] for j in group]
            if not any(meets(s[1], o[1]) for o in inside):
                continue
            diags = [np.linalg.norm(o[4][1]) for o in [*inside, s]]
            radius = max(floor, scale * np.mean(diags))
            away = np.linalg.norm(np.mean([o[3] for o in inside], axis=0) - np.array(s[3]))
            if away > radius or not (away <= radius / 2 or any(iou(s, o) >= min_iou for o in inside)):
                continue
            if best is None or away < best[0]:
                best = (away, group)
        best[1].append(i) if best else groups.append([i])
    return {tuple(sorted(x)) for x in groups}


@pytest.mark.parametrize("seed, split_above", [(0, 0), (2, 5_000)])
def test_blocks_change_nothing(spark, seed, split_above):
    rng = np.random.default_rng(seed)
    labels = np.array(["desk", "table", "lamp", "sofa", "couch"])
    seen = [
        sight(int(rng.integers(8)), str(rng.choice(labels)), rng.uniform(0, 6, 3) * [1, 0.2, 1],
              extent=rng.uniform(0.1, 1.2, 3), n=int(rng.integers(40, 60)))
        for _ in range(160)
    ]
    _, members = fusion.fuse(table(spark, seen), split_above=split_above)
    pdf = members.toPandas()
    got = {tuple(sorted(ids)) for ids in pdf.groupby("object_id")["id"].apply(list)}
    assert got == plain_merge(seen, 0.30, 0.50, 0.10) and len(pdf) == len(seen)


def test_radius_summary(spark):
    sights = next(iter(pairs_at_shares().values()))
    mean = np.mean([np.linalg.norm(s[4][1]) for s in sights])
    for floor, scale in ((mean, 0.9), (mean, 1.1)):
        got = fusion.radius_summary(table(spark, sights), ["room"], floor, scale).first()
        assert got["driven_by"] == ("size" if scale > 1 else "floor")
        assert got["effective_radius"] == pytest.approx(max(floor, scale * mean), abs=1e-3)


def test_few_clusters_are_looked_through_without_arrays(monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        centre, extent = rng.uniform(0, 2, 3).round(1), rng.uniform(0, 1.2, 3).round(1)
        row = [*centre.tolist(), float(np.linalg.norm(extent)), *(centre - extent / 2).tolist(), *(centre + extent / 2).tolist()]
        if i % 29 == 0:
            row[int(rng.integers(10))] = float("nan")
        rows.append((i, str(rng.choice(["desk", "table"])), *row))

    def seeds(few, rows):
        state = fusion._Clusters(0.3, 0.5, 0.1, lambda a, b: a == b, few)
        return [state.place(*row) for row in rows]

    arrays = seeds(0, rows)
    assert arrays == seeds(8, rows) == seeds(10_000, rows) and 20 < len(set(arrays)) < 300

    def no_arrays(*_, **__):
        raise AssertionError("arrays for a few rows")

    monkeypatch.setattr(fusion, "np", type("np", (), {"__getattr__": no_arrays})())
    assert seeds(fusion.FEW, rows[:20]) == arrays[:20]
