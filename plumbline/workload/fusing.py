"""Queries over sightings, labels and merged objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as lab
from ..operators import fusion, proximity
from . import derive as d
from .registry import query


@query()
def fuse_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, _ = fusion.fuse(d.observations(spark, sf_dir), min_confidence=0.0)
    return objects.select(
        "room", "object_id", "label", F.concat_ws("|", "aliases").alias("aliases"), "n_observations",
        F.round("confidence", 6).alias("confidence"),
        *[F.round(F.col("centroid")[i], 8).alias(f"c{i}") for i in range(3)],
        F.round(g.diagonal("obb.extent"), 6).alias("diagonal"),
    )


_CLASSES = ", ".join(f"('{name}', '{canonical}')" for name, canonical in lab.BUILTIN.items())


def _side(i: int) -> str:
    return f"greatest(least(b[{i + 4}], box[{i + 4}]) - greatest(b[{i + 1}], box[{i + 1}]), 0)"


def _volume(b: str) -> str:
    return " * ".join(f"greatest({b}[{i + 4}] - {b}[{i + 1}], 1e-9)" for i in range(3))


_SHARED = " * ".join(_side(i) for i in range(3))
_OVERLAPS = f"{_SHARED} > 0 AND {_SHARED} / ({_volume('b')} + {_volume('box')} - {_SHARED}) >= 0.1"
# Sightings of a room and label class join the nearest cluster in reach, one after the other.
_FUSED = d.with_tables("observations", "names").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
classes(name, canonical) AS (VALUES {_CLASSES}),
seq AS (
  SELECT room, coalesce(canonical, n.name) AS class, id, frame_idx, n_points, cx, cy, cz, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS diag,
         CASE WHEN turned THEN e2 ELSE e0 END / 2 AS hx, e1 / 2 AS hy, CASE WHEN turned THEN e0 ELSE e2 END / 2 AS hz,
         row_number() OVER (PARTITION BY room, coalesce(canonical, n.name) ORDER BY n_points DESC, frame_idx, id) AS k
  FROM names n LEFT JOIN classes c ON c.name = n.name),
boxed AS (SELECT *, [cx - hx, cy - hy, cz - hz, cx + hx, cy + hy, cz + hz] AS box FROM seq),
walk AS (
  SELECT room, class, k, id, frame_idx, n_points, id AS seed,
         [{{'seed': id, 'n': CAST(1 AS DOUBLE), 'x': cx, 'y': cy, 'z': cz, 'diag': diag, 'boxes': [box]}}] AS state
  FROM boxed WHERE k = 1
  UNION ALL
  SELECT room, class, k, id, frame_idx, n_points, coalesce(target, id),
         CASE WHEN target IS NULL
              THEN list_append(state, {{'seed': id, 'n': CAST(1 AS DOUBLE), 'x': cx, 'y': cy, 'z': cz, 'diag': diag, 'boxes': [box]}})
              ELSE list_transform(state, lambda c: CASE WHEN c.seed = target
                   THEN {{'seed': c.seed, 'n': c.n + 1, 'x': c.x + cx, 'y': c.y + cy, 'z': c.z + cz, 'diag': c.diag + diag,
                          'boxes': list_append(c.boxes, box)}} ELSE c END) END
  FROM (
    SELECT o.*, w.state, list_sort(list_filter(
             list_transform(list_transform(w.state, lambda c, i: {{
                 'd': sqrt((c.x / c.n - cx) * (c.x / c.n - cx) + (c.y / c.n - cy) * (c.y / c.n - cy) + (c.z / c.n - cz) * (c.z / c.n - cz)),
                 'i': i, 'r': greatest(CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE) * (c.diag + diag) / (c.n + 1)), 'seed': c.seed,
                 'meets': len(list_filter(c.boxes, lambda b: {_OVERLAPS})) > 0}}), lambda c: c),
             lambda c: c.d <= c.r AND (c.d <= c.r / 2 OR c.meets)))[1].seed AS target
    FROM walk w JOIN boxed o ON o.room = w.room AND o.class = w.class AND o.k = w.k + 1)),
members AS (SELECT room, id, frame_idx, n_points, seed FROM walk),
objects AS (
  SELECT room, seed, count(*) AS n, max(n_points) FILTER (id = seed) AS seed_points, max(frame_idx) FILTER (id = seed) AS seed_frame
  FROM members GROUP BY room, seed),
numbered AS (
  SELECT room, seed, n, format('obj_{{:03d}}', row_number() OVER (PARTITION BY room ORDER BY n DESC, seed_points DESC, seed_frame, seed) - 1) AS object_id
  FROM objects)"""


@query(_FUSED + " SELECT m.room, object_id, id, frame_idx FROM members m JOIN numbered USING (room, seed)")
def object_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which object every sighting ended in."""
    _, members = fusion.fuse(d.observations(spark, sf_dir))
    return members


@query(_FUSED + """,
means AS (
  SELECT m.room, seed, avg(cx) AS c0, avg(cy) AS c1, avg(cz) AS c2, avg(vlm_confidence) AS vlm FROM members m JOIN observations o
      ON m.room = o.room AND m.id = o.id GROUP BY m.room, seed)
SELECT room, object_id, n AS n_observations, round(vlm, 6) AS mean_confidence, round(c0, 6) AS mean_0, round(c1, 6) AS mean_1,
       round(c2, 6) AS mean_2 FROM numbered JOIN means USING (room, seed)""")
def object_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, mean detector confidence and mean position of every merged object."""
    seen = d.observations(spark, sf_dir)
    _, members = fusion.fuse(seen)
    joined = members.select("room", "object_id", "id").join(seen.select("room", "id", "vlm_confidence", "centroid"), ["room", "id"])
    return joined.groupBy("room", "object_id").agg(
        F.count(F.lit(1)).alias("n_observations"), F.round(F.avg("vlm_confidence"), 6).alias("mean_confidence"),
        *[F.round(F.avg(F.col("centroid")[i]), 6).alias(f"mean_{i}") for i in range(3)],
    )


_PREFERRED = ", ".join(f"'{name}'" for name in lab.PREFERRED)


@query(_FUSED + f""",
seen AS (
  SELECT m.room, m.seed, n.name, n.cx, n.cy, n.cz, vlm_confidence AS vlm, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS diag
  FROM members m JOIN names n ON m.room = n.room AND m.id = n.id),
middles AS (
  SELECT room, seed, avg(cx) AS mx, avg(cy) AS my, avg(cz) AS mz, avg(vlm) AS vlm, greatest(CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE) * avg(diag)) AS radius,
         quantile_cont(cx, 0.5) AS c0, quantile_cont(cy, 0.5) AS c1, quantile_cont(cz, 0.5) AS c2
  FROM seen GROUP BY room, seed),
spreads AS (
  SELECT s.room, s.seed, avg(sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my) + (cz - mz) * (cz - mz))) AS spread
  FROM seen s JOIN middles m ON s.room = m.room AND s.seed = m.seed GROUP BY s.room, s.seed),
votes AS (SELECT room, seed, name, count(*) AS n FROM seen GROUP BY room, seed, name),
chosen AS (
  SELECT room, seed, name AS label FROM votes
  QUALIFY row_number() OVER (PARTITION BY room, seed ORDER BY n DESC, name NOT IN ({_PREFERRED}), length(name), name) = 1),
others AS (
  SELECT c.room, c.seed, label, coalesce(string_agg(name, '|' ORDER BY name) FILTER (name <> label), '') AS aliases
  FROM chosen c JOIN votes v ON c.room = v.room AND c.seed = v.seed GROUP BY c.room, c.seed, label)
SELECT b.room, object_id, label, aliases, n AS n_observations, round(c0, 8) AS c0, round(c1, 8) AS c1, round(c2, 8) AS c2,
       round(least(greatest(pow(1 - exp(-n / CAST(2 AS DOUBLE)), CAST(0.35 AS DOUBLE)) * pow(greatest(vlm, CAST(1e-6 AS DOUBLE)), CAST(0.4 AS DOUBLE))
             * pow(exp(-spread / radius), CAST(0.25 AS DOUBLE)), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)), 6) AS confidence
FROM numbered b JOIN middles m ON b.room = m.room AND b.seed = m.seed JOIN spreads s ON b.room = s.room AND b.seed = s.seed
JOIN others o ON b.room = o.room AND b.seed = o.seed""")
def object_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, name, aliases, median centre and confidence of every merged object."""
    objects, _ = fusion.fuse(d.observations(spark, sf_dir))
    return objects.select(
        "room", "object_id", "label", F.concat_ws("|", "aliases").alias("aliases"), "n_observations",
        F.round("confidence", 6).alias("confidence"), *[F.round(F.col("centroid")[i], 8).alias(f"c{i}") for i in range(3)],
    )


@query(
    d.with_tables("observations")
    + """,
sized AS (SELECT room, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS diag FROM observations),
means AS (SELECT room, coalesce(avg(diag) FILTER (diag > 0), 0) AS m FROM sized GROUP BY room)
SELECT room, round(m, 3) AS mean_obb_diagonal, round(greatest(CAST(0.3 AS DOUBLE), 0.5 * m), 3) AS effective_radius,
       round(greatest(CAST(0.3 AS DOUBLE), 0.5 * m) * 0.5, 3) AS merge_distance_no_overlap,
       CASE WHEN 0.5 * m > 0.3 THEN 'size' ELSE 'floor' END AS driven_by
FROM means"""
)
def radius_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.radius_summary(d.observations(spark, sf_dir), ["room"], 0.30, 0.50)


_SEEN = d.with_tables("observations", "names") + f""",
classes(name, canonical) AS (VALUES {_CLASSES}),
boxed AS (
  SELECT room, id, frame_idx, coalesce(canonical, n.name) AS class,
         [cx - hx, cy - hy, cz - hz, cx + hx, cy + hy, cz + hz] AS box
  FROM (SELECT *, CASE WHEN turned THEN e2 ELSE e0 END / 2 AS hx, e1 / 2 AS hy, CASE WHEN turned THEN e0 ELSE e2 END / 2 AS hz FROM names) n
  LEFT JOIN classes c ON c.name = n.name)"""


@query(_SEEN + f"""
SELECT DISTINCT o.room, o.id, m.frame_idx FROM (SELECT * FROM boxed) o
JOIN (SELECT room, frame_idx, class, box AS b FROM boxed) m
  ON o.room = m.room AND o.class = m.class AND o.frame_idx <> m.frame_idx AND {_OVERLAPS}""")
def seen_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other frames of the room with a sighting that meets each sighting in label and box."""
    seen = d.observations(spark, sf_dir)
    members = seen.select("room", F.col("frame_idx").alias("cluster"), "label", "obb")
    met = proximity.any_member(seen, members, carry=["frame_idx"])
    return met.where(F.col("cluster") != F.col("frame_idx")).select("room", "id", F.col("cluster").alias("frame_idx"))


@query(d.with_tables("observations", "names") + """,
spots AS (SELECT room, min(id) AS centre, avg(cx) AS x, avg(cy) AS y, avg(cz) AS z FROM names GROUP BY room, frame_idx, name),
reach AS (
  SELECT n.room, n.id, centre, sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y) + (cz - z) * (cz - z)) AS distance
  FROM names n JOIN spots s ON n.room = s.room)
SELECT room, id, centre, round(distance, 6) AS distance FROM reach WHERE distance <= 0.8
QUALIFY row_number() OVER (PARTITION BY room, id ORDER BY distance, centre) = 1""")
def nearest_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest mean position of a frame and label in the room of each sighting, up to 0.8 m away."""
    at = [F.col("centroid")[i].alias(c) for i, c in enumerate("xyz")]
    seen = d.observations(spark, sf_dir).select("room", "id", "frame_idx", lab.normalize("label").alias("name"), *at)
    spots = seen.groupBy("room", "frame_idx", "name").agg(F.min("id").alias("centre"), *[F.avg(c).alias(c) for c in "xyz"])
    return proximity.nearest(seen, spots, 0.8).withColumn("distance", F.round("distance", 6))
