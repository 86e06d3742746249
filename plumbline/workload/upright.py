"""Queries over rotations, transforms, levelling and floor plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scores
from ..operators import floorplan as fp
from ..operators import level
from ..operators.quantiles import exact_quantiles
from ..session import durable, lookup_join
from . import derive as d
from .registry import query

_D = "CAST({} AS DOUBLE)"
_E = [_D.format(f"embedding[{i}]") for i in range(1, 8)]

# A fixed rigid transform: 30 degrees about y, then 20 about x, then a shift.
TURN = [
    0.8660254037844387, 0.0, 0.5, 0.25,
    0.17101007166283433, 0.9396926207859084, -0.29619813272602386, -1.5,
    -0.46984631039295416, 0.3420201433256687, 0.8137976813493737, 0.75,
    0.0, 0.0, 0.0, 1.0,
]
_T = [_D.format(repr(v)) for v in TURN]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(7)]
    return d.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("room"), *parts)


def _moved_sql(row: int, x: str, y: str, z: str) -> str:
    a, b, c, t = _T[4 * row: 4 * row + 4]
    return f"{a} * {x} + {b} * {y} + {c} * {z} + {t}"


@query(f"""
WITH e AS (SELECT vec_id, {_E[0]} AS x, {_E[1]} AS y, {_E[2]} AS z FROM embeddings)
SELECT vec_id, round({_moved_sql(0, 'x', 'y', 'z')}, 6) AS x, round({_moved_sql(1, 'x', 'y', 'z')}, 6) AS y,
       round({_moved_sql(2, 'x', 'y', 'z')}, 6) AS z,
       round(degrees(acos(({_T[0]} + {_T[5]} + {_T[10]} - 1) / 2)), 2) AS rotation_deg
FROM e""")
def affine_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.array(*[F.lit(v) for v in TURN])
    moved = g.move_point(TURN, [F.col(f"e{i}") for i in range(3)])
    return _vectors(spark, sf_dir).select(
        "vec_id", *[F.round(m, 6).alias(n) for m, n in zip(moved, "xyz")],
        F.round(g.rotation_angle(t), 2).alias("rotation_deg"),
    )


def _poses_sql(row: int, col: int) -> str:
    # Pose with identity rotation and translation (x, y, z).
    terms = [f"{_T[4 * row + col]}"]
    if col == 3:
        terms = [f"{_T[4 * row]} * x", f"{_T[4 * row + 1]} * y", f"{_T[4 * row + 2]} * z", _T[4 * row + 3]]
    return " + ".join(terms)


@query(f"""
WITH e AS (SELECT vec_id, {_E[0]} AS x, {_E[1]} AS y, {_E[2]} AS z FROM embeddings)
SELECT vec_id, {", ".join(f"round({_poses_sql(i, j)}, 6) AS p{i}{j}" for i in range(3) for j in range(4))} FROM e""")
def level_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, zero = F.lit(1.0), F.lit(0.0)
    pose = F.array(one, zero, zero, F.col("e0"), zero, one, zero, F.col("e1"), zero, zero, one, F.col("e2"), zero, zero, zero, one)
    placed = _vectors(spark, sf_dir).select("vec_id", "room", pose.alias("pose"))
    rooms = placed.select("room").distinct().withColumn("applied", F.array(*[F.lit(v) for v in TURN]))
    moved = level.move_cameras(placed, durable(rooms))
    return moved.select(
        "vec_id", *[F.round(F.col("pose")[4 * i + j], 6).alias(f"p{i}{j}") for i in range(3) for j in range(4)]
    )


@query(d.with_tables("observations") + f"""
SELECT room, id, round({_moved_sql(0, 'cx', 'cy', 'cz')}, 4) AS c0, round({_moved_sql(1, 'cx', 'cy', 'cz')}, 4) AS c1,
       round({_moved_sql(2, 'cx', 'cy', 'cz')}, 4) AS c2, e0, e1, e2,
       round(CASE WHEN turned THEN -{_T[2]} ELSE {_T[0]} END, 6) AS r00,
       round(CASE WHEN turned THEN {_T[4]} ELSE {_T[6]} END, 6) AS r12
FROM observations""")
def level_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = d.observations(spark, sf_dir)
    rooms = seen.select("room").distinct().withColumn("applied", F.array(*[F.lit(v) for v in TURN]))
    moved = level.move_records(seen, durable(rooms))
    return moved.select(
        "room", "id", *[F.col("centroid")[i].alias(f"c{i}") for i in range(3)],
        *[F.col("obb.extent")[i].alias(f"e{i}") for i in range(3)],
        F.round(F.col("obb.R")[0][0], 6).alias("r00"), F.round(F.col("obb.R")[1][2], 6).alias("r12"),
    )


_QUAT = f"""
WITH e AS (
  SELECT vec_id, {_E[0]} AS a, {_E[1]} AS b, {_E[2]} AS c, {_E[3]} AS w FROM embeddings),
s AS (SELECT *, sqrt(a * a + b * b + c * c + w * w) AS n FROM e),
q AS (SELECT vec_id, a / n AS x, b / n AS y, c / n AS z, w / n AS w FROM s)"""


@query(_QUAT + """
SELECT vec_id, round(1 - 2 * (y * y + z * z), 6) AS r00, round(2 * (x * y - z * w), 6) AS r01,
       round(2 * (x * z + y * w), 6) AS r02, round(2 * (y * z + x * w), 6) AS r21,
       round(abs(x), 6) AS qx, round(abs(y), 6) AS qy, round(abs(z), 6) AS qz, round(abs(w), 6) AS qw,
       true AS same_turn
FROM q""")
def quat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quaternion to rotation and back; the way back may flip the sign as a whole."""
    q = _vectors(spark, sf_dir).select("vec_id", F.array(*[f"e{i}" for i in range(4)]).alias("q"))
    turned = q.withColumn("r", g.quat_to_rotation("q")).withColumn("back", g.rotation_to_quat("r"))
    again = turned.withColumn("again", g.quat_to_rotation("back"))
    same = F.array_max(F.zip_with("r", "again", lambda a, b: F.abs(a - b))) < 1e-9
    r, b = F.col("r"), F.col("back")
    return again.select(
        "vec_id", *[F.round(r[i], 6).alias(n) for i, n in ((0, "r00"), (1, "r01"), (2, "r02"), (7, "r21"))],
        *[F.round(F.abs(b[i]), 6).alias(n) for i, n in enumerate(("qx", "qy", "qz", "qw"))],
        same.alias("same_turn"),
    )


@query(f"""
WITH e AS (SELECT label AS room, {_E[0]} AS x, {_E[1]} + 1 AS y, {_E[2]} AS z FROM embeddings),
u AS (SELECT room, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM e),
m AS (SELECT room, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM u GROUP BY room),
k AS (SELECT *, sqrt(mx*mx + my*my + mz*mz) AS mag FROM m)
SELECT room, round(any_value(-mx / mag), 6) AS up0, round(any_value(-my / mag), 6) AS up1, round(any_value(-mz / mag), 6) AS up2,
       round(avg(degrees(acos(least(greatest((x*mx + y*my + z*mz) / mag, -1), 1)))), 4) AS tilt_deg
FROM u JOIN k USING (room) GROUP BY room""")
def pose_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    cells = [zero] * 16
    cells[1], cells[5], cells[9] = F.col("e0"), F.col("e1") + 1.0, F.col("e2")
    poses = _vectors(spark, sf_dir).select("room", F.array(*cells).alias("pose"))
    ups = level.up_from_poses(poses)
    return ups.select(
        "room", *[F.round(F.col("pose_up")[i], 6).alias(f"up{i}") for i in range(3)],
        F.round("tilt_deg", 4).alias("tilt_deg"),
    )


PLANES = ((0.0, 1.0, 0.0, 0.05), (0.6, 0.8, 0.0, 0.0), (0.0, 0.8, 0.6, -0.1), (1.0, 0.0, 0.0, 0.1))


@query(f"""
WITH e AS (SELECT label AS room, {_E[0]} AS x, {_E[1]} AS y, {_E[2]} AS z FROM embeddings),
planes(plane, a, b, c, o) AS (VALUES {", ".join(f"({i}, {', '.join(_D.format(v) for v in p)})" for i, p in enumerate(PLANES))})
SELECT room, plane, count(*) AS n, count(*) FILTER (abs(a * x + b * y + c * z - o) < 0.03) AS inliers,
       round(count(*) FILTER (abs(a * x + b * y + c * z - o) < 0.03) / CAST(count(*) AS DOUBLE), 6) AS fraction
FROM e, planes WHERE b >= cos(radians(CAST(35 AS DOUBLE))) OR plane >= 0 GROUP BY room, plane""")
def plane_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _vectors(spark, sf_dir).select("room", F.col("e0").alias("x"), F.col("e1").alias("y"), F.col("e2").alias("z"))
    return level.plane_support(pts, ["room"], PLANES, 0.03).withColumn("fraction", F.round("fraction", 6))


@query(f"""
WITH e AS (SELECT label AS room, {_E[0]} AS x, {_E[1]} * 2 AS y, {_E[2]} * 3 AS z FROM embeddings),
m AS (SELECT room, median(x) AS mx, median(y) AS my, median(z) AS mz, count(*) AS n,
             max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz FROM e GROUP BY room),
b AS (SELECT room, avg(CASE WHEN x < mx THEN 1.0 ELSE 0.0 END) AS bx, avg(CASE WHEN y < my THEN 1.0 ELSE 0.0 END) AS by_,
             avg(CASE WHEN z < mz THEN 1.0 ELSE 0.0 END) AS bz FROM e JOIN m USING (room) GROUP BY room),
s AS (SELECT room, n, CASE WHEN sx <= sy AND sx <= sz THEN 0 WHEN sy <= sz THEN 1 ELSE 2 END AS axis,
             list_sort([sx, sy, sz]) AS spans, bx, by_, bz FROM m JOIN b USING (room))
SELECT room, CAST(n AS BIGINT) AS n, axis,
       CASE WHEN [bx, by_, bz][axis + 1] >= 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS sign,
       round(least(greatest(1 - spans[1] / greatest(spans[2], 1e-9), 0), 1) * 0.5, 3) AS confidence
FROM s""")
def up_from_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("room", F.col("e0").alias("x"), (F.col("e1") * 2).alias("y"), (F.col("e2") * 3).alias("z"))
    return level.up_from_extent(v).select("room", "n", "axis", "sign", "confidence")


_COS = "cos(radians(CAST(35 AS DOUBLE)))"


_SEARCH = d.with_tables("points") + f""",
cut AS (SELECT room, quantile_cont(y, CAST(0.9 AS DOUBLE)) AS q FROM points WHERE conf GROUP BY room),
low AS (
  SELECT room, x, y, z, (frame_idx::BIGINT * 7919 + v::BIGINT * 104729 + u::BIGINT * 1299709 + r::BIGINT * 15485863 + g::BIGINT * 49979687) * 40503 % 4294967296 AS draw,
         count(*) OVER (PARTITION BY room) AS n_low
  FROM points JOIN cut USING (room) WHERE conf AND y <= q),
picks AS (
  SELECT room, draw % least(1200, n_low) AS slot, min({{'draw': draw, 'x': x, 'y': y, 'z': z}}) AS p
  FROM low GROUP BY ALL),
arrays AS (SELECT room, list(p ORDER BY slot) AS p, count(*) AS b FROM picks GROUP BY room),
drawn AS (
  SELECT room, i AS plane, p[1 + i % b] AS a, p[1 + (i * 7 + i // b + 1) % b] AS q, p[1 + (i * 13 + i // b * 2 + 2) % b] AS r
  FROM arrays, range(0, 400) t(i) WHERE b >= 3),
crossed AS (
  SELECT room, plane, a,
         (q.y - a.y) * (r.z - a.z) - (q.z - a.z) * (r.y - a.y) AS cx, (q.z - a.z) * (r.x - a.x) - (q.x - a.x) * (r.z - a.z) AS cy,
         (q.x - a.x) * (r.y - a.y) - (q.y - a.y) * (r.x - a.x) AS cz
  FROM drawn),
sized AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) * CASE WHEN cy < 0 THEN -1 ELSE 1 END AS s FROM crossed),
planes AS (
  SELECT room, plane, cx / s AS nx, cy / s AS ny, cz / s AS nz, cx / s * a.x + cy / s * a.y + cz / s * a.z AS o
  FROM sized WHERE abs(s) >= 1e-9 AND cy / s >= {_COS}),
votes AS (
  SELECT l.room, plane, count(*) FILTER (abs(nx * x + ny * y + nz * z - o) < 0.03) AS inliers, any_value(n_low) AS n_low,
         any_value(ny) AS ny
  FROM low l JOIN planes p ON l.room = p.room WHERE n_low >= 50 GROUP BY l.room, plane),
best AS (SELECT v.*, nx, nz, o FROM votes v JOIN planes USING (room, plane)
         QUALIFY row_number() OVER (PARTITION BY room ORDER BY inliers DESC, plane) = 1)"""


@query(_SEARCH + """
SELECT room, CAST(plane AS INTEGER) AS plane, CAST(inliers AS BIGINT) AS inliers, CAST(n_low AS BIGINT) AS n_low,
       round(ny, 6) AS upright FROM best""")
def floor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 400 drawn planes per room, none steeper than 35 degrees, over the whole low slice."""
    low = level.lowest_rows(_confident(spark, sf_dir), _straight_up(spark, sf_dir), [], 0.9, 100, _point_draw())
    found = level.floor_search(low.where("n_low >= 50"), tolerance=0.03, max_tilt_deg=35.0, iterations=400)
    return found.select("room", "plane", "inliers", "n_low", F.round(F.col("normal")[1], 6).alias("upright"))


def _confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.points(spark, sf_dir).where("conf")


def _straight_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    return durable(_confident(spark, sf_dir).select("room").distinct().withColumn("up", up))


def _point_draw() -> Column:
    parts = [F.col(c).cast("bigint") * m for c, m in
             (("frame_idx", 7919), ("v", 104729), ("u", 1299709), ("r", 15485863), ("g", 49979687))]
    return F.pmod((parts[0] + parts[1] + parts[2] + parts[3] + parts[4]) * 40503, F.lit(1 << 32))


def _minus(i: int, j: int) -> str:
    return f"(c{min(i, j)}{max(i, j)}{' - e' if i == j else ''})"


def _row_cross(a: int, b: int) -> str:
    return "[" + ", ".join(
        f"{_minus(a, (k + 1) % 3)} * {_minus(b, (k + 2) % 3)} - {_minus(a, (k + 2) % 3)} * {_minus(b, (k + 1) % 3)}" for k in range(3)
    ) + "]"


@query(_SEARCH + f""",
found AS (SELECT * FROM best WHERE inliers > 0 AND inliers >= 0.1 * n_low),
m AS (
  SELECT room, any_value(nx) AS nx, any_value(ny) AS ny, any_value(nz) AS nz, any_value(o) AS o,
         any_value(inliers) / CAST(any_value(f.n_low) AS DOUBLE) AS share, avg(x) AS mx, avg(y) AS my, avg(z) AS mz,
         covar_pop(x, x) AS c00, covar_pop(x, y) AS c01, covar_pop(x, z) AS c02, covar_pop(y, y) AS c11,
         covar_pop(y, z) AS c12, covar_pop(z, z) AS c22
  FROM low l JOIN found f USING (room) WHERE abs(nx * x + ny * y + nz * z - o) < 0.03 GROUP BY room),
q AS (SELECT *, (c00 + c11 + c22) / 3 AS q FROM m),
p AS (SELECT *, sqrt(((c00 - q) ** 2 + (c11 - q) ** 2 + (c22 - q) ** 2 + 2 * (c01 * c01 + c02 * c02 + c12 * c12)) / 6) AS p FROM q),
least_ AS (
  SELECT *, q + 2 * p * cos(acos(least(greatest(((c00 - q) * ((c11 - q) * (c22 - q) - c12 * c12) - c01 * (c01 * (c22 - q) - c12 * c02)
            + c02 * (c01 * c12 - (c11 - q) * c02)) / (p * p * p) / 2, -1), 1)) / 3 + 2 * pi() / 3) AS e FROM p),
crosses AS (SELECT *, unnest([{_row_cross(0, 1)}, {_row_cross(0, 2)}, {_row_cross(1, 2)}]) AS v FROM least_),
flat AS (
  SELECT *, list_transform(v, lambda t: t / sqrt(list_dot_product(v, v)) * CASE WHEN v[2] < 0 THEN -1 ELSE 1 END) AS f FROM crosses
  QUALIFY row_number() OVER (PARTITION BY room ORDER BY list_dot_product(v, v) DESC) = 1)
SELECT room, round(CASE WHEN f[2] >= {_COS} THEN f[1] ELSE nx END, 4) AS n0, round(CASE WHEN f[2] >= {_COS} THEN f[2] ELSE ny END, 4) AS n1,
       round(CASE WHEN f[2] >= {_COS} THEN f[3] ELSE nz END, 4) AS n2,
       round(CASE WHEN f[2] >= {_COS} THEN f[1] * mx + f[2] * my + f[3] * mz ELSE o END, 4) AS offset, round(share, 6) AS inlier_frac
FROM flat""")
def floor_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor search in every derived room; the floor is where v = 0 lies."""
    found = level.floor_planes(
        _confident(spark, sf_dir), _straight_up(spark, sf_dir), [], slice_quantile=0.9, draw=_point_draw()
    )
    return found.select(
        "room", *[F.round(F.col("normal")[i], 4).alias(f"n{i}") for i in range(3)],
        F.round("offset", 4).alias("offset"), F.round("inlier_frac", 6).alias("inlier_frac"),
    )


def _dot_sql(a: str, b: str) -> str:
    return " + ".join(f"{a}{i} * {b}{i}" for i in range(3))


_FLAT = "CASE WHEN flat_dot >= " + _COS + " THEN f[{}] ELSE n{} END"

# The whole estimate: prior from the poses, floor search along it, refit, agreement and trust.
_ESTIMATE = d.with_tables("points", "cameras") + f""",
downs AS (SELECT room, (frame_idx - 4) * {_D.format(0.02)} AS d0, {_D.format(1)} AS d1, ey * {_D.format(0.5)} - {_D.format(0.05)} AS d2 FROM cameras),
units AS (SELECT room, d0 / s AS d0, d1 / s AS d1, d2 / s AS d2 FROM (SELECT *, sqrt({_dot_sql("d", "d")}) AS s FROM downs)),
means AS (SELECT room, avg(d0) AS m0, avg(d1) AS m1, avg(d2) AS m2 FROM units GROUP BY room),
sized_means AS (SELECT *, sqrt({_dot_sql("m", "m")}) AS mag FROM means),
posed AS (
  SELECT room, any_value(-m0 / mag) AS u0, any_value(-m1 / mag) AS u1, any_value(-m2 / mag) AS u2,
         avg(degrees(acos(least(greatest(({_dot_sql("d", "m")}) / mag, -1), 1)))) AS tilt
  FROM units JOIN sized_means USING (room) GROUP BY room),
usable AS (
  SELECT p.*, u0, u1, u2, x * u0 + y * u1 + z * u2 AS h, count(*) OVER (PARTITION BY room) AS n
  FROM points p JOIN posed USING (room) WHERE conf),
cut AS (SELECT room, quantile_cont(h, CAST(0.25 AS DOUBLE)) AS q FROM usable WHERE n >= 100 GROUP BY room),
low AS (
  SELECT room, x, y, z, u0, u1, u2, (frame_idx::BIGINT * 7919 + v::BIGINT * 104729 + u::BIGINT * 1299709 + r::BIGINT * 15485863 + g::BIGINT * 49979687) * 40503 % 4294967296 AS draw,
         count(*) OVER (PARTITION BY room) AS n_low
  FROM usable JOIN cut USING (room) WHERE h <= q QUALIFY n_low >= 50),
picks AS (
  SELECT room, u0, u1, u2, draw % least(1200, n_low) AS slot, min({{'draw': draw, 'x': x, 'y': y, 'z': z}}) AS p FROM low GROUP BY ALL),
arrays AS (SELECT room, u0, u1, u2, list(p ORDER BY slot) AS p, count(*) AS b FROM picks GROUP BY room, u0, u1, u2),
drawn AS (
  SELECT room, u0, u1, u2, i AS plane, p[1 + i % b] AS a, p[1 + (i * 7 + i // b + 1) % b] AS q, p[1 + (i * 13 + i // b * 2 + 2) % b] AS r
  FROM arrays, range(0, 400) t(i) WHERE b >= 3),
crossed AS (
  SELECT *, (q.y - a.y) * (r.z - a.z) - (q.z - a.z) * (r.y - a.y) AS c0, (q.z - a.z) * (r.x - a.x) - (q.x - a.x) * (r.z - a.z) AS c1,
         (q.x - a.x) * (r.y - a.y) - (q.y - a.y) * (r.x - a.x) AS c2 FROM drawn),
turned AS (SELECT *, sqrt({_dot_sql("c", "c")}) * CASE WHEN {_dot_sql("c", "u")} < 0 THEN -1 ELSE 1 END AS s FROM crossed),
planes AS (
  SELECT room, plane, c0 / s AS n0, c1 / s AS n1, c2 / s AS n2, c0 / s * a.x + c1 / s * a.y + c2 / s * a.z AS o
  FROM turned WHERE abs(s) >= 1e-9 AND c0 / s * u0 + c1 / s * u1 + c2 / s * u2 >= {_COS}),
best AS (
  SELECT l.room, plane, n0, n1, n2, o, count(*) FILTER (abs(n0 * x + n1 * y + n2 * z - o) < 0.03) AS inliers, any_value(n_low) AS n_low
  FROM low l JOIN planes p ON l.room = p.room GROUP BY l.room, plane, n0, n1, n2, o
  QUALIFY row_number() OVER (PARTITION BY l.room ORDER BY inliers DESC, plane) = 1),
m AS (
  SELECT room, n0, n1, n2, o, u0, u1, u2, inliers / CAST(f.n_low AS DOUBLE) AS share, avg(x) AS mx, avg(y) AS my, avg(z) AS mz,
         covar_pop(x, x) AS c00, covar_pop(x, y) AS c01, covar_pop(x, z) AS c02, covar_pop(y, y) AS c11,
         covar_pop(y, z) AS c12, covar_pop(z, z) AS c22
  FROM low l JOIN best f USING (room) WHERE inliers > 0 AND inliers >= 0.1 * f.n_low AND abs(n0 * x + n1 * y + n2 * z - o) < 0.03
  GROUP BY room, n0, n1, n2, o, u0, u1, u2, inliers, f.n_low),
q AS (SELECT *, (c00 + c11 + c22) / 3 AS q FROM m),
p AS (SELECT *, sqrt(((c00 - q) ** 2 + (c11 - q) ** 2 + (c22 - q) ** 2 + 2 * (c01 * c01 + c02 * c02 + c12 * c12)) / 6) AS p FROM q),
least_ AS (
  SELECT *, q + 2 * p * cos(acos(least(greatest(((c00 - q) * ((c11 - q) * (c22 - q) - c12 * c12) - c01 * (c01 * (c22 - q) - c12 * c02)
            + c02 * (c01 * c12 - (c11 - q) * c02)) / (p * p * p) / 2, -1), 1)) / 3 + 2 * pi() / 3) AS e FROM p),
crosses AS (SELECT *, unnest([{_row_cross(0, 1)}, {_row_cross(0, 2)}, {_row_cross(1, 2)}]) AS v FROM least_),
flat AS (
  SELECT *, list_transform(v, lambda t: t / sqrt(list_dot_product(v, v)) * CASE WHEN v[1] * u0 + v[2] * u1 + v[3] * u2 < 0 THEN -1 ELSE 1 END) AS f
  FROM crosses QUALIFY row_number() OVER (PARTITION BY room ORDER BY list_dot_product(v, v) DESC) = 1),
floors AS (
  SELECT *, {", ".join(f"{_FLAT.format(i + 1, i)} AS k{i}" for i in range(3))},
         CASE WHEN flat_dot >= {_COS} THEN f[1] * mx + f[2] * my + f[3] * mz ELSE o END AS floor_offset
  FROM (SELECT *, f[1] * u0 + f[2] * u1 + f[3] * u2 AS flat_dot FROM flat)),
agreed AS (SELECT *, degrees(acos(least(greatest({_dot_sql("k", "u")}, -1), 1))) AS agreement FROM floors),
heights AS (SELECT room, quantile_cont(h, CAST(0.01 AS DOUBLE)) AS lowest FROM usable GROUP BY room),
estimate AS (
  SELECT s.room, {", ".join(f"coalesce(k{i}, s.u{i}) AS up{i}" for i in range(3))}, coalesce(floor_offset, lowest, 0) AS floor_offset,
         round(CASE WHEN k0 IS NULL THEN greatest(1 - tilt / 60, 0) * 0.7
               ELSE pow(least(greatest(1 - tilt / 60, 0), 1) * least(greatest(share / 0.35, 0), 1) * least(greatest(1 - agreement / 30, 0), 1),
                        CAST(1 AS DOUBLE) / 3) END, 3) AS confidence,
         CASE WHEN k0 IS NULL THEN 'poses' ELSE 'poses+floor' END AS source
  FROM posed s LEFT JOIN agreed USING (room) LEFT JOIN heights USING (room))"""


def _leaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras that lean sideways along the path and forward by room."""
    sideways = (F.col("frame_idx") - 4) * F.lit(0.02)
    forward = F.col("pose")[7] * 0.5 - F.lit(0.05)
    turned = F.transform("pose", lambda c, i: F.when(i == 1, sideways).when(i == 9, forward).otherwise(c))
    return d.cameras(spark, sf_dir).withColumn("pose", turned)


IDENTITY = ["frame_idx", "v", "u", "r", "g"]


@query(_ESTIMATE + f"""
SELECT room, {", ".join(f"round(up{i}, 4) AS up{i}" for i in range(3))}, round(floor_offset, 4) AS floor_offset, confidence, source FROM estimate""")
def estimate_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full up estimate of every derived room from its cameras and points."""
    est = level.estimate_up(_confident(spark, sf_dir), _leaning(spark, sf_dir), IDENTITY, draw=_point_draw())
    return est.select(
        "room", *[F.round(F.col("up")[i], 4).alias(f"up{i}") for i in range(3)],
        F.round("floor_offset", 4).alias("floor_offset"), "confidence", "source",
    )


@query(_ESTIMATE + """,
unit AS (
  SELECT room, floor_offset, up0 / s AS a, up1 / s AS b, up2 / s AS c, 1 + up1 / s AS w
  FROM (SELECT *, sqrt(up0 * up0 + up1 * up1 + up2 * up2) AS s FROM estimate)),
turn AS (
  SELECT room, floor_offset, CASE WHEN w < 1e-12 THEN [1, 0, 0, 0, -1, 0, 0, 0, -1]
         ELSE [1 - a * a / w, -a, -a * c / w, a, b, c, -a * c / w, -c, 1 - c * c / w] END AS t FROM unit),
moved AS (
  SELECT room, floor_offset, t[1] * x + t[2] * y + t[3] * z AS x, t[4] * x + t[5] * y + t[6] * z AS y, t[7] * x + t[8] * y + t[9] * z AS z
  FROM points JOIN turn USING (room) WHERE conf)
SELECT room, count(*) AS n, round(min(x) - median(x), 4) AS min_x, round(min(y) - any_value(floor_offset), 4) AS min_y,
       round(min(z) - median(z), 4) AS min_z, round(max(x) - median(x), 4) AS max_x,
       round(max(y) - any_value(floor_offset), 4) AS max_y, round(max(z) - median(z), 4) AS max_z
FROM moved GROUP BY room""")
def level_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate, transform and move every derived room; its levelled bounds."""
    # Every step reads these few columns again: they are derived once.
    pts = durable(_confident(spark, sf_dir).select("room", *IDENTITY, "x", "y", "z"))
    est = durable(level.estimate_up(pts, _leaning(spark, sf_dir), IDENTITY, draw=_point_draw()))
    applied = durable(level.levelling_transforms(est, pts))
    return level.move_points(pts, applied).groupBy("room").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.min(c), 4).alias(f"min_{c}") for c in "xyz"],
        *[F.round(F.max(c), 4).alias(f"max_{c}") for c in "xyz"],
    )


@query(d.with_tables("points") + """,
h AS (SELECT room, -1 * y AS h FROM points)
SELECT room, CAST(0 AS DOUBLE) AS up0, CAST(-1 AS DOUBLE) AS up1, CAST(0 AS DOUBLE) AS up2,
       round(quantile_cont(h, 0.01), 6) AS floor_offset, CAST(1 AS DOUBLE) AS confidence, 'manual' AS source
FROM h GROUP BY room""")
def forced_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    est = level.forced_up(d.points(spark, sf_dir), "-y")
    return est.select(
        "room", *[(F.col("up")[i] + 0.0).alias(f"up{i}") for i in range(3)],
        F.round("floor_offset", 6).alias("floor_offset"), "confidence", "source",
    )


@query(d.with_tables("points") + """,
cut AS (SELECT room, quantile_cont(y, 0.25) AS q FROM points GROUP BY room)
SELECT p.room, count(*) AS n, round(min(y), 6) AS bottom, round(max(y), 6) AS top
FROM points p JOIN cut USING (room) WHERE y <= q GROUP BY p.room""")
def lowest_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = d.points(spark, sf_dir)
    up = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    low = level.lowest_rows(pts, pts.select("room").distinct().withColumn("up", up), IDENTITY, 0.25, 1)
    return low.groupBy("room").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("y"), 6).alias("bottom"), F.round(F.max("y"), 6).alias("top")
    )


@query(d.with_tables("points") + """
SELECT frame_idx, count(*) AS n, round(median(x), 8) AS mx, round(median(z), 8) AS mz,
       round(quantile_cont(z, 0.01), 8) AS q01, round(quantile_cont(z, 0.85), 8) AS q85
FROM points GROUP BY frame_idx""")
def hot_group_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of seven groups that hold all rows, forced through the bracketed path."""
    pts = d.points(spark, sf_dir)
    wanted = {"mx": ("x", 0.5), "mz": ("z", 0.5), "q01": ("z", 0.01), "q85": ("z", 0.85)}
    found = exact_quantiles(pts, ["frame_idx"], wanted, small_group=1_000, accuracy=1_000)
    n = pts.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"))
    return n.join(found, "frame_idx").select("frame_idx", "n", *[F.round(c, 8).alias(c) for c in wanted])


_SNAP = f"""
WITH e AS (SELECT vec_id, {_E[0]} AS a, {_E[1]} AS b, {_E[2]} AS c FROM embeddings),
u AS (SELECT vec_id, a / sqrt(a*a + b*b + c*c) AS a, b / sqrt(a*a + b*b + c*c) AS b, c / sqrt(a*a + b*b + c*c) AS c FROM e),
x AS (SELECT *, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN 0 WHEN abs(b) >= abs(c) THEN 1 ELSE 2 END AS axis FROM u),
s AS (SELECT *, [a, b, c][axis + 1] AS along FROM x),
r AS (SELECT *, degrees(acos(least(abs(along), 1))) AS snap FROM s)
SELECT vec_id, axis, CASE WHEN along < 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sign, round(snap, 1) AS snap_deg,
       round(CAST(0.8 AS DOUBLE) * least(greatest(1 - snap / 20, 0), 1), 3) AS confidence,
       snap < 1 AND axis = 1 AND along > 0 AS levelled
FROM r"""


@query(_SNAP)
def up_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    size = g.norm3(*[F.col(f"e{i}") for i in range(3)])
    ups = v.select("vec_id", F.array(*[F.col(f"e{i}") / size for i in range(3)]).alias("up"))
    return ups.select("vec_id", scores.snap_report("up", F.lit(0.8)).alias("r")).select(
        "vec_id", "r.axis", "r.sign", "r.snap_deg", "r.confidence", "r.levelled"
    )


@query(f"""
WITH e AS (SELECT vec_id, abs({_E[3]}) * 200 AS tilt, abs({_E[4]}) AS frac, abs({_E[5]}) * 100 AS agree FROM embeddings)
SELECT vec_id, round(pow(least(greatest(1 - tilt / 60, 0), 1) * least(greatest(frac / 0.35, 0), 1) * least(greatest(1 - agree / 30, 0), 1), CAST(1 AS DOUBLE) / 3), 6) AS both,
       round(least(greatest(1 - tilt / 60, 0), 1) * 0.7, 6) AS poses_only
FROM e""")
def up_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tilt, frac, agree = F.abs("e3") * 200, F.abs("e4"), F.abs("e5") * 100
    return _vectors(spark, sf_dir).select(
        "vec_id", F.round(scores.up_score(tilt, frac, agree), 6).alias("both"),
        F.round(scores.pose_score(tilt) * 0.7, 6).alias("poses_only"),
    )


_PLAN = d.with_tables("points") + """,
bounds AS (
  SELECT room, min(x) AS a0, max(x) AS a1, min(z) AS b0, max(z) AS b1,
         greatest(max(x) - min(x), max(z) - min(z), 1e-6) * CAST(0.04 AS DOUBLE) AS pad
  FROM points GROUP BY room),
padded AS (SELECT room, a0 - pad AS a0, a1 + pad AS a1, b0 - pad AS b0, b1 + pad AS b1 FROM bounds),
plan AS (
  SELECT room, a0, b0, CAST(199 AS DOUBLE) / greatest(a1 - a0, b1 - b0) AS scale,
         CAST(ceil((a1 - a0) * (CAST(199 AS DOUBLE) / greatest(a1 - a0, b1 - b0))) AS INTEGER) + 1 AS width,
         CAST(ceil((b1 - b0) * (CAST(199 AS DOUBLE) / greatest(a1 - a0, b1 - b0))) AS INTEGER) + 1 AS height
  FROM padded)"""


@query(_PLAN + """
SELECT room, round(a0, 6) AS origin_a, round(b0, 6) AS origin_b, round(scale, 6) AS scale, width, height FROM plan""")
def plan_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = fp.on_plane(d.points(spark, sf_dir), 1)
    return fp.plan_transforms(placed, size=200).select(
        "room", *[F.round(f"transform.{c}", 6).alias(c) for c in ("origin_a", "origin_b", "scale")],
        "transform.width", "transform.height",
    )


@query(_PLAN + """,
cut AS (SELECT room, quantile_cont(y, CAST(0.85 AS DOUBLE)) AS q FROM points GROUP BY room),
kept AS (
  SELECT p.*, count(*) FILTER (y <= q) OVER (PARTITION BY p.room) AS left_, q
  FROM points p JOIN cut USING (room)),
cells AS (
  SELECT k.room, r, g, b,
         least(greatest(CAST(trunc((x - a0) * scale) AS INTEGER), 0), width - 1) AS u,
         least(greatest(CAST(trunc(height - 1 - (z - b0) * scale) AS INTEGER), 0), height - 1) AS v
  FROM kept k JOIN plan USING (room) WHERE y <= q OR left_ <= 500)
SELECT room, v, u, count(*) AS n, CAST(trunc(avg(r)) AS INTEGER) AS r, CAST(trunc(avg(g)) AS INTEGER) AS g,
       CAST(trunc(avg(b)) AS INTEGER) AS b
FROM cells GROUP BY room, v, u""")
def plan_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = fp.on_plane(d.points(spark, sf_dir), 1)
    plan = durable(fp.plan_transforms(placed, size=200))
    return fp.plan_cells(fp.without_ceiling(placed, 0.15, min_kept=500), plan)


@query(_PLAN + """,
px AS (SELECT p.room, p.x, p.z, (x - a0) * scale AS u, height - 1 - (z - b0) * scale AS v, a0, b0, scale, height
       FROM points p JOIN plan USING (room))
SELECT room, count(*) AS n, round(max(abs(u / scale + a0 - x)), 6) AS off_a,
       round(max(abs((height - 1 - v) / scale + b0 - z)), 6) AS off_b, round(min(u), 4) AS min_u, round(max(v), 4) AS max_v
FROM px GROUP BY room""")
def plan_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = fp.on_plane(d.points(spark, sf_dir), 1)
    plan = durable(fp.plan_transforms(placed, size=200))
    t = F.col("transform")
    u, v = g.world_to_pixel(t, F.col("plan_a"), F.col("plan_b"))
    px = lookup_join(placed, plan, ["room"]).select("room", "plan_a", "plan_b", "transform", u.alias("u"), v.alias("v"))
    back = g.pixel_to_world(t, F.col("u"), F.col("v"))
    return px.groupBy("room").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(back[0] - F.col("plan_a"))), 6).alias("off_a"),
        F.round(F.max(F.abs(back[1] - F.col("plan_b"))), 6).alias("off_b"),
        F.round(F.min("u"), 4).alias("min_u"), F.round(F.max("v"), 4).alias("max_v"),
    )


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every observation's box as an object, and a plan transform per room."""
    seen = d.observations(spark, sf_dir)
    objects = seen.select("room", F.col("id").alias("object_id"), F.trim("label").alias("label"), "centroid", "obb")
    spots = seen.select("room", *[F.col("centroid")[i].alias(c) for i, c in enumerate("xyz")])
    return objects, durable(fp.plan_transforms(fp.on_plane(spots, 1), size=300))


_FOOT = d.with_tables("observations") + """,
bounds AS (
  SELECT room, min(cx) AS a0, max(cx) AS a1, min(cz) AS b0, max(cz) AS b1,
         greatest(max(cx) - min(cx), max(cz) - min(cz), 1e-6) * CAST(0.04 AS DOUBLE) AS pad
  FROM observations GROUP BY room),
scaled AS (
  SELECT room, a0 - pad AS a0, b0 - pad AS b0, CAST(299 AS DOUBLE) / (greatest(greatest(a1 - a0, 1e-6), greatest(b1 - b0, 1e-6)) + 0) AS s0,
         (a1 + pad) - (a0 - pad) AS wa, (b1 + pad) - (b0 - pad) AS wb FROM bounds),
plan AS (SELECT room, a0, b0, CAST(299 AS DOUBLE) / greatest(wa, wb) AS scale,
                CAST(ceil(wb * (CAST(299 AS DOUBLE) / greatest(wa, wb))) AS INTEGER) + 1 AS height FROM scaled),
corners AS (
  SELECT room, id, label, cx, cz, CAST((sx + 0.5) * 4 + (sy + 0.5) * 2 + (sz + 0.5) AS INTEGER) AS corner,
         CASE WHEN turned THEN cx + sz * e2 ELSE cx + sx * e0 END AS px,
         CASE WHEN turned THEN cz - sx * e0 ELSE cz + sz * e2 END AS pz
  FROM observations, (VALUES (-0.5), (0.5)) a(sx), (VALUES (-0.5), (0.5)) b(sy), (VALUES (-0.5), (0.5)) c(sz))
SELECT room, id AS object_id, trim(label) AS label, corner, round((px - a0) * scale, 4) AS u,
       round(height - 1 - (pz - b0) * scale, 4) AS v
FROM corners JOIN plan USING (room)"""


@query(_FOOT)
def footprint_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, plan = _boxes(spark, sf_dir)
    return fp.footprint_corners(objects, plan, 1).select(
        "room", "object_id", "label", "corner", "u", "v"
    )


_OUTLINE = _FOOT[:_FOOT.index("corners AS (")].rstrip().rstrip(",") + """
SELECT o.room, id AS object_id, trim(label) AS label, 4 AS corners,
       round((cx - a0) * scale - (CASE WHEN turned THEN e2 ELSE e0 END) / 2 * scale, 4) AS u0,
       round(height - 1 - (cz - b0) * scale - (CASE WHEN turned THEN e0 ELSE e2 END) / 2 * scale, 4) AS v0
FROM observations o JOIN plan USING (room)"""


@query(_OUTLINE)
def object_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, plan = _boxes(spark, sf_dir)
    return fp.footprints(objects, plan, 1).select(
        "room", "object_id", "label", F.size("hull").alias("corners"),
        F.col("hull")[0][0].alias("u0"), F.col("hull")[0][1].alias("v0"),
    )
