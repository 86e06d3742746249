"""Queries that lift detections and split depths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.boxes import moment_aggregates, oriented_boxes
from ..operators.islands import dominant_run, value_runs
from ..operators.lift import BOX, SEARCH, detection_boxes, lift
from ..operators.quantiles import finite
from . import derive as d
from .registry import query

_PIXEL_BOX = """
pixel_boxes AS (
  SELECT room, frame_idx, det_id, label, confidence, h, w, ex, ey, ez,
         least(greatest(CAST(floor(xmin / CAST(1000 AS DOUBLE) * w) AS INTEGER), 0), w - 1) AS x0,
         least(greatest(CAST(floor(ymin / CAST(1000 AS DOUBLE) * h) AS INTEGER), 0), h - 1) AS y0,
         least(CAST(ceil(xmax / CAST(1000 AS DOUBLE) * w) AS INTEGER), w) AS x1,
         least(CAST(ceil(ymax / CAST(1000 AS DOUBLE) * h) AS INTEGER), h) AS y1
  FROM detections JOIN cameras USING (room, frame_idx)),
search_boxes AS (
  SELECT *, CASE WHEN x0 > 0 THEN x0 + 1 ELSE x0 END AS a0, CASE WHEN y0 > 0 THEN y0 + 1 ELSE y0 END AS b0,
         CASE WHEN x1 < w THEN x1 - 1 ELSE x1 END AS a1, CASE WHEN y1 < h THEN y1 - 1 ELSE y1 END AS b1
  FROM pixel_boxes)"""


@query(
    d.with_tables("points", "cameras", "detections")
    + ","
    + _PIXEL_BOX
    + """,
hits AS (
  SELECT s.*, p.x, p.y, p.z,
         sqrt((p.x - ex) * (p.x - ex) + (p.y - ey) * (p.y - ey) + (p.z - ez) * (p.z - ez)) AS depth
  FROM search_boxes s JOIN points p USING (room, frame_idx)
  WHERE p.conf AND p.u >= a0 AND p.u < a1 AND p.v >= b0 AND p.v < b1),
flagged AS (
  SELECT *, CASE WHEN depth - lag(depth) OVER w > CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS brk
  FROM hits WINDOW w AS (PARTITION BY room, frame_idx, det_id ORDER BY depth)),
numbered AS (
  SELECT *, sum(brk) OVER (PARTITION BY room, frame_idx, det_id ORDER BY depth) AS run FROM flagged),
runs AS (
  SELECT room, frame_idx, det_id, run, count(*) AS n, min(depth) AS lo
  FROM numbered GROUP BY ALL),
best AS (
  SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY room, frame_idx, det_id ORDER BY n DESC, lo) = 1)
SELECT room, frame_idx, det_id, any_value(trim(label)) AS label, any_value(confidence) AS vlm_confidence,
       round(median(x), 8) AS cx, round(median(y), 8) AS cy, round(median(z), 8) AS cz,
       CAST(count(*) AS BIGINT) AS n_points,
       round(count(*) / CAST(any_value((x1 - x0) * (y1 - y0)) AS DOUBLE), 6) AS support,
       any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1
FROM numbered JOIN best USING (room, frame_idx, det_id, run)
GROUP BY room, frame_idx, det_id
HAVING count(*) >= 5"""
)
def lift_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = lift(
        d.points(spark, sf_dir), d.cameras(spark, sf_dir), d.detections(spark, sf_dir),
        erode_px=1, depth_eps=0.5, min_points=5, with_box=False,
    )
    return seen.select(
        "room", "frame_idx", "det_id", F.trim("label").alias("label"), "vlm_confidence",
        *[F.round(F.col("centroid")[i], 8).alias(n) for i, n in enumerate(("cx", "cy", "cz"))],
        "n_points", F.round("support", 6).alias("support"),
        *[F.col("box_px")[i].alias(n) for i, n in enumerate(BOX)],
    )


def _cov(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def _less(i: int, j: int) -> str:
    return f"({_cov(i, j)} - e)" if i == j else _cov(i, j)


def _cross(a: int, b: int) -> str:
    parts = [f"{_less(a, (k + 1) % 3)} * {_less(b, (k + 2) % 3)} - {_less(a, (k + 2) % 3)} * {_less(b, (k + 1) % 3)}" for k in range(3)]
    return "[" + ", ".join(parts) + "]"


@query(d.with_tables("points") + f""",
m AS (
  SELECT room, count(*) AS n, covar_pop(x, x) AS c00, covar_pop(x, y) AS c01, covar_pop(x, z) AS c02, covar_pop(y, y) AS c11,
         covar_pop(y, z) AS c12, covar_pop(z, z) AS c22 FROM points WHERE conf GROUP BY room),
q AS (SELECT *, (c00 + c11 + c22) / 3 AS q FROM m),
p AS (SELECT *, sqrt(((c00 - q) ** 2 + (c11 - q) ** 2 + (c22 - q) ** 2 + 2 * (c01 * c01 + c02 * c02 + c12 * c12)) / 6) AS p FROM q),
phi AS (
  SELECT *, acos(least(greatest(((c00 - q) * ((c11 - q) * (c22 - q) - c12 * c12) - c01 * (c01 * (c22 - q) - c12 * c02)
                                 + c02 * (c01 * c12 - (c11 - q) * c02)) / (p * p * p) / 2, -1), 1)) / 3 AS phi FROM p),
spectrum AS (SELECT *, unnest([q + 2 * p * cos(phi), q + 2 * p * cos(phi + 2 * pi() / 3), q + 2 * p * cos(phi + 4 * pi() / 3)]) AS e FROM phi),
made AS (SELECT room, n, e, unnest([{_cross(0, 1)}, {_cross(0, 2)}, {_cross(1, 2)}]) AS v FROM spectrum),
axis AS (
  SELECT room, n, e, list_transform(v, lambda t: t / sqrt(list_dot_product(v, v))) AS v FROM made
  QUALIFY row_number() OVER (PARTITION BY room, e ORDER BY list_dot_product(v, v) DESC) = 1),
spans AS (
  SELECT a.room, a.e, any_value(n) AS n, max(a.v[1] * x + a.v[2] * y + a.v[3] * z) - min(a.v[1] * x + a.v[2] * y + a.v[3] * z) AS s
  FROM axis a JOIN points p ON a.room = p.room WHERE conf GROUP BY a.room, a.e),
boxes AS (SELECT room, any_value(n) AS n, list_sort(list(s)) AS s FROM spans GROUP BY room)
SELECT room, n AS n_points, round(s[1], 4) AS extent_0, round(s[2], 4) AS extent_1, round(s[3], 4) AS extent_2,
       round(sqrt(s[1] * s[1] + s[2] * s[2] + s[3] * s[3]), 4) AS diagonal
FROM boxes""")
def fit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oriented boxes of every room's confident points."""
    pts = d.points(spark, sf_dir).where("conf")
    return oriented_boxes(pts, ["room"]).select(
        "room", F.col("n").alias("n_points"),
        *[F.round(F.array_sort("obb.extent")[i], 4).alias(f"extent_{i}") for i in range(3)],
        F.round(g.diagonal("obb.extent"), 4).alias("diagonal"),
    )


@query(
    d.with_tables("cameras", "detections")
    + ","
    + _PIXEL_BOX
    + """
SELECT room, frame_idx, det_id, x0, y0, x1, y1,
       CASE WHEN a1 > a0 AND b1 > b0 THEN a0 ELSE x0 END AS sx0,
       CASE WHEN a1 > a0 AND b1 > b0 THEN b0 ELSE y0 END AS sy0,
       CASE WHEN a1 > a0 AND b1 > b0 THEN a1 ELSE x1 END AS sx1,
       CASE WHEN a1 > a0 AND b1 > b0 THEN b1 ELSE y1 END AS sy1,
       CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS n_requested
FROM search_boxes"""
)
def descale_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = detection_boxes(d.detections(spark, sf_dir), d.cameras(spark, sf_dir), 1)
    return boxes.select(
        "room", "frame_idx", "det_id",
        *BOX, *SEARCH,
        "n_requested",
    )


@query("""
WITH flagged AS (
  SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS brk
  FROM events),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY value) AS run FROM flagged),
runs AS (SELECT user_id, run, count(*) AS n, min(value) AS lo, max(value) AS hi FROM numbered GROUP BY ALL)
SELECT user_id, lo, hi, CAST(n AS BIGINT) AS n FROM runs
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, lo) = 1""")
def depth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = d.table(spark, sf_dir, "events").select("user_id", "value")
    return dominant_run(value_runs(events, ["user_id"], "value", 0.5), ["user_id"])


@query("""
WITH parts AS (
  SELECT vec_id, CASE WHEN vec_id % 17 = 3 THEN CAST('nan' AS DOUBLE) WHEN vec_id % 19 = 4 THEN CAST('inf' AS DOUBLE)
                      ELSE CAST(embedding[1] AS DOUBLE) END AS x,
         CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label
  FROM embeddings)
SELECT label, CAST(count(*) AS BIGINT) AS n, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x
FROM parts WHERE label % 2 = 0 AND isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY label""")
def finite_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.table(spark, sf_dir, "embeddings")
    x = (
        F.when(F.pmod("vec_id", F.lit(17)) == 3, F.lit(float("nan")))
        .when(F.pmod("vec_id", F.lit(19)) == 4, F.lit(float("inf")))
        .otherwise(F.col("embedding")[0].cast("double"))
    )
    parts = e.select(
        "label", x.alias("x"), F.col("embedding")[1].cast("double").alias("y"),
        F.col("embedding")[2].cast("double").alias("z"), (F.pmod("label", F.lit(2)) == 0).alias("conf"),
    )
    return (
        parts.where(F.col("conf") & finite(F.col("x"), F.col("y"), F.col("z")))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 6).alias("min_x"), F.round(F.max("x"), 6).alias("max_x"))
    )


@query(d.with_tables("points") + """
SELECT room, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz,
       round(covar_pop(x, x), 6) AS xx, round(covar_pop(x, y), 6) AS xy, round(covar_pop(x, z), 6) AS xz,
       round(covar_pop(y, y), 6) AS yy, round(covar_pop(y, z), 6) AS yz, round(covar_pop(z, z), 6) AS zz
FROM points WHERE conf GROUP BY room""")
def box_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable first pass of the principal-axis boxes."""
    pts = d.points(spark, sf_dir).where("conf")
    stats = pts.groupBy("room").agg(F.count(F.lit(1)).alias("n"), *moment_aggregates(("x", "y", "z")))
    names = {"c00": "xx", "c01": "xy", "c02": "xz", "c11": "yy", "c12": "yz", "c22": "zz"}
    return stats.select(
        "room", "n", *[F.round(F.col("mean")[i], 6).alias(f"m{c}") for i, c in enumerate("xyz")],
        *[F.round(c, 6).alias(n) for c, n in names.items()],
    )
