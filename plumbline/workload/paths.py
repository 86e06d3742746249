"""Queries over camera paths, frame choice and pair graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imaging
from ..operators import frames as fr
from ..operators import guards, pairs, trajectory
from ..operators.sampling import decimate
from ..operators.sequences import row_numbers
from ..session import scratch_root
from ..sources import documents
from . import derive as d
from .registry import query

_STEPS = d.with_tables("trajectory") + """,
walked AS (
  SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz
  FROM trajectory WINDOW w AS (PARTITION BY room ORDER BY ts, seq)),
steps AS (
  SELECT *, px IS NULL AS first,
         CASE WHEN px IS NULL THEN CAST(0 AS DOUBLE) ELSE round(sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)), 4) END AS step
  FROM walked)"""


def _stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = d.trajectory(spark, sf_dir)
    return trajectory.steps(path, ["room"], ["ts", "seq"])


@query(_STEPS + " SELECT room, seq, step, first, step > 0 AND step < 0.05 AS tiny FROM steps")
def trajectory_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiny = (F.col("step") > 0) & (F.col("step") < trajectory.SMALL_STEP)
    return _stepped(spark, sf_dir).select("room", "seq", "step", "first", tiny.alias("tiny"))


@query(_STEPS + """
SELECT room, count(*) AS n_poses, round(max(x) - min(x), 4) AS span_x, round(max(y) - min(y), 4) AS span_y,
       round(max(z) - min(z), 4) AS span_z, round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 4) AS span_max,
       round(sum(step), 4) AS path_length, round(coalesce(avg(step) FILTER (NOT first), 0), 4) AS mean_step,
       count(*) FILTER (step > 0 AND step < 0.05) AS small_steps,
       round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 4) < 1.0 AS too_still
FROM steps GROUP BY room""")
def trajectory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.stats(_stepped(spark, sf_dir), ["room"])


@query(d.with_tables("trajectory") + """,
linked AS (
  SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(z) OVER w AS z0
  FROM trajectory WINDOW w AS (PARTITION BY room ORDER BY ts, seq))
SELECT room, seq, x0, y0, z0, x AS x1, y AS y1, z AS z1 FROM linked WHERE x0 IS NOT NULL""")
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trajectory.segments(d.trajectory(spark, sf_dir), ["room"], ["ts", "seq"])
    return lines.select(
        "room", "seq", *[F.col(f"start.{c}").alias(f"{c}0") for c in "xyz"],
        *[F.col(f"end.{c}").alias(f"{c}1") for c in "xyz"],
    )


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders)
SELECT o_custkey AS room, o_orderkey, CAST(idx AS BIGINT) AS idx FROM f""")
def frame_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("room"), "o_orderkey", "o_orderdate")
    return row_numbers(o, ["room"], ["o_orderdate", "o_orderkey"]).select("room", "o_orderkey", "idx")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the frames of its video, in time order."""
    e = d.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("room"), F.col("event_id"), "ts", F.col("value").alias("sharpness")
    )
    return row_numbers(e, ["room"], ["ts", "event_id"])


_FRAMES_SQL = """
WITH frames AS (
  SELECT user_id AS room, event_id, value AS sharpness,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events),
windows AS (SELECT *, idx * least(24, n) // n AS bucket FROM frames),
picked AS (
  SELECT room, bucket, idx, sharpness FROM windows
  QUALIFY row_number() OVER (PARTITION BY room, bucket ORDER BY sharpness DESC, idx) = 1)"""


@query(_FRAMES_SQL + " SELECT room, CAST(bucket AS BIGINT) AS bucket, CAST(idx AS BIGINT) AS idx, sharpness FROM picked")
def window_sharpest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.sharpest_per_window(_frames(spark, sf_dir), 24)


@query(_FRAMES_SQL + """,
spare AS (
  SELECT f.room, f.idx, row_number() OVER (PARTITION BY f.room ORDER BY f.idx) - 1 AS pos
  FROM frames f ANTI JOIN picked p ON f.room = p.room AND f.idx = p.idx)
SELECT room, CAST(idx AS BIGINT) AS idx, CAST(pos AS BIGINT) AS pos FROM spare WHERE pos % 3 = 0""")
def spare_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    chosen = fr.sharpest_per_window(frames, 24).withColumnRenamed("idx", "frame_idx")
    spare = fr.spare_frames(frames.select("room", F.col("idx").alias("frame_idx")), chosen)
    return (
        row_numbers(spare, ["room"], ["frame_idx"], name="pos")
        .where(F.col("pos") % 3 == 0).select("room", F.col("frame_idx").alias("idx"), "pos")
    )


@query(_FRAMES_SQL + """,
cut AS (SELECT room, quantile_cont(sharpness, 0.25) AS floor FROM frames GROUP BY room)
SELECT f.room, round(any_value(c.floor), 6) AS blur_floor,
       CAST(count(*) FILTER (f.sharpness >= c.floor) AS BIGINT) AS usable
FROM frames f JOIN cut c USING (room) GROUP BY f.room""")
def blur_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.quantiles import exact_quantiles
    from ..session import durable, lookup_join

    frames = d.table(spark, sf_dir, "events").select(F.col("user_id").alias("room"), F.col("value").alias("sharpness"))
    cuts = durable(exact_quantiles(frames, ["room"], {"floor": ("sharpness", 0.25)}))
    return lookup_join(frames, cuts, ["room"]).groupBy("room").agg(
        F.round(F.first("floor"), 6).alias("blur_floor"),
        F.count_if(F.col("sharpness") >= F.col("floor")).alias("usable"),
    )


_COR = "least(greatest(list_dot_product(CAST(c.thumb AS DOUBLE[]), CAST(p.thumb AS DOUBLE[])), -1), 1)"


@query(f"""
WITH RECURSIVE f AS (
  SELECT CAST(label AS BIGINT) AS room, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding AS thumb,
         CAST(abs(embedding[6]) * CAST(100 AS FLOAT) AS DOUBLE) AS sharpness, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
cut AS (SELECT room, quantile_cont(sharpness, 0.25) AS floor FROM f GROUP BY room),
w AS (SELECT f.*, idx * least(8, n) // n AS bucket, sharpness >= floor AS fine FROM f JOIN cut USING (room) WHERE n > 4),
cand AS (SELECT * FROM (SELECT *, bool_or(fine) OVER (PARTITION BY room, bucket) AS any_fine FROM w) WHERE fine OR NOT any_fine),
pick AS (
  SELECT 1 AS step, room, bucket, idx, thumb FROM cand QUALIFY row_number() OVER (PARTITION BY room ORDER BY bucket, sharpness DESC, idx) = 1
  UNION ALL
  SELECT p.step + 1, c.room, c.bucket, c.idx, c.thumb FROM pick p JOIN cand c ON c.room = p.room AND c.bucket > p.bucket AND {_COR} <= 0.2
  WHERE p.step < 8 QUALIFY row_number() OVER (PARTITION BY c.room ORDER BY c.bucket, c.sharpness DESC, c.idx) = 1),
kept AS (SELECT room, count(*) AS k FROM pick GROUP BY room),
spare AS (
  SELECT w.room, w.idx, row_number() OVER (PARTITION BY w.room ORDER BY sharpness DESC, w.idx) AS r
  FROM w ANTI JOIN pick p ON w.room = p.room AND w.idx = p.idx)
SELECT room, CAST(idx AS BIGINT) AS idx FROM pick
UNION ALL SELECT s.room, CAST(s.idx AS BIGINT) FROM spare s JOIN kept USING (room) WHERE r <= 4 - k
UNION ALL SELECT room, CAST(idx AS BIGINT) FROM f WHERE n <= 4""")
def frame_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame choice with near-duplicate rejection, vectors as thumbnails of a label's video."""
    e = d.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("room"), "vec_id", F.col("embedding").alias("thumb"),
        (F.abs(F.col("embedding")[5]) * 100).cast("double").alias("sharpness"),
    )
    features = row_numbers(e, ["room"], ["vec_id"]).withColumn("idx", F.col("idx"))
    kept = fr.select_frames(features, 8, dedup_correlation=0.2)
    return kept.select("room", "idx")


_D3 = "sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) + (c.z - p.z) * (c.z - p.z))"


@query(d.with_tables("trajectory").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
c AS (SELECT room, row_number() OVER (PARTITION BY room ORDER BY ts, seq) - 1 AS f, x, y, z,
             count(*) OVER (PARTITION BY room) AS n FROM trajectory),
p AS (SELECT room, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM c GROUP BY room),
start AS (
  SELECT c.* FROM c JOIN p USING (room) WHERE n > 12
  QUALIFY row_number() OVER (PARTITION BY c.room ORDER BY {_D3}, f) = 1),
walk AS (
  SELECT 1 AS step, c.room, c.f, c.x, c.y, c.z, CASE WHEN c.f = p.f THEN -1 ELSE {_D3} END AS d
  FROM c JOIN start p ON c.room = p.room
  UNION ALL
  SELECT step + 1, c.room, c.f, c.x, c.y, c.z, CASE WHEN c.d < 0 OR c.f = p.f THEN -1 ELSE least(c.d, {_D3}) END
  FROM (SELECT *, first_value({{'f': f, 'x': x, 'y': y, 'z': z}}) OVER (PARTITION BY room ORDER BY d DESC, f) AS p FROM walk) c
  WHERE step < 12)
SELECT room, CAST(f AS BIGINT) AS frame_idx FROM c WHERE n <= 12
UNION ALL SELECT room, CAST(f AS BIGINT) FROM walk WHERE step = 12 AND d < 0""")
def covering_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farthest-point frames of every user's path."""
    path = row_numbers(d.trajectory(spark, sf_dir), ["room"], ["ts", "seq"], name="frame_idx")
    one, zero = F.lit(1.0), F.lit(0.0)
    pose = F.array(one, zero, zero, F.col("x"), zero, one, zero, F.col("y"), zero, zero, one, F.col("z"), zero, zero, zero, one)
    return fr.covering_frames(path.select("room", "frame_idx", pose.alias("pose")), 12)


_NATION_FRAMES = """
WITH frames AS (
  SELECT c_nationkey AS room, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS frame_idx
  FROM customer),
sizes AS (SELECT room, count(*) AS n FROM frames GROUP BY room)"""


def _nation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("room"), "c_custkey")
    return row_numbers(c, ["room"], ["c_custkey"], name="frame_idx")


@query(_NATION_FRAMES + """
SELECT a.room, CAST(a.frame_idx AS BIGINT) AS i, CAST(b.frame_idx AS BIGINT) AS j
FROM frames a JOIN frames b ON a.room = b.room AND a.frame_idx <> b.frame_idx AND abs(a.frame_idx - b.frame_idx) <= 3""")
def swin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.swin_pairs(_nation_frames(spark, sf_dir), 3)


@query(_NATION_FRAMES + """,
banded AS (
  SELECT room, count(*) AS n_frames, CAST(sum(2 * least(3, n - 1 - frame_idx)) AS BIGINT) AS swin_pairs
  FROM frames JOIN sizes USING (room) GROUP BY room)
SELECT room, n_frames, swin_pairs, CAST(n_frames * (n_frames - 1) AS BIGINT) AS complete_pairs,
       round(swin_pairs * CAST(13.5 AS DOUBLE) / 60 + n_frames * CAST(0.5 AS DOUBLE), 4) AS minutes
FROM banded""")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_counts(_nation_frames(spark, sf_dir), 3)


@query("""
WITH images AS (SELECT p_type AS room, p_partkey AS idx, p_size % 3 AS h, CAST(p_retailprice AS BIGINT) % 2 AS w FROM part),
counts AS (SELECT room, h, w, count(*) AS n, min(idx) AS f FROM images GROUP BY ALL),
majority AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY room ORDER BY n DESC, f) = 1)
SELECT i.room, i.h, i.w, i.idx AS source_idx,
       CAST(row_number() OVER (PARTITION BY i.room ORDER BY i.idx) - 1 AS BIGINT) AS idx
FROM images i JOIN majority m ON i.room = m.room AND i.h = m.h AND i.w = m.w""")
def uniform_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = d.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("room"), F.col("p_partkey").alias("idx"), F.pmod("p_size", F.lit(3)).alias("h"),
        F.pmod(F.rint("p_retailprice").cast("bigint"), F.lit(2)).alias("w"),
    )
    return guards.uniform_shape(images, allow_mixed=True).select("room", "h", "w", "source_idx", "idx")


@query("""
WITH drawn AS (SELECT l_returnflag AS room, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
                      (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709 + l_linenumber * 15485863) * 40503 % 4294967296 AS draw FROM lineitem)
SELECT room, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM drawn
QUALIFY row_number() OVER (PARTITION BY room ORDER BY draw, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) <= 1000""")
def decimate_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-size repeatable sample of the points of each of a few very large rooms."""
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    rows = d.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("room"), *cols)
    mixed = (
        F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 1299709
        + F.col("l_linenumber") * F.lit(15485863).cast("bigint")
    )
    return decimate(rows, ["room"], 1000, cols, draw=F.pmod(mixed * 40503, F.lit(1 << 32)))


@query("""
WITH v AS (
  SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings)
SELECT label, vec_id, round(least(greatest(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(prev AS DOUBLE[])), -1), 1), 6) AS correlation
FROM v WHERE prev IS NOT NULL""")
def neighbour_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of every vector with the one before it under its label."""
    from ..operators.sequences import previous_row

    e = d.table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    linked = previous_row(e, ["label"], ["vec_id"], ["embedding"]).where(F.col("prev").isNotNull())
    return linked.select(
        "label", "vec_id", F.round(imaging.correlation("embedding", "prev.embedding"), 6).alias("correlation")
    )


@query("""
WITH p AS (SELECT l_suppkey AS room, l_quantity AS x, l_extendedprice / CAST(1000 AS DOUBLE) AS y, l_discount AS z FROM lineitem),
f AS (SELECT room, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span FROM p GROUP BY room)
SELECT room, round(any_value(CASE WHEN span <= 1e-9 THEN 1 ELSE 4 / span END), 9) AS factor,
       round(max(x * 4 / span), 6) AS max_x, round(max(y * 4 / span), 6) AS max_y, count(*) AS n
FROM p JOIN f USING (room) GROUP BY room""")
def rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import lookup_join

    pts = d.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("room"), F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000.0).alias("y"), F.col("l_discount").alias("z"),
    )
    scaled, _, factors = guards.rescale(pts, d.cameras(spark, sf_dir), 4.0)
    return lookup_join(scaled, factors, ["room"]).groupBy("room").agg(
        F.round(F.first("factor"), 9).alias("factor"), F.round(F.max("x"), 6).alias("max_x"),
        F.round(F.max("y"), 6).alias("max_y"), F.count(F.lit(1)).alias("n"),
    )


@query(_FRAMES_SQL + """,
spare AS (
  SELECT f.room, f.idx, row_number() OVER (PARTITION BY f.room ORDER BY f.idx) - 1 AS pos
  FROM frames f ANTI JOIN picked p ON f.room = p.room AND f.idx = p.idx)
SELECT room, CAST(idx AS BIGINT) AS idx FROM picked UNION SELECT room, CAST(idx AS BIGINT) FROM spare WHERE pos % 3 = 0""")
def frame_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen frames topped up with every third spare one."""
    chosen = window_sharpest(spark, sf_dir).select("room", "idx")
    return chosen.unionByName(spare_frames(spark, sf_dir).select("room", "idx")).distinct()


@query(d.with_tables("cameras") + f"""
SELECT room, CAST(frame_idx - 1 AS INTEGER) AS idx, CAST(frame_idx AS DOUBLE) AS t, ex AS x, ey AS y, ez AS z,
       CAST(0 AS DOUBLE) AS qx, CAST(1 AS DOUBLE) AS qw FROM cameras""")
def trajectory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every room's camera path written as a trajectory file and read back."""
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    documents.write_trajectories(d.cameras(spark, sf_dir), path)
    back = documents.read_trajectories(spark, f"{path}/*/trajectory.txt")
    return back.select(
        F.col("room").cast("bigint").alias("room"), F.col("index").alias("idx"), "t",
        *[F.col("position")[i].alias(c) for i, c in enumerate("xyz")], F.col("quaternion")[0].alias("qx"), F.col("quaternion")[3].alias("qw"),
    )
