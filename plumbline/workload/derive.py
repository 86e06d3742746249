"""Scene tables derived from the supplied benchmark tables.

The supplied tables hold no rooms, so every scene table is computed from whole tables
with arithmetic that any SQL engine evaluates alike. Rooms, frames and detections grow
with the data: a room is a supplier, customer or user, so room sizes stay level while
their number follows the scale factor. `SQL` states the same derivations for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Image size of the derived frames and frames per room.
HEIGHT, WIDTH, FRAMES = 11, 50, 7
LABELS = ("Monitor", "computer_screen", "desk", " Table ", "lamp", "Couch")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("room"),
        F.col("l_linenumber").alias("frame_idx"),
        (F.col("l_quantity").cast("int") - 1).alias("u"),
        F.round(F.col("l_discount") * 100).cast("int").alias("v"),
        (F.col("l_quantity") / F.lit(10.0)).alias("x"),
        (F.col("l_discount") * F.lit(10.0)).alias("y"),
        (F.col("l_extendedprice") / F.lit(10000.0)).alias("z"),
        (F.col("l_returnflag") != "R").alias("conf"),
        F.pmod("l_partkey", F.lit(256)).cast("int").alias("r"),
        F.pmod("l_orderkey", F.lit(256)).cast("int").alias("g"),
        F.pmod(F.col("l_partkey") * 3 + F.col("l_orderkey"), F.lit(256)).cast("int").alias("b"),
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("room"), "s_nationkey",
        F.explode(F.sequence(F.lit(1), F.lit(FRAMES))).alias("frame_idx"),
    )
    cells = [F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)]
    cells[3] = F.col("frame_idx") * F.lit(0.1)
    cells[7] = F.col("s_nationkey") * F.lit(0.01)
    return base.select(
        "room", "frame_idx", F.array(*cells).alias("pose"), F.lit(HEIGHT).alias("h"), F.lit(WIDTH).alias("w")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("room"), "s_nationkey",
        F.explode(F.sequence(F.lit(1), F.lit(FRAMES))).alias("frame_idx"),
    ).withColumn("det_id", F.explode(F.sequence(F.lit(0), F.lit(1))))
    xmin = F.pmod(F.col("room") * 37 + F.col("frame_idx") * 101 + F.col("det_id") * 300, F.lit(600))
    ymin = F.pmod(F.col("room") * 13 + F.col("det_id") * 50, F.lit(300))
    names = F.array(*[F.lit(n) for n in LABELS])
    return base.select(
        "room", "frame_idx", "det_id",
        names[F.pmod(F.col("s_nationkey") + F.col("det_id"), F.lit(len(LABELS))).cast("int")].alias("label"),
        F.array(ymin, xmin, ymin + 700, xmin + 400).cast("array<int>").alias("box_2d"),
        (F.lit(0.5) + F.pmod(F.col("room") * 7 + F.col("frame_idx") * 3 + F.col("det_id"), F.lit(50)) / F.lit(100.0)).alias("confidence"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per order; ten customers share a room."""
    o = table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(n) for n in LABELS])
    turn = F.pmod("o_orderkey", F.lit(2)) == 1
    one, zero = F.lit(1.0), F.lit(0.0)
    axes = F.when(
        turn, F.array(F.array(zero, zero, one), F.array(zero, one, zero), F.array(-one, zero, zero))
    ).otherwise(F.array(F.array(one, zero, zero), F.array(zero, one, zero), F.array(zero, zero, one)))
    center = F.array(
        F.floor(F.col("o_totalprice") / 60000.0) * 0.9 + F.pmod("o_orderkey", F.lit(11)) * 0.04,
        F.pmod("o_orderkey", F.lit(3)) * 0.05,
        F.pmod("o_custkey", F.lit(5)) * 0.1,
    )
    extent = F.array(
        F.lit(0.2) + F.pmod("o_orderkey", F.lit(9)) * 0.1,
        F.lit(0.3) + F.pmod("o_orderkey", F.lit(4)) * 0.1,
        F.lit(0.25) + F.pmod("o_orderkey", F.lit(6)) * 0.05,
    )
    return o.select(
        F.floor(F.col("o_custkey") / 10).alias("room"),
        F.col("o_orderkey").alias("id"),
        F.pmod("o_orderkey", F.lit(8)).cast("int").alias("frame_idx"),
        names[F.pmod(F.floor(F.col("o_orderkey") / 3), F.lit(len(LABELS))).cast("int")].alias("label"),
        (F.lit(0.3) + F.pmod("o_orderkey", F.lit(60)) / 100.0).alias("vlm_confidence"),
        center.alias("centroid"),
        F.struct(center.alias("center"), extent.alias("extent"), axes.alias("R")).alias("obb"),
        (F.pmod("o_orderkey", F.lit(500)) + 40).cast("int").alias("n_points"),
    )


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera positions per user, ordered by `(ts, seq)`."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("room"), F.col("event_id").alias("seq"), "ts",
        (F.col("value") / 10.0).alias("x"),
        F.length("event_type").cast("double").alias("y"),
        F.pmod("event_id", F.lit(7)).cast("double").alias("z"),
    )


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines: a conversation is a run, a turn a line, markers by role and turn."""
    from ..functions.text import STAGES

    c = table(spark, sf_dir, "conversations")
    stage = F.array(*[F.lit(s) for s in STAGES])[F.pmod("turn", F.lit(len(STAGES))).cast("int")]
    line = (
        F.when(F.col("role") == "user", F.concat(F.lit("  ["), stage, F.lit("] "), F.col("text")))
        .when(F.pmod("turn", F.lit(5)) == 3, F.concat(F.lit(" 42%|## "), F.col("text")))
        .otherwise(F.col("text"))
    )
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), line.alias("line"))


_LABEL_LIST = "[" + ", ".join("'" + n + "'" for n in LABELS) + "]"

SQL = {
    "points": """
points AS (
  SELECT l_suppkey AS room, l_linenumber AS frame_idx,
         CAST(l_quantity AS INTEGER) - 1 AS u, CAST(round(l_discount * 100) AS INTEGER) AS v,
         l_quantity / CAST(10 AS DOUBLE) AS x, l_discount * CAST(10 AS DOUBLE) AS y,
         l_extendedprice / CAST(10000 AS DOUBLE) AS z, l_returnflag <> 'R' AS conf,
         CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_orderkey % 256 AS INTEGER) AS g,
         CAST((l_partkey * 3 + l_orderkey) % 256 AS INTEGER) AS b
  FROM lineitem)""",
    "cameras": f"""
cameras AS (
  SELECT s_suppkey AS room, CAST(f AS INTEGER) AS frame_idx,
         f * CAST(0.1 AS DOUBLE) AS ex, s_nationkey * CAST(0.01 AS DOUBLE) AS ey, CAST(0 AS DOUBLE) AS ez,
         {HEIGHT} AS h, {WIDTH} AS w
  FROM supplier, range(1, {FRAMES + 1}) t(f))""",
    "detections": f"""
detections AS (
  SELECT s_suppkey AS room, CAST(f AS INTEGER) AS frame_idx, CAST(d AS INTEGER) AS det_id,
         ({_LABEL_LIST})[1 + CAST((s_nationkey + d) % {len(LABELS)} AS INTEGER)] AS label,
         (s_suppkey * 13 + d * 50) % 300 AS ymin, (s_suppkey * 37 + f * 101 + d * 300) % 600 AS xmin,
         (s_suppkey * 13 + d * 50) % 300 + 700 AS ymax, (s_suppkey * 37 + f * 101 + d * 300) % 600 + 400 AS xmax,
         CAST(0.5 AS DOUBLE) + ((s_suppkey * 7 + f * 3 + d) % 50) / CAST(100 AS DOUBLE) AS confidence
  FROM supplier, range(1, {FRAMES + 1}) t(f), range(0, 2) s(d))""",
    "observations": f"""
observations AS (
  SELECT o_custkey // 10 AS room, o_orderkey AS id, CAST(o_orderkey % 8 AS INTEGER) AS frame_idx,
         ({_LABEL_LIST})[1 + CAST((o_orderkey // 3) % {len(LABELS)} AS INTEGER)] AS label,
         CAST(0.3 AS DOUBLE) + (o_orderkey % 60) / CAST(100 AS DOUBLE) AS vlm_confidence,
         floor(o_totalprice / CAST(60000 AS DOUBLE)) * CAST(0.9 AS DOUBLE) + (o_orderkey % 11) * CAST(0.04 AS DOUBLE) AS cx,
         (o_orderkey % 3) * CAST(0.05 AS DOUBLE) AS cy, (o_custkey % 5) * CAST(0.1 AS DOUBLE) AS cz,
         CAST(0.2 AS DOUBLE) + (o_orderkey % 9) * CAST(0.1 AS DOUBLE) AS e0,
         CAST(0.3 AS DOUBLE) + (o_orderkey % 4) * CAST(0.1 AS DOUBLE) AS e1,
         CAST(0.25 AS DOUBLE) + (o_orderkey % 6) * CAST(0.05 AS DOUBLE) AS e2,
         o_orderkey % 2 = 1 AS turned,
         CAST(o_orderkey % 500 + 40 AS INTEGER) AS n_points
  FROM orders)""",
    "trajectory": """
trajectory AS (
  SELECT user_id AS room, event_id AS seq, ts, value / CAST(10 AS DOUBLE) AS x,
         CAST(length(event_type) AS DOUBLE) AS y, CAST(event_id % 7 AS DOUBLE) AS z
  FROM events)""",
    "run_lines": """
run_lines AS (
  SELECT conv_id AS run_id, turn AS seq,
         CASE WHEN role = 'user' THEN '  [' || (['extract', 'reconstruct', 'detect', 'project', 'cluster', 'label'])[1 + CAST(turn % 6 AS INTEGER)] || '] ' || text
              WHEN turn % 5 = 3 THEN ' 42%|## ' || text ELSE text END AS line
  FROM conversations)""",
    "names": """
names AS (
  SELECT *, trim(regexp_replace(lower(label), '[_\\s\\p{Z}]+', ' ', 'g')) AS name FROM observations)""",
}


def with_tables(*names: str) -> str:
    """`WITH` clause defining the named derived tables."""
    return "WITH " + ",".join(SQL[n] for n in names)
