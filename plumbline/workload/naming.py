"""Queries over labels, detector replies, run logs and room documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import labels as lab
from ..functions import scores, text
from ..operators import fusion, rooms
from ..operators.sequences import previous_row
from ..plans import labelling
from ..session import durable, lookup_join
from ..streaming import runlog
from . import derive as d
from .registry import query

_GROUPS = """
builtin(name, preferred) AS (VALUES """ + ", ".join(
    f"('{n}', '{p}')" for n, p in lab.BUILTIN.items()
) + ")"


@query(d.with_tables("observations", "names") + "," + _GROUPS + """,
votes AS (
  SELECT room, name, count(*) AS n, max(CASE WHEN b.preferred = name THEN 0 ELSE 1 END) AS second
  FROM names LEFT JOIN (SELECT DISTINCT preferred FROM builtin) b ON names.name = b.preferred GROUP BY room, name),
won AS (SELECT room, name FROM votes QUALIFY row_number() OVER (PARTITION BY room ORDER BY n DESC, second, length(name), name) = 1)
SELECT w.room, w.name AS label,
       coalesce(string_agg(v.name, '|' ORDER BY v.name) FILTER (v.name <> w.name), '') AS aliases
FROM won w JOIN votes v USING (room) GROUP BY w.room, w.name""")
def label_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = lab.pick_labels(d.observations(spark, sf_dir), ["room"], "label")
    return chosen.select("room", "label", F.concat_ws("|", "aliases").alias("aliases"))


# A small synonym dimension, as a resolver would return it.
_DIMENSION = {"red widget": "widget", "blue widget": "widget", "small ring": "ring", "large ring": "ring", "big box": "box"}


@query("""
WITH dim(label, canonical) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in _DIMENSION.items()) + """)
SELECT coalesce(canonical, p_name) AS canonical, count(*) AS n, count(DISTINCT p_name) AS names
FROM part LEFT JOIN dim ON p_name = label GROUP BY 1""")
def synonym_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(list(_DIMENSION.items()), "label string, canonical string")
    mapped = lab.canonicalise(d.table(spark, sf_dir, "part").select("p_name"), "p_name", dim)
    return mapped.groupBy("canonical").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("names")
    )


_KNOWN = {"desk": "workplace", "lamp": "lamp", "table": "table"}


@query(d.with_tables("observations", "names") + "," + _GROUPS + """,
known(name, canonical) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in _KNOWN.items()) + """),
pairs AS (SELECT room, id, name AS a, lag(name) OVER (PARTITION BY room ORDER BY id) AS b FROM names)
SELECT p.room, p.id,
       CASE WHEN a = b THEN true
            WHEN ka.canonical IS NOT NULL AND kb.canonical IS NOT NULL THEN ka.canonical = kb.canonical
            ELSE coalesce(ba.preferred = bb.preferred, false) END AS meets,
       coalesce(a = b OR ba.preferred = bb.preferred, false) AS meets_static
FROM pairs p LEFT JOIN builtin ba ON a = ba.name LEFT JOIN builtin bb ON b = bb.name
     LEFT JOIN known ka ON a = ka.name LEFT JOIN known kb ON b = kb.name
WHERE b IS NOT NULL""")
def label_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = d.observations(spark, sf_dir).select("room", "id", "label")
    linked = previous_row(seen, ["room"], ["id"], ["label"]).where(F.col("prev").isNotNull())
    a, b = F.col("label"), F.col("prev.label")
    known = lambda c: lab.lookup(_KNOWN, lab.normalize(c))
    return linked.select(
        "room", "id", lab.compatible(a, b, known(a), known(b)).alias("meets"), lab.compatible(a, b).alias("meets_static")
    )


@query(d.with_tables("observations", "names") + """
SELECT string_agg('- ' || name, chr(10) ORDER BY name) AS prompt FROM (SELECT DISTINCT name FROM names)""")
def vocabulary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.vocabulary_bullets(d.observations(spark, sf_dir), "label")


_OBB = """,
boxed AS (
  SELECT room, id, frame_idx, cx, cy, cz,
         CASE WHEN turned THEN e2 ELSE e0 END / 2 AS hx, e1 / 2 AS hy, CASE WHEN turned THEN e0 ELSE e2 END / 2 AS hz
  FROM observations)"""


@query(d.with_tables("observations") + _OBB + """,
linked AS (
  SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(cz) OVER w AS pz,
         lag(hx) OVER w AS qx, lag(hy) OVER w AS qy, lag(hz) OVER w AS qz
  FROM boxed WINDOW w AS (PARTITION BY room ORDER BY id)),
parts AS (
  SELECT room, id,
         greatest(least(cx + hx, px + qx) - greatest(cx - hx, px - qx), 0) * greatest(least(cy + hy, py + qy) - greatest(cy - hy, py - qy), 0)
           * greatest(least(cz + hz, pz + qz) - greatest(cz - hz, pz - qz), 0) AS o,
         8 * hx * hy * hz AS va, 8 * qx * qy * qz AS vb
  FROM linked WHERE px IS NOT NULL)
SELECT room, id, round(CASE WHEN o > 0 THEN o / (va + vb - o) ELSE 0 END, 6) AS iou FROM parts""")
def envelope_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each sighting's envelope with that of the sighting before it."""
    seen = d.observations(spark, sf_dir).select("room", "id", g.envelope("obb").alias("env"))
    linked = previous_row(seen, ["room"], ["id"], ["env"]).where(F.col("prev").isNotNull())
    return linked.select("room", "id", F.round(g.envelope_iou("env", "prev.env"), 6).alias("iou"))


@query("""
WITH g AS (
  SELECT user_id, event_type, count(*) AS n, avg(value) AS m, least(avg(value) / 100, 1) AS vlm FROM events GROUP BY ALL),
s AS (
  SELECT e.user_id, e.event_type, any_value(n) AS n, any_value(vlm) AS vlm, avg(abs(value - m)) / 50 AS spread
  FROM events e JOIN g USING (user_id, event_type) GROUP BY ALL)
SELECT user_id, event_type, n, round(least(greatest(
         pow(1 - exp(-n / CAST(2 AS DOUBLE)), CAST(0.35 AS DOUBLE)) * pow(greatest(vlm, 1e-6), CAST(0.4 AS DOUBLE))
         * pow(exp(-spread / CAST(0.3 AS DOUBLE)), CAST(0.25 AS DOUBLE)), 0), 1), 6) AS confidence
FROM s""")
def cluster_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "event_type"]
    e = d.table(spark, sf_dir, "events").select(*keys, "value")
    means = durable(e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.least(F.avg("value") / 100, F.lit(1.0)).alias("vlm")
    ))
    spread = lookup_join(e, means, keys).groupBy(*keys, "n", "vlm").agg(
        (F.avg(F.abs(F.col("value") - F.col("m"))) / 50).alias("spread")
    )
    score = scores.object_confidence(F.col("n"), F.col("vlm"), F.col("spread"), F.lit(0.3))
    return spread.select(*keys, "n", F.round(score, 6).alias("confidence"))


@query("""
WITH replies AS (
  SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, value FROM events),
items AS (
  SELECT event_id, 0 AS position, ' ' || event_type || ' ' AS label, k * CAST(1.5 AS DOUBLE) AS b0, k * CAST(2.5 AS DOUBLE) AS b1,
         k + 100 AS b2, k + 200 AS b3, value / CAST(50 AS DOUBLE) AS c, k % 3 <> 0 AS good FROM replies
  UNION ALL
  SELECT event_id, 1, 'lamp', 10, 20, 30, 40, NULL, k % 5 <> 0 FROM replies)
SELECT event_id, position, trim(label) AS label, CAST(round_even(b0, 0) AS INTEGER) AS ymin, CAST(round_even(b1, 0) AS INTEGER) AS xmin,
       CAST(b2 AS INTEGER) AS ymax, CAST(b3 AS INTEGER) AS xmax, round(least(greatest(coalesce(c, 0.5), 0), 1), 6) AS confidence
FROM items WHERE good""")
def detector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply documents assembled from the events, with unusable entries mixed in."""
    e = d.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    num = lambda c: c.cast("string")
    k = F.col("k")
    box = F.when(
        k % 3 != 0, F.concat_ws(",", num(k * F.lit(1.5)), num(k * F.lit(2.5)), num(k + 100), num(k + 200))
    ).otherwise(F.concat_ws(",", num(k), num(k + 1), num(k + 2)))
    first = F.concat(
        F.lit('{"label": " '), F.col("event_type"), F.lit(' ", "box_2d": ['), box, F.lit('], "confidence": '),
        num(F.col("value") / F.lit(50.0)), F.lit("}"),
    )
    second = F.when(k % 5 != 0, F.lit('{"label": "lamp", "box_2d": [10, 20, 30, 40], "mask": ""}')).otherwise(
        F.lit('{"label": "lamp", "box_2d": ["a", "b", 30, 40], "confidence": 0.9}')
    )
    raw = F.concat(F.lit('{"objects": ['), first, F.lit(", "), second, F.lit("]}"))
    parsed = text.parse_replies(e.select("event_id", raw.alias("raw")))
    return parsed.select(
        "event_id", "position", "label", *[F.col("box_2d")[i].alias(n) for i, n in enumerate(("ymin", "xmin", "ymax", "xmax"))],
        F.round("confidence", 6).alias("confidence"),
    )


@query("""
SELECT c_custkey, regexp_replace(trim('  ' || CASE c_custkey % 4 WHEN 0 THEN 'models/' WHEN 1 THEN 'Google/gemini/' WHEN 2 THEN 'GEMINI/' ELSE '' END || c_name || ' '),
                      '^(?i:models/|google/|gemini/)+', '') AS model,
       coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE c_mktsegment END), ''), c_name) AS setting
FROM customer""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.array(*[F.lit(p) for p in ("models/", "Google/gemini/", "GEMINI/", "")])
    c = d.table(spark, sf_dir, "customer")
    raw = F.concat(F.lit("  "), prefix[F.pmod("c_custkey", F.lit(4)).cast("int")], F.col("c_name"), F.lit(" "))
    blank = F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    return c.select(
        "c_custkey", text.strip_model_prefix(raw).alias("model"), text.first_filled(blank, F.col("c_name")).alias("setting")
    )


_LOG = d.with_tables("run_lines") + """,
kept AS (SELECT * FROM run_lines WHERE NOT regexp_matches(line, '[0-9]+%\\|')),
marked AS (SELECT *, nullif(regexp_extract(line, '^\\s*\\[(extract|reconstruct|detect|project|cluster|label)\\]', 1), '') AS stage FROM kept)"""


@query(_LOG + """
SELECT run_id, seq, coalesce(last_value(stage IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'starting') AS stage
FROM marked""")
def run_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.stages(d.run_lines(spark, sf_dir)).select("run_id", "seq", "stage")


@query(_LOG + """,
n AS (SELECT run_id, line, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS back,
             row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS pos FROM marked)
SELECT run_id, CAST(pos AS BIGINT) AS pos, md5(line) AS line FROM n WHERE back <= 4 AND pos >= 1""")
def run_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = runlog.tail(d.run_lines(spark, sf_dir), since=1, max_lines=4)
    return lines.select("run_id", "pos", F.md5("line").alias("line"))


@query(_LOG + """,
last AS (
  SELECT run_id, arg_max(stage, seq) FILTER (stage IS NOT NULL) AS stage, count(*) AS lines, max(seq) AS last_seq FROM marked GROUP BY run_id),
coded AS (SELECT *, CASE WHEN run_id % 3 = 0 THEN 0 WHEN run_id % 3 = 1 THEN 1 END AS code, run_id % 10 = 4 AS cancelled FROM last),
st AS (SELECT *, CASE WHEN cancelled THEN 'cancelled' WHEN code IS NULL THEN 'running' WHEN code = 0 THEN 'done' ELSE 'failed' END AS status FROM coded),
fin AS (SELECT run_id, status, CASE WHEN status = 'done' THEN 'label' ELSE coalesce(stage, 'starting') END AS stage, lines FROM st)
SELECT run_id, status, stage, lines,
       CAST(coalesce(list_position(['extract', 'reconstruct', 'detect', 'project', 'cluster', 'label'], stage), 0) - 1 AS INTEGER) AS stage_index
FROM fin""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = d.run_lines(spark, sf_dir)
    kind = F.pmod("run_id", F.lit(3))
    ends = lines.select("run_id").distinct().select(
        "run_id", F.when(kind == 0, 0).when(kind == 1, 1).alias("returncode"),
        (F.pmod("run_id", F.lit(10)) == 4).alias("cancelled"),
    )
    return runlog.statuses(lines, ends).select("run_id", "status", "stage", "lines", "stage_index")


@query("""
SELECT o_custkey AS run_id, o_orderdate AS started, o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = d.table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("started"), "o_orderkey")
    return runlog.recent(runs, ["o_orderkey"])


@query("""
SELECT l.l_orderkey AS room, l.l_linenumber AS id, l.l_partkey, o.o_orderstatus AS object_id
FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l.l_orderkey = o.o_orderkey""")
def obs_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = d.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("room"), F.col("l_linenumber").alias("id"), "l_partkey")
    owners = d.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("room"), F.col("o_orderstatus").alias("object_id")
    )
    return rooms.with_owner(seen, owners, ["room"])


@query("""
SELECT l_suppkey AS object_id, count(*) AS n, list_sort(list(DISTINCT l_linenumber))::VARCHAR AS seen_in
FROM lineitem GROUP BY l_suppkey""")
def seen_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = d.table(spark, sf_dir, "lineitem")
    members = li.select(
        F.col("l_suppkey").alias("room"), F.col("l_suppkey").alias("object_id"), F.col("l_linenumber").alias("frame_idx"), F.col("l_orderkey").alias("id")
    )
    listed = fusion.with_lists(d.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("room"), F.col("s_suppkey").alias("object_id")), members)
    return listed.select(
        "object_id", F.size("observation_ids").cast("bigint").alias("n"),
        F.concat(F.lit("["), F.concat_ws(", ", F.col("seen_in").cast("array<string>")), F.lit("]")).alias("seen_in"),
    )


_OBJECTS = """
WITH objects AS (
  SELECT c_custkey AS object_id, c_nationkey AS room, lower(c_mktsegment) AS label, [c_name] AS aliases,
         CAST(greatest(c_acctbal, 0) AS DOUBLE) / 10000 AS confidence, count(o_orderkey) AS n_observations
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"""


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = d.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("object_id")).agg(F.count(F.lit(1)).alias("n"))
    c = d.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("object_id"), F.col("c_nationkey").alias("room"), F.lower("c_mktsegment").alias("label"),
        F.array("c_name").alias("aliases"), (F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 10000).alias("confidence"),
    )
    return c.join(orders, "object_id", "left").withColumn("n_observations", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")


@query(_OBJECTS + """
SELECT object_id, room, label, n_observations FROM objects
WHERE confidence >= 0.4 AND n_observations >= 3 AND (contains(label, 'build') OR contains(lower(aliases[1]), 'build')
      OR contains(label, 'mach'))""")
def visible_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _objects(spark, sf_dir)
    by_text = rooms.visible(0.4, 3, "Build") | rooms.visible(0.4, 3, "mach")
    return o.where(by_text).select("object_id", "room", "label", "n_observations")


@query(_OBJECTS + """,
shown AS (SELECT object_id FROM objects WHERE confidence >= 0.4 AND n_observations >= 3)
SELECT o_orderkey, o_custkey AS object_id, CAST((o_custkey * 47) % 360 AS INTEGER) AS hue
FROM orders SEMI JOIN shown ON o_custkey = object_id""")
def visible_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _objects(spark, sf_dir).where(rooms.visible(0.4, 3)).select("object_id")
    o = d.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("object_id"))
    return o.join(shown, "object_id", "left_semi").select(
        "o_orderkey", "object_id", scores.object_hue(F.col("object_id")).alias("hue")
    )


@query(_OBJECTS + """,
sup AS (SELECT s_nationkey AS room, count(*) AS n FROM supplier GROUP BY 1),
cus AS (SELECT c_nationkey AS room, count(*) AS n FROM customer GROUP BY 1),
ord AS (SELECT c_nationkey AS room, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT n_nationkey AS room, n_name AS name, sup.n AS n_frames, cus.n AS n_objects, ord.n AS n_observations
FROM nation LEFT JOIN sup ON n_nationkey = sup.room LEFT JOIN cus ON n_nationkey = cus.room LEFT JOIN ord ON n_nationkey = ord.room""")
def room_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = d.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("room"), F.col("n_name").alias("name"))
    customers = d.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("room"))
    orders = d.table(spark, sf_dir, "orders").select("o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    parts = {
        "frames": d.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("room")),
        "objects": customers.select("room"),
        "observations": orders.select("room"),
    }
    return rooms.room_summary(places, parts)


@query("""
WITH files AS (
  SELECT p_brand AS room, (['scene.ply', 'trajectory.txt', 'frames.npz', 'objects.json', 'observations.json', 'notes.md'])[1 + CAST((p_partkey * p_size) % 6 AS INTEGER)] AS name
  FROM part)
SELECT room, bool_or(name = 'scene.ply') AS has_scene_ply, bool_or(name = 'trajectory.txt') AS has_trajectory_txt,
       bool_or(name = 'frames.npz') AS has_frames_npz, bool_or(name = 'objects.json') AS has_objects_json,
       bool_or(name = 'observations.json') AS has_observations_json
FROM files WHERE name <> 'notes.md' GROUP BY room""")
def artifact_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in (*rooms.ARTIFACTS, "notes.md")])
    files = d.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("room"), names[F.pmod(F.col("p_partkey") * F.col("p_size"), F.lit(6)).cast("int")].alias("name")
    )
    return rooms.artifact_presence(files)


@query("""
WITH n AS (SELECT c_nationkey AS room, c_name || CASE WHEN c_custkey % 10 = 0 THEN '.txt' ELSE '.PNG' END AS name FROM customer)
SELECT room, name, CAST(row_number() OVER (PARTITION BY room ORDER BY name) - 1 AS BIGINT) AS index FROM n WHERE lower(name) LIKE '%.png'""")
def frame_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.pmod("c_custkey", F.lit(10)) == 0, ".txt").otherwise(".PNG")
    files = d.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("room"), F.concat("c_name", ending).alias("name")
    )
    return rooms.frame_listing(files).select("room", "name", "index")


@query("""
WITH o AS (SELECT c_nationkey AS room, format('obj_{:03d}', c_custkey) AS object_id, c_mktsegment AS label, c_acctbal / CAST(10000 AS DOUBLE) AS confidence FROM customer)
SELECT room, object_id, CAST(row_number() OVER w - 1 AS BIGINT) AS position, CAST(((row_number() OVER w - 1) * 47) % 360 AS INTEGER) AS hue
FROM o WINDOW w AS (PARTITION BY room ORDER BY CAST(regexp_extract(object_id, '[0-9]+$') AS BIGINT))""")
def object_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = d.table(spark, sf_dir, "customer")
    objects = c.select(F.col("c_nationkey").alias("room"), text.object_id("c_custkey").alias("object_id"))
    return rooms.with_display_position(objects).select("room", "object_id", "position", "hue")


@query("""
SELECT count(DISTINCT o_custkey) AS frames, count(*) AS detections, count(DISTINCT o_orderpriority) AS labels,
       string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS vocabulary FROM orders""")
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and vocabulary of all detections: distinct first, then one small row set."""
    o = d.table(spark, sf_dir, "orders")
    per_frame = o.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    frames = per_frame.groupBy("o_custkey").agg(F.sum("n").alias("n")).select("n", F.lit(None).cast("string").alias("word"))
    words = per_frame.select(F.lit(None).cast("bigint").alias("n"), F.col("o_orderpriority").alias("word")).distinct()
    return frames.unionByName(words).agg(
        F.count("n").alias("frames"), F.sum("n").alias("detections"), F.count("word").alias("labels"),
        F.concat_ws("|", F.array_sort(F.collect_list("word"))).alias("vocabulary"),
    )


@query("""
WITH b AS (
  SELECT vec_id, CASE WHEN vec_id % 17 = 3 THEN CAST('nan' AS DOUBLE) WHEN vec_id % 5 = 0 THEN CAST(1e-7 AS DOUBLE) ELSE abs(CAST(embedding[1] AS DOUBLE)) END AS a,
         CASE WHEN vec_id % 5 = 0 THEN CAST(1e-7 AS DOUBLE) ELSE abs(CAST(embedding[2] AS DOUBLE)) END AS b,
         CASE WHEN vec_id % 10 = 0 THEN CAST(1e-7 AS DOUBLE) ELSE abs(CAST(embedding[3] AS DOUBLE)) END AS c
  FROM embeddings)
SELECT vec_id, round(sqrt(a * a + b * b + c * c), 6) AS diagonal FROM b
WHERE isfinite(a) AND isfinite(b) AND isfinite(c) AND NOT (a <= 1e-6 AND b <= 1e-6 AND c <= 1e-6)""")
def drawable_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiny = F.lit(1e-7)
    part = lambda i, k: F.when(F.pmod("vec_id", F.lit(k)) == 0, tiny).otherwise(F.abs(F.col("embedding")[i].cast("double")))
    first = F.when(F.pmod("vec_id", F.lit(17)) == 3, F.lit(float("nan"))).otherwise(part(0, 5))
    sized = d.table(spark, sf_dir, "embeddings").select("vec_id", F.array(first, part(1, 5), part(2, 10)).alias("extent"))
    return sized.where(rooms.drawable(F.col("extent"))).select("vec_id", F.round(g.diagonal("extent"), 6).alias("diagonal"))


@query("""
SELECT o_orderkey, printf('%-18s conf=%.2f seen=%dx at [%.2f, %.2f, %.2f]', lower(o_orderpriority), sqrt((o_orderkey % 97) / CAST(97 AS DOUBLE)),
         o_orderkey % 9, sqrt(o_orderkey % 89 + CAST(0.3 AS DOUBLE)), CAST(0 AS DOUBLE), -sqrt(o_orderkey % 13 + CAST(0.7 AS DOUBLE))) AS line
FROM orders""")
def object_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = d.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    at = F.array(
        F.sqrt(F.pmod(key, F.lit(89)) + F.lit(0.3)), F.lit(0.0), -F.sqrt(F.pmod(key, F.lit(13)) + F.lit(0.7))
    )
    line = text.object_line(F.lower("o_orderpriority"), F.sqrt(F.pmod(key, F.lit(97)) / F.lit(97.0)), F.pmod(key, F.lit(9)), at)
    return o.select("o_orderkey", line.alias("line"))


@query(d.with_tables("points", "cameras") + """
SELECT p.room, c.frame_idx * 10 + c.room % 3 AS frame_id, count(*) AS n
FROM points p JOIN cameras c USING (room, frame_idx) GROUP BY ALL""")
def frame_id_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points counted by the id of the extracted frame, reached through the cameras."""
    cams = d.cameras(spark, sf_dir).withColumn("frame_id", F.col("frame_idx") * 10 + F.pmod("room", F.lit(3)))
    linked = rooms.through_frame_ids(d.points(spark, sf_dir).select("room", "frame_idx"), cams)
    return linked.groupBy("room", "frame_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS fx, CAST(CASE WHEN vec_id % 2 = 0 THEN embedding[1] ELSE embedding[2] END AS DOUBLE) AS fy,
       CAST(embedding[3] AS DOUBLE) AS px, CAST(embedding[4] AS DOUBLE) AS py, CAST(1 AS DOUBLE) AS corner
FROM embeddings""")
def intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinhole matrices; every second frame has a single focal length for both axes."""
    e = F.col("embedding")
    focals = F.when(F.pmod("vec_id", F.lit(2)) == 0, F.array(e[0])).otherwise(F.array(e[0], e[1]))
    made = d.table(spark, sf_dir, "embeddings").select("vec_id", g.intrinsics(focals, F.array(e[2], e[3])).alias("K"))
    k = F.col("K")
    return made.select(
        "vec_id", k[0].alias("fx"), k[4].alias("fy"), k[2].alias("px"), k[5].alias("py"), k[8].alias("corner")
    )


@query("""
WITH replies AS (
  SELECT event_type AS room, CASE CAST(json_extract(props, '$.k') AS BIGINT) % 5 WHEN 0 THEN NULL WHEN 1 THEN '{"objects": [' WHEN 2 THEN '{"objects": []}'
         ELSE '{"objects": [{"label": "lamp", "box_2d": [1, 2, 3, 4]}, {"label": "", "box_2d": [1, 2, 3, 4]}]}' END AS reply FROM events)
SELECT room, count(*) AS frames, count(*) FILTER (json_valid(reply)) AS answered, count(*) FILTER (NOT json_valid(reply)) AS failed,
       count(*) FILTER (reply IS NULL) AS missing, count(*) FILTER (reply LIKE '%lamp%') AS detections FROM replies GROUP BY room""")
def reply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by the outcome of their detector reply: answered, no JSON, no reply."""
    kind = F.pmod(F.get_json_object("props", "$.k").cast("bigint"), F.lit(5))
    reply = (
        F.when(kind == 1, '{"objects": [').when(kind == 2, '{"objects": []}')
        .when(kind > 2, '{"objects": [{"label": "lamp", "box_2d": [1, 2, 3, 4]}, {"label": "", "box_2d": [1, 2, 3, 4]}]}')
    )
    replies = d.table(spark, sf_dir, "events").select(F.col("event_type").alias("room"), "event_id", reply.alias("reply"))
    return labelling.reply_outcomes(replies)
