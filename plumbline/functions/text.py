"""Text expressions: detector replies, log markers, names and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import as_col

# Log stages in order, further markers that do not set a stage, and the
# routing prefixes a model name may carry.
STAGES = ("extract", "reconstruct", "detect", "project", "cluster", "label")
OTHER_MARKERS = ("semantics", "frames")
MODEL_PREFIXES = ("models/", "google/", "gemini/")

REPLY_SCHEMA = T.StructType([
    T.StructField("objects", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()),
        T.StructField("box_2d", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.StringType()),
        T.StructField("mask", T.StringType()),
    ]))),
])


def strip(value: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(as_col(value), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def strip_model_prefix(name: Column | str) -> Column:
    """Trim, then drop any run of routing prefixes, whatever their case."""
    pattern = "^(?i)(?:" + "|".join(MODEL_PREFIXES) + ")+"
    return F.regexp_replace(strip(name), pattern, "")


def first_filled(*names: Column) -> Column:
    """First value that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(strip(n), F.lit("")) for n in names])


def log_marker(line: Column | str) -> Column:
    """Stage named by a leading `[stage]`, else null."""
    pattern = r"^\s*\[(" + "|".join((*STAGES, *OTHER_MARKERS)) + r")\]"
    return F.nullif(F.regexp_extract(as_col(line), pattern, 1), F.lit(""))


def log_stage(line: Column | str) -> Column:
    """The marker when it is one of the ordered stages."""
    marker = log_marker(line)
    return F.when(marker.isin(*STAGES), marker)


def stage_index(stage: Column | str) -> Column:
    """Position among the stages, -1 outside them."""
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), as_col(stage)).cast("int") - 1


def is_progress_bar(line: Column | str) -> Column:
    return as_col(line).rlike(r"\d+%\|")


def object_number(object_id: Column | str) -> Column:
    """The number at the end of an object id, by which ids sort; -1 without one."""
    return F.coalesce(F.regexp_extract(as_col(object_id), r"(\d+)$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def matches_text(label: Column | str, aliases: Column | str, needle: str) -> Column:
    """Case-insensitive substring search over a label and its aliases."""
    q = needle.strip().lower()
    if not q:
        return F.lit(True)
    hit = lambda c: F.contains(F.lower(c), F.lit(q))
    return hit(as_col(label)) | F.coalesce(F.exists(as_col(aliases), hit), F.lit(False))


def object_id(position: Column | str) -> Column:
    return F.format_string("obj_%03d", as_col(position))


def object_line(label: Column, confidence: Column, n: Column, centroid: Column) -> Column:
    """Fixed-width report line of one object."""
    at = F.concat_ws(", ", *[F.format_string("%.2f", centroid[i]) for i in range(3)])
    return F.format_string("%-18s conf=%.2f seen=%dx at [%s]", label, confidence, n, at)


def vocabulary_bullets(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct normalised labels as one bullet list (`prompt` column)."""
    from .labels import normalize

    names = df.where(F.length(F.trim(F.col(label))) > 0).select(normalize(label).alias("l")).distinct()
    bullets = F.transform(F.array_sort(F.collect_set("l")), lambda l: F.concat(F.lit("- "), l))
    return names.agg(F.concat_ws("\n", bullets).alias("prompt"))


def parse_replies(
    replies: DataFrame, raw: str = "raw", *, on_bad_json: str = "raise"
) -> DataFrame:
    """Detector reply documents to one row per usable detection.

    Entries without a label or a four-number box are skipped, coordinates are rounded
    half to even, the confidence defaults to 0.5 and is clipped to 0..1. A confidence
    that is not a number counts as missing, and a box side must be a finite number that
    fits an integer. A reply that is not JSON raises, or with
    `on_bad_json="skip"` is dropped.
    """
    parsed = replies.withColumn("_ok", F.try_parse_json(F.col(raw)).isNotNull())
    if on_bad_json == "skip":
        parsed = parsed.where("_ok")
    document = F.when(F.col("_ok"), F.from_json(F.col(raw), REPLY_SCHEMA)).otherwise(
        F.raise_error(F.lit("response was not valid JSON"))
    )
    keep = [c for c in replies.columns if c != raw]
    items = parsed.select(
        *keep, F.posexplode(F.coalesce(document["objects"], F.array())).alias("position", "o")
    )
    side = lambda i: F.get(F.col("o.box_2d"), F.lit(i)).try_cast("double")
    label = strip("o.label")
    confidence = F.coalesce(F.col("o.confidence").try_cast("double"), F.lit(0.5))
    return (
        items.where((F.length("o.label") > 0) & (F.size("o.box_2d") == 4))
        .withColumn("_box", F.array(*[side(i) for i in range(4)]))
        .where(~F.exists("_box", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= 2.0**31)))
        .select(
            *keep,
            "position",
            label.alias("label"),
            F.transform("_box", lambda v: F.rint(v).cast("int")).alias("box_2d"),
            F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
            F.nullif(F.col("o.mask"), F.lit("")).alias("mask_b64"),
        )
    )


def truncation_problem(finish_reason: Column | str, asked_masks: bool) -> Column:
    """Message for a reply cut at the output limit, null for any other reason."""
    reason = F.upper(F.coalesce(as_col(finish_reason), F.lit("")))
    hint = (
        "masks do not fit the output budget; turn them off"
        if asked_masks
        else "raise the output limit or ask for fewer objects"
    )
    return F.when(F.contains(reason, F.lit("MAX_TOKENS")), F.lit(f"reply truncated at the output limit: {hint}"))
