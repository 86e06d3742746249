"""Mixing sources to target weights by capped water-filling.

Every source asks for its share of the mix by weight. A source whose share exceeds the
allowed epochs over its own size is clamped there, and what it leaves is shared among the
others by weight, until no share is above its limit. Documents are then taken as many
whole times as the target holds the source, and the rest of the target is filled in the
order of a seeded hash; the last document reached gives the words that are missing, as a
fraction of one repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

WORD = "[^\\x20\\x09-\\x0D]+"
# Each source is cut into so many hash ranges, which are summed and then filled in turn.
RANGE_BITS = 12


def word_count(text: Column) -> Column:
    """Words of a text as bigint; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(key: Column, seed: int) -> Column:
    """An unsigned 32-bit hash of a key, the same on every run; null hashes as an empty key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add `target` (double) to `source`, `source_size`, `weight`; targets add up to all sizes.

    The level is the words per unit of weight of the sources that are not clamped. It only
    rises, so a source that is clamped once stays clamped, and the rounds end.
    """
    cap = F.lit(max_epochs) * F.col("source_size")
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) > cap
        total, clamped, open_weight = sources.agg(
            F.sum("source_size"), F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(~over, F.col("weight")).otherwise(0))
        ).first()
        if not open_weight or (total - clamped) / open_weight <= level:
            return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))
        level = (total - clamped) / open_weight


def by_rank(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Add `weight`: the cycle repeated along the sources in code-point order, null last.

    The rank is a window over one row per source, not over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int")))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: DataFrame | None = None,
    cycle: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 17,
) -> DataFrame:
    """One row per row of `docs`: `id`, `source`, `size`, `source_size`, `target`, `whole`, `extra`, `taken`.

    `taken = size * whole + extra` words; `extra` is below or equal to `size`, so no document
    exceeds `max_epochs` times its size. `weights` (`source`, `weight` bigint) names the
    weight of each source, missing ones weigh nothing; without it weights follow `cycle`
    by rank. The taken words of a source are its target rounded down. Null sources form one
    source. Null and empty texts have size zero and are taken zero times. Repeated rows take
    part one by one. Texts are read once and not shuffled; only ids and sizes are, spread
    over hash ranges of each source, so one source may hold most rows.
    """
    narrow = durable(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        seeded_hash(F.col(id_col), seed).alias("u"),
    ).withColumn("range", F.shiftright("u", 32 - RANGE_BITS)))
    ranges = durable(narrow.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    if weights is None:
        weighed = by_rank(sizes, cycle)
    else:
        named = weights.select(F.col("source").alias("_s"), F.col("weight").cast("long"))
        weighed = sizes.join(named, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0, ["weight"])
    targets = water_fill(durable(weighed), max_epochs)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("range_before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    spec = placed.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        F.col("r.source").alias("_s"), F.col("range").alias("_r"), "range_before", "source_size", "target",
        # A target of many whole sizes is never above max_epochs of them, despite rounding.
        F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(max_epochs)).alias("whole"),
    ).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")))
    inside = (
        Window.partitionBy("source", "range").orderBy("u", "id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = narrow.join(spec, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    reached = F.col("range_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return joined.withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - reached)).cast("long")
    ).select(
        "id", "source", "size", "source_size", "target", F.col("whole").cast("long").alias("whole"), "extra",
        (F.col("size") * F.col("whole") + F.col("extra")).cast("long").alias("taken"),
    )


def expand(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows of `docs`: every row as many times as the mix repeats it, whole.

    The last document that a source's target reaches is repeated once more where at least
    half of it is within the target. Only the place where each source's order is cut goes
    back to the texts, one row per source, so texts stay where they are.
    """
    seed = options.get("seed", 17)
    mixed = mix(docs, id_col, text_col, source_col, **options)
    order = F.struct(seeded_hash(F.col("id"), seed).alias("u"), F.col("id"), F.col("size"))
    once_more = (2 * F.col("extra") >= F.col("size")) & (F.col("extra") > 0)
    cuts = durable(mixed.groupBy("source").agg(
        F.max("whole").alias("_whole"), F.max(F.when(once_more, order)).alias("_cut")
    ).withColumnRenamed("source", "_source"))
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(source_col).alias("_s"),
        F.struct(seeded_hash(F.col(id_col), seed).alias("u"), F.col(id_col).alias("id"),
                 word_count(F.col(text_col)).alias("size")).alias("_order"),
    ).where(F.col("_order.size") > 0)
    copies = F.col("_whole") + F.when(F.col("_order") <= F.col("_cut"), 1).otherwise(0)
    joined = rows.join(cuts, F.col("_s").eqNullSafe(F.col("_source")))
    return joined.select("_row", F.explode(F.sequence(F.lit(0), copies.cast("int"))).alias("_n")).where("_n > 0").select("_row.*")
