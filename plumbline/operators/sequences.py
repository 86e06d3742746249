"""Ordered operators (previous row, row number, running last) that survive a hot key.

A plain `Window.partitionBy(key).orderBy(...)` puts a whole key into one task, so it is
used only after the largest key has been counted and found small. Otherwise, or where
the caller names a chunk column, every key is cut into chunks that are contiguous in the order, the window runs per
`(key, chunk)`, and one summary row per chunk carries the state across chunk borders.
Only the summaries - a few rows per key - are ever windowed by key alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"

# Keys up to this many rows are sorted by one task each; larger ones are cut into chunks of about so many.
SMALL_GROUP = 2_000_000
# Borders are literals of one expression, which bounds their number.
MAX_CHUNKS = 4_096


def _split_tree(order: Column, splits: list[Column], base: int) -> Column:
    if not splits:
        return F.lit(base)
    mid = len(splits) // 2
    return F.when(order < splits[mid], _split_tree(order, splits[:mid], base)).otherwise(
        _split_tree(order, splits[mid + 1:], base + mid + 1)
    )


def with_chunks(
    df: DataFrame, order: Sequence[str], chunks: int = 32, sample: int = 2048
) -> DataFrame:
    """Add an integer chunk id that never decreases along `order` (ascending, non-null).

    Chunk borders come from a bounded sample of the order columns. They only decide
    how the work is spread: any borders give the same final result.
    """
    picked = df.select(*order).orderBy(F.rand(7)).limit(sample).collect()
    values = sorted({tuple(row) for row in picked})
    step = max(1, len(values) // chunks)
    borders = values[step::step][: chunks - 1]
    types = {f.name: f.dataType for f in df.schema.fields}
    literals = [
        F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, border)])
        for border in borders
    ]
    return df.withColumn(CHUNK, _split_tree(F.struct(*order), literals, 0))


def _chunks_needed(df: DataFrame, keys: Sequence[str], chunk: Column | None, limit: int) -> int:
    """How many chunks keep those of the largest key near `limit` rows; 1 for none at all.

    A chunk is a range of the order over all keys, so a key with a share of the rows falls
    into that share of the chunks: their number follows from all rows.
    """
    if chunk is not None:
        return MAX_CHUNKS
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    if (largest or 0) <= limit:
        return 1
    return min(MAX_CHUNKS, max(32, math.ceil(total / limit)))


def _prepare(df: DataFrame, order: Sequence[str], chunk: Column | None, chunks: int) -> DataFrame:
    if chunk is not None:
        return df.withColumn(CHUNK, chunk)
    return with_chunks(df, order, chunks, sample=64 * chunks)


def _carry_join(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carry, [*keys, CHUNK], "left").drop(CHUNK)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    *,
    name: str = "prev",
    chunk: Column | None = None,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Add struct `name` holding `payload` of the preceding row of the same key."""
    chunks = _chunks_needed(df, keys, chunk, small_group)
    if chunks == 1:
        return df.withColumn(name, F.lag(F.struct(*payload)).over(Window.partitionBy(*keys).orderBy(*order)))
    base = _prepare(df, order, chunk, chunks)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    tails = (
        base.groupBy(*keys, CHUNK)
        .agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_tail"))
        .withColumn("_carry", F.lag("_tail").over(across))
        .drop("_tail")
    )
    local = base.withColumn(name, F.lag(F.struct(*payload)).over(inside))
    return (
        _carry_join(local, tails, keys)
        .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
        .drop("_carry")
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    name: str = "idx",
    start: int = 0,
    chunk: Column | None = None,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Add contiguous BIGINT positions along `order` within each key."""
    chunks = _chunks_needed(df, keys, chunk, small_group)
    if chunks == 1:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, (number - 1 + F.lit(start)).cast("bigint"))
    base = _prepare(df, order, chunk, chunks)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = base.withColumn("_local", F.row_number().over(inside))
    return (
        _carry_join(local, offsets, keys)
        .withColumn(name, (F.col("_offset") + F.col("_local") - 1 + F.lit(start)).cast("bigint"))
        .drop("_offset", "_local")
    )


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    *,
    name: str,
    chunk: Column | None = None,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Add `name`: the latest non-null `value` up to and including each row."""
    chunks = _chunks_needed(df, keys, chunk, small_group)
    if chunks == 1:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.last(F.col(value), ignorenulls=True).over(upto))
    base = _prepare(df, order, chunk, chunks)
    inside = (
        Window.partitionBy(*keys, CHUNK).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    tails = (
        base.groupBy(*keys, CHUNK)
        .agg(F.max_by(F.col(value), known).alias("_tail"))
        .withColumn("_carry", F.last("_tail", ignorenulls=True).over(before))
        .drop("_tail")
    )
    local = base.withColumn(name, F.last(F.col(value), ignorenulls=True).over(inside))
    return (
        _carry_join(local, tails, keys)
        .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
        .drop("_carry")
    )
