"""Exact grouped quantiles without gathering a group in one task.

`percentile` keeps every distinct value of a group in a single buffer, so it is used only
after the largest group has been counted and found small. For larger groups a mergeable
sketch first brackets each wanted rank, then only the values inside the
bracket are counted (everything below collapses to one map-side counter), and the
exact order statistics are read from that narrow band. Both passes combine on the
map side, so the rows of a hot group never travel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, lookup_join

# Sketch error is 1/ACCURACY of the group size; the bracket leaves four times that.
# Groups under five times ACCURACY are too small for it and are counted value by value.
ACCURACY = 10_000

# Groups up to this many rows may be held by the one-pass built-in (tens of megabytes).
SMALL_GROUP = 1_000_000


def finite(*cols: Column) -> Column:
    """True where every column is a finite number (neither null, NaN nor infinite)."""
    ok = F.lit(True)
    for c in cols:
        d = c.cast("double")
        ok = ok & d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
    return ok


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    *,
    largest: int | None = None,
    small_group: int = SMALL_GROUP,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key with linearly interpolated quantiles.

    `wanted` maps output name to `(column, p)`. Non-finite values are ignored, as
    they stand for missing geometry. `largest` is the row count of the largest group
    where the caller has it already; otherwise it is counted here.
    """
    names = list(wanted)
    source = df.select(
        *keys,
        *[
            F.when(finite(F.col(c)), F.col(c).cast("double")).alias(f"_c{i}")
            for i, (c, _) in enumerate(wanted.values())
        ],
    )
    probs = [p for _, p in wanted.values()]
    if largest is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        largest = counts.agg(F.max("n")).first()[0] or 0
    if largest <= small_group:
        return source.groupBy(*keys).agg(
            *[F.expr(f"percentile(_c{i}, {p!r}D)").alias(n) for i, (n, p) in enumerate(zip(names, probs))]
        )

    brackets = source.groupBy(*keys).agg(
        *[F.count(f"_c{i}").alias(f"_n{i}") for i in range(len(names))],
        *[
            F.percentile_approx(
                f"_c{i}", [max(0.0, p - 4.0 / accuracy), min(1.0, p + 4.0 / accuracy)], accuracy
            ).alias(f"_b{i}")
            for i, p in enumerate(probs)
        ],
    )
    joined = lookup_join(source, durable(brackets), list(keys))

    def slot(i: int) -> Column:
        value, n = F.col(f"_c{i}"), F.col(f"_n{i}")
        wide = n > 5 * accuracy
        low = F.when(wide, F.col(f"_b{i}")[0]).otherwise(F.lit(float("-inf")))
        high = F.when(wide, F.col(f"_b{i}")[1]).otherwise(F.lit(float("inf")))
        return F.when(
            value <= high,
            F.struct(
                F.lit(i).alias("_slot"),
                F.when(value >= low, value).alias("_v"),
                (F.lit(probs[i]) * (n - 1)).alias("_h"),
            ),
        )

    counted = (
        joined.select(*keys, F.explode(F.array(*[slot(i) for i in range(len(names))])).alias("_s"))
        .where(F.col("_s").isNotNull())
        .groupBy(*keys, F.col("_s._slot").alias("_slot"), F.col("_s._v").alias("_v"), F.col("_s._h").alias("_h"))
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    order = (
        Window.partitionBy(*keys, "_slot").orderBy(F.col("_v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("_cum", F.sum("_k").over(order))
    picked = ranked.groupBy(*keys, "_slot").agg(
        F.max("_h").alias("_h"),
        F.max(F.when(F.col("_v").isNull(), F.col("_k")).otherwise(0)).alias("_below"),
        F.max("_cum").alias("_covered"),
        F.min(F.when(F.col("_cum") > F.floor("_h"), F.col("_v"))).alias("_v0"),
        F.min(F.when(F.col("_cum") > F.ceil("_h"), F.col("_v"))).alias("_v1"),
    )
    value = F.when(
        (F.col("_below") > F.floor("_h")) | (F.col("_covered") <= F.ceil("_h")),
        F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
    ).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_h") - F.floor("_h")))
    per_slot = picked.select(*keys, "_slot", value.alias("_q"))
    return per_slot.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_slot") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)]
    )
