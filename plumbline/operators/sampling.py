"""Exact-size, repeatable row samples per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, lookup_join

_SPACE_BITS = 32
_BUCKET_BITS = 12


def sampling_key(cols: Sequence[str], seed: int = 0) -> Column:
    """A repeatable pseudo-random BIGINT in [0, 2^32) for each distinct row."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << _SPACE_BITS))


def decimate(
    df: DataFrame,
    keys: Sequence[str],
    max_rows: int,
    identity: Sequence[str],
    *,
    seed: int = 0,
    draw: Column | None = None,
) -> DataFrame:
    """Keep exactly `max_rows` rows of each key (all of them when there are fewer).

    `identity` must tell rows of a key apart. `draw` replaces the default sampling key
    and must lie in [0, 2^32). The cut is found from per-bucket counts; only the bucket
    that straddles it is ranked, so no key is ever sorted as a whole.
    """
    if max_rows <= 0:
        return df
    keyed = df.withColumn("_draw", sampling_key(identity, seed) if draw is None else draw)
    keyed = keyed.withColumn(
        "_bucket", F.shiftright("_draw", _SPACE_BITS - _BUCKET_BITS).cast("int")
    )
    upto = (
        Window.partitionBy(*keys).orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = (
        keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_cum", F.sum("_n").over(upto))
    )
    # First bucket whose running count reaches the budget, and what is left for it.
    cut = counts.groupBy(*keys).agg(
        F.min(F.when(F.col("_cum") >= max_rows, F.struct("_bucket", (F.col("_cum") - F.col("_n")).alias("_before")))).alias("_cut")
    )
    marked = lookup_join(keyed, durable(cut), list(keys))
    whole = marked.where(F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut._bucket")))
    ranked = Window.partitionBy(*keys).orderBy("_draw", *identity)
    partial = (
        marked.where(F.col("_bucket") == F.col("_cut._bucket"))
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= F.lit(max_rows) - F.col("_cut._before"))
        .drop("_rank")
    )
    return whole.unionByName(partial).drop("_draw", "_bucket", "_cut")
