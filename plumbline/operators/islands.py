"""Gap splitting of a numeric column: runs whose neighbouring values are close."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(value: Column, gap: Column) -> Column:
    # Half-gap cells: two values of one cell can never be more than `gap` apart, so a
    # split can only fall between cells and the cell's min and max decide it exactly.
    return F.when(gap > 0, F.floor(value / (gap / 2.0)).cast("double")).otherwise(value)


def value_runs(
    df: DataFrame, keys: Sequence[str], value: str, gap: float | Column, *, by_cell: bool = False
) -> DataFrame:
    """Runs per key as `(keys, run, lo, hi, n)`; a new run starts where the step > gap.

    With `by_cell` the rows are the counted cells `(keys, _cell, run)` themselves, which
    rows can be joined to.

    Rows are reduced to per-cell counts before the shuffle, so the ordered part works
    on at most `range / (gap / 2)` rows per key instead of on every row.
    """
    g = gap if isinstance(gap, Column) else F.lit(float(gap))
    cells = (
        df.select(*keys, F.col(value).cast("double").alias("_v"), g.alias("_g"))
        .groupBy(*keys, _cells(F.col("_v"), F.col("_g")).alias("_cell"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
            F.max("_g").alias("_g"),
        )
    )
    order = Window.partitionBy(*keys).orderBy("_cell")
    starts = F.coalesce(
        ((F.col("lo") - F.lag("hi").over(order)) > F.col("_g")).cast("int"), F.lit(0)
    )
    numbered = cells.withColumn("_new", starts).withColumn("run", F.sum("_new").over(order))
    if by_cell:
        return numbered.select(*keys, "_cell", "run")
    return (
        numbered
        .groupBy(*keys, "run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    )


def dominant_run(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The largest run of each key; on a tie the one with the smallest start."""
    best = F.max_by(F.struct("lo", "hi", "n"), F.struct(F.col("n"), -F.col("lo")))
    return runs.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")
