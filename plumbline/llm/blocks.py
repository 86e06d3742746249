"""Bounded comparison of the rows that share a key.

Rows of one key are cut into blocks of limited size, and every pair of blocks becomes a
group of its own. A key of n rows then costs n / limit copies of each row, and no task
holds more than two blocks, whatever share of the table one key has. Nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, LOW, HIGH = "_block", "_low", "_high"


def block_pairs(df: DataFrame, keys: Sequence[str], spread_by: str, limit: int) -> DataFrame:
    """Add `_block` and the block pair (`_low`, `_high`) of every group a row belongs to.

    A row of block b appears in all pairs with b as one side. Rows with `_low = _high` are
    to be compared with each other, rows of other groups only across the two blocks.
    """
    large = df.groupBy(*keys).count().where(F.col("count") > limit)
    if large.isEmpty():
        return df.withColumns({c: F.lit(0) for c in (BLOCK, LOW, HIGH)})
    sized = df.join(
        large.select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("_blocks")), list(keys), "left"
    ).withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = sized.withColumn(BLOCK, F.pmod(F.xxhash64(spread_by), F.col("_blocks")).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return other.withColumns(
        {LOW: F.least(BLOCK, "_other"), HIGH: F.greatest(BLOCK, "_other")}
    ).drop("_other", "_blocks")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[pa.Table]:
    """Regroup batches sorted by `keys` into tables of about `rows` rows that cut no group.

    What is held at once is `rows` rows, one batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = {k: table[k][-1] for k in keys}
        cut = table.num_rows - 1
        columns = [(table[k], last[k]) for k in keys]
        while cut > 0 and all(c[cut - 1] == v for c, v in columns):
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        held, count = table.slice(cut).to_batches(), table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def per_whole_groups(
    df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], pa.Table], schema: str, rows: int = 100_000
) -> DataFrame:
    """Apply `fn` to tables that hold whole groups of `keys`, many groups at a time."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, rows):
            yield from fn(table).to_batches()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
