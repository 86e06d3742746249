"""Connected components of a link table by rounds of large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable

LINKS = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of one partition by links of its nodes to their local smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    children = [x for x in parent if root(x) != x]
    if children:
        yield pa.record_batch({"a": pa.array(children, pa.int64()), "b": pa.array([root(x) for x in children], pa.int64())})


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a").where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """`links` point from the larger node `a` to the smaller node `b`."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`node`, `component` for every node of `links` (`a`, `b` bigint, any direction).

    The component is the smallest node that can be reached. Loops and repeated links are
    allowed, nulls are not; a table without links gives no rows. Each partition first
    shrinks its links to a forest; then every round is joins on the node, partial minima
    and one write, so a node with very many links is split by the join like any other
    skewed key. The number of rounds grows with the logarithm of the longest chain.
    """
    proper = links.where(F.col("a") != F.col("b")).select("a", "b")
    now = durable(proper.mapInArrow(_forest, LINKS))
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = seen
        after = durable(_small_star(_large_star(now)))
        discard(now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
