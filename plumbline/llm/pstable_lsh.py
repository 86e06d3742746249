"""Embedding near-duplicates by p-stable hashing for the Euclidean distance.

Vectors are normalised, so a cosine is a distance: |u - v|^2 = 2 - 2 cos. A table of the
index quantises `depth` random projections, floor((a v + b) / WIDTH) with normal a, and its
bucket is the tuple of them. The number of projections follows from the number of vectors,
so that buckets of unrelated vectors stay small at any size; the number of tables follows
from the recall asked for at the threshold itself. Pairs that meet in a bucket are checked
by their exact cosine in double precision.

Copies of a vector are one row of the index. Buckets above BLOCK_LIMIT rows are compared
block by block, all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, small_batches
from .blocks import BLOCK, HIGH, LOW, block_pairs, per_whole_groups
from .components import components

WIDTH = 2.5
SEED = 2024
# Expected unrelated vectors per bucket.
BUCKET_ROWS = 32
BLOCK_LIMIT = 4_096
# Products of a block comparison held at a time.
PRODUCTS = 4_000_000


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees for vectors at this distance."""
    r = width / distance
    upper = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * upper - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def index_shape(vectors: int, cosine: float, recall: float) -> tuple[int, int]:
    """(projections per table, tables) for so many vectors.

    Unrelated vectors are taken to be orthogonal. A pair at exactly the threshold meets in
    at least one table with probability `recall`; closer pairs with more.
    """
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    depth = max(4, math.ceil(math.log(max(vectors, 1) / BUCKET_ROWS) / -math.log(far)))
    return depth, math.ceil(math.log(1 - recall) / math.log1p(-near**depth))


def _matrix(batch_column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    return np.stack([np.frombuffer(v.as_py(), "<f8") for v in batch_column])


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of very large and small ones finite.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of doubles; null for the rest."""
    for batch in batches:
        found = []
        for value in batch["embedding"]:
            v = None if not value.is_valid else value.values
            if v is None or len(v) == 0 or v.null_count:
                found.append(None)
                continue
            x = v.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # minus zero is zero
            found.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
        yield pa.record_batch({"id": batch["id"], "vec": pa.array(found, pa.binary())})


def _buckets(depth: int, tables: int):
    """The buckets of each vector, one per table, as `sig` (bytes of longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = np.array([len(v.as_py()) for v in batch["vec"]])
            sigs: list[bytes | None] = [None] * len(sizes)
            for size in np.unique(sizes):
                dim = int(size) // 8
                if dim not in planes:
                    rng = np.random.default_rng([SEED, dim])
                    planes[dim] = (
                        rng.standard_normal((dim, depth * tables)), rng.uniform(0, WIDTH, depth * tables),
                        rng.integers(1, 2**63 - 1, (tables, depth), dtype=np.int64) | 1,
                    )
                a, b, mix = planes[dim]
                rows = np.flatnonzero(sizes == size)
                for some in np.array_split(rows, -(-len(rows) // 1_000)):
                    cells = np.floor((_unit(_matrix(batch["vec"].take(pa.array(some)))) @ a + b) / WIDTH)
                    cells = cells.astype(np.int64).reshape(len(some), tables, depth)
                    keys = (cells * mix).sum(axis=2) + dim  # wraps around
                    for i, key in zip(some, keys):
                        sigs[i] = key.astype("<i8").tobytes()
            yield pa.record_batch({
                "cid": batch["cid"], "vec": batch["vec"], "sig": pa.array(sigs, pa.binary()),
            })

    return run


def _close_pairs(cosine: float):
    """Per bucket, the pairs of classes with at least this cosine that no earlier table has."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = np.stack([table[k].to_numpy() for k in ("table", "bucket", LOW, HIGH)])
        heads = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        ends = np.append(heads[1:], table.num_rows)
        cid, block = table["cid"].to_numpy(), table[BLOCK].to_numpy()
        vec, sig = table["vec"], table["sig"]
        a, b = [], []
        for low, high in zip(heads.tolist(), ends.tolist()):
            if high - low < 2:
                continue
            at, first, last = int(keys[0, low]), keys[2, low], keys[3, low]
            own = np.arange(low, high)
            left, right = own[block[own] == first], own[block[own] == last]
            if not len(left) or not len(right):
                continue
            # Vectors of unequal length may share a bucket number by chance; only equal ones meet.
            x = _rows(vec, left)
            y = x if first == last else _rows(vec, right)
            for size in x.keys() & y.keys():
                i, p = x[size]
                j, q = y[size]
                sx = _signatures(sig, i)
                sy = sx if first == last else _signatures(sig, j)
                step = max(1, PRODUCTS // len(j))
                for k in range(0, len(i), step):
                    m, n = np.nonzero(p[k:k + step] @ q.T >= cosine)
                    m += k
                    keep = cid[i[m]] < cid[j[n]] if first == last else np.ones(len(m), bool)
                    m, n = m[keep], n[keep]
                    fresh = ~(sx[m, :at] == sy[n, :at]).any(axis=1) if at else np.ones(len(m), bool)
                    a.append(cid[i[m[fresh]]])
                    b.append(cid[j[n[fresh]]])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return compare


def _rows(vec: pa.ChunkedArray, rows: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors by vector length."""
    data = [vec[i].as_py() for i in rows]
    sizes = np.array([len(d) for d in data])
    return {
        int(s): (rows[sizes == s], _unit(np.frombuffer(b"".join(d for d in data if len(d) == s), "<f8").reshape(-1, s // 8)))
        for s in np.unique(sizes)
    }


def _signatures(sig: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sig[i].as_py() for i in rows), "<i8").reshape(len(rows), -1)


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, cosine: float = 0.9, recall: float = 0.99
) -> DataFrame:
    """`id`, `n_links`, `component_id`, `kept` for every row.

    Rows link when their cosine is at least `cosine`; pairs below are never linked, and
    pairs at the threshold are found with probability `recall`, closer ones with more. A
    vector that is null, empty or zero or has a null or non-finite component links with
    nothing and is its own component; vectors of different lengths never link. `n_links`
    counts other rows linked directly, copies included; `component_id` is the smallest id
    reachable; `kept` tells whether it is the row's own. Rows that repeat an id with equal
    or other vectors are rows of their own; null ids count as links, and are never the
    smallest unless alone. An empty table gives no rows; other columns are not read.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    vectors = durable(
        rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
        .mapInArrow(_vectors, f"id {kind}, vec binary")
    )
    classes = durable(
        vectors.where(F.col("vec").isNotNull()).groupBy("vec")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    depth, tables = index_shape(classes.count(), cosine, recall)
    indexed = durable(classes.select("cid", "vec").mapInArrow(_buckets(depth, tables), "cid long, vec binary, sig binary"))
    bucket = F.expr("reverse(substring(sig, table * 8 + 1, 8))")
    placed = indexed.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).select(
        "table", F.xxhash64(bucket).alias("bucket"), "cid", "vec", "sig"
    )
    keys = ["table", "bucket"]
    blocks = block_pairs(placed, keys, "cid", BLOCK_LIMIT)
    links = durable(per_whole_groups(
        blocks, [*keys, LOW, HIGH], _close_pairs(cosine), "a long, b long", rows=20_000
    ))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = classes.select(F.col("cid").alias("b"), "copies")
    degree = both.join(counts, "b").groupBy("a").agg(F.sum("copies").alias("linked"))
    found = components(links)
    named = (
        classes.select("cid", "vec", "least", "copies").join(degree, F.col("cid") == F.col("a"), "left")
        .join(found, F.col("cid") == F.col("node"), "left")
        .withColumn("group", F.coalesce("component", "cid"))
    )
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "group").select(
        "vec", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"
    )
    return vectors.join(labels, "vec", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("n_links").isNull() | (F.col("id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )
