"""Hard negatives by threshold joins over partly indexed vectors.

Vectors are whole numbers. Anchors are taken in chunks of bounded size, and each chunk meets
every vector in blocks, in the tasks that read them: no vector is shuffled. Within a block
the dimensions come in order of the chunk's weight. What remains of two vectors after some
dimensions adds at most the product of the norms of the remainders to their score, so the
dimensions at the end of a vector that cannot lift any anchor to its threshold are left out
of the block's inverted index. Partial scores are accumulated from the index, pairs are
dropped once partial score and remaining norms stay below the threshold, and what is left
is completed from the dimensions left out.

Thresholds are lowered until windows fill. A window is open over an interval of scores and
wants the first k rows in it. It starts with a threshold close below the upper end; where
fewer than k rows are found, the interval goes on further down, for those windows only,
until it is full or its lower end is reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import discard, durable

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# Of a positive's score: the part in percent where its window begins and ends.
LOW_PERCENT, HIGH_PERCENT = 30, 90
# Anchors that are compared in one job: their vectors go to every task, about 4 MB at 64 dimensions of two bytes.
CHUNK = 32_768
# Anchors and rows that are scored at once.
ANCHOR_BLOCK, ROW_BLOCK = 512, 4_096
# Parts that the dimensions are accumulated in.
STEPS = 4
# Below this share of pairs still in play they are completed one by one.
SPARSE = 0.05
EXACT = float(1 << 53)
# The score of a free place; its negative is a number of 64 bits too.
FREE = 1 - (1 << 63)

PACKED = "id long, label long, dims int, norm double, wide boolean, vector binary"
FOUND = "anchor long, window long, id long, score long"


def prepare(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """`id`, `label`, `dims` and the vector in whole numbers, packed, of the rows that take part.

    Each component x becomes floor(SCALE * x). Rows with a null id, label, vector or
    component, or with a component that is no finite number, take no part. Of rows that
    share an id, the one with the least label and vector does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["vector"].value_lengths().to_numpy().astype(np.int64)
            flat = np.floor(SCALE * batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(flat) and np.abs(flat).max() >= 2.0**62:
                raise ValueError("a component is too large for whole numbers of 64 bits")
            ends = np.cumsum(sizes)
            wide = len(flat) > 0 and np.abs(flat).max() >= 1 << 15
            whole = flat.astype("<i8" if wide else "<i2")
            packed = [whole[e - n:e].tobytes() for e, n in zip(ends, sizes)]
            norms = [float(np.linalg.norm(flat[e - n:e])) * (1 + 1e-9) for e, n in zip(ends, sizes)]
            yield pa.record_batch({
                "id": batch["id"], "label": batch["label"], "dims": pa.array(sizes, pa.int32()), "norm": pa.array(norms, pa.float64()),
                "wide": pa.array([wide] * len(sizes), pa.bool_()), "vector": pa.array(packed, pa.binary()),
            })

    taking = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    )
    packed = durable(taking.mapInArrow(run, PACKED))
    once = packed.select("id").groupBy("id").count().where("count > 1")
    if once.isEmpty():
        return packed
    least = durable(packed.groupBy("id").agg(F.min(F.struct("label", "dims", "norm", "wide", "vector")).alias("r")).select("id", "r.*"))
    discard(packed)
    return least


def _unpack(rows: dict[str, list]) -> np.ndarray:
    """The vectors of rows of one number of dimensions, as int64."""
    return np.stack([np.frombuffer(v, "<i8" if w else "<i2").astype(np.int64) for v, w in zip(rows["vector"], rows["wide"])])


@dataclass
class Anchors:
    """Anchors of one number of dimensions with their open windows.

    Window j belongs to anchor `owner[j]` and takes the first `k` rows with scores from
    `low[j]` to `high[j]`; `same` tells whether rows of the anchor's label or of the others.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int

    def __post_init__(self) -> None:
        energy = (self.vectors.astype(np.float64) ** 2).sum(axis=0)
        self.order = np.argsort(-energy, kind="stable")
        self.ordered = self.vectors[:, self.order]
        dims = len(self.order)
        self.cuts = np.unique(np.linspace(0, dims, STEPS + 1).astype(int))
        self.rest = _suffix_norms(self.ordered, self.cuts)
        self.large = int(np.abs(self.vectors).max(initial=0))


def _suffix_norms(vectors: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Norm of each vector's dimensions from each cut on, rounded up."""
    squares = vectors.astype(np.float64) ** 2
    sums = np.stack([squares[:, c:].sum(axis=1) for c in cuts], axis=1)
    return np.sqrt(sums) * (1 + 1e-9) + 1e-6


class _Best:
    """The first k rows of each window among the rows seen, by score and then id."""

    def __init__(self, windows: int, k: int) -> None:
        self.scores = np.full((windows, k), FREE)
        self.ids = np.full((windows, k), np.iinfo(np.int64).max)

    def add(self, window: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[window], scores), np.append(self.ids[window], ids)
        first = np.lexsort((ids, -scores))[:self.scores.shape[1]]
        self.scores[window], self.ids[window] = scores[first], ids[first]


def _scores(a: Anchors, at: np.ndarray, rows: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (positions in `at`), rows and scores of all pairs with at least the score that their anchor needs."""
    cuts, dims = a.cuts, len(a.order)
    none = np.zeros(0, np.int64)
    if dims == 0:
        who, which = np.nonzero((need <= 0)[:, None] & np.ones(len(rows), bool))
        return who, which, np.zeros(len(who), np.int64)
    most = float(max(1, a.large)) * float(max(1, np.abs(rows).max(initial=0))) * dims
    if most >= 2.0**63:
        raise ValueError("scores may exceed 64 bits")
    number = np.float64 if most < EXACT else np.int64
    left, right, rest = a.ordered[at].astype(number), rows[:, a.order].astype(number), a.rest[at]
    norms = _suffix_norms(right, cuts)
    threshold = need - np.abs(need) * 1e-12
    # A row is indexed up to the first cut behind which it reaches no anchor's threshold by itself.
    covered = norms * rest.max(axis=0) < threshold.min()
    depth = np.where(covered.any(axis=1), covered.argmax(axis=1), len(cuts) - 1)
    live = np.flatnonzero(depth > 0)
    if not len(live):
        return none, none, none
    partial = np.zeros((len(at), len(live)), number)
    going = np.ones(len(at), bool)
    for step in range(len(cuts) - 1):
        begin, end = cuts[step], cuts[step + 1]
        listed = depth[live] > step  # the others have no postings in these dimensions
        if listed.all() and going.all():
            partial += left[:, begin:end] @ right[live, begin:end].T
        else:
            partial[np.ix_(going, listed)] += left[going, begin:end] @ right[live[listed], begin:end].T
        seen = np.minimum(depth[live], step + 1)
        able = partial + rest[:, seen] * norms[live, seen] >= threshold[:, None]
        going = able.any(axis=1)
        if not going.any():
            return none, none, none
        column = able.any(axis=0)
        if column.mean() < 0.7:
            live, partial, able = live[column], partial[:, column], able[:, column]
        if able.mean() < SPARSE:
            break
    who, which = np.nonzero(able)
    got, chosen = partial[who, which], live[which]
    begun = cuts[np.minimum(depth[chosen], step + 1)]
    for begin in np.unique(begun):  # complete from the dimensions that were not accumulated
        if begin < dims:
            part = begun == begin
            got[part] += np.einsum("ij,ij->i", left[who[part], begin:], right[chosen[part], begin:])
    got = got.astype(np.int64)
    reach = got >= need[who]
    return who[reach], chosen[reach], got[reach]


def _search(shared: Broadcast[dict[int, Anchors]]):
    """First k rows of each window among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best = {d: _Best(len(a.owner), a.k) for d, a in anchors.items()}
        for batch in batches:
            dims = batch["dims"].to_numpy()
            for d in np.unique(dims):
                if d not in anchors:
                    continue
                rows = batch.filter(pa.array(dims == d))
                for start in range(0, rows.num_rows, ROW_BLOCK):
                    block = rows.slice(start, ROW_BLOCK).to_pydict()
                    _add_block(anchors[d], best[d], np.array(block["id"]), np.array(block["label"]), _unpack(block))
        for d, a in anchors.items():
            window, place = np.nonzero(best[d].scores > FREE)
            if len(window):
                yield pa.record_batch({
                    "anchor": pa.array(a.ids[a.owner[window]]), "window": pa.array(a.number[window]),
                    "id": pa.array(best[d].ids[window, place]), "score": pa.array(best[d].scores[window, place]),
                })

    return run


def _add_block(a: Anchors, best: _Best, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
    for first in range(0, len(a.ids), ANCHOR_BLOCK):
        at = np.arange(first, min(first + ANCHOR_BLOCK, len(a.ids)))
        w0, w1 = np.searchsorted(a.owner, [at[0], at[-1] + 1])  # windows are sorted by their anchor
        # Rows below the last place of a full window cannot enter it any more.
        need = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(need, a.owner[w0:w1] - first, np.maximum(a.low[w0:w1], best.scores[w0:w1, -1]))
        who, which, scores = _scores(a, at, vectors, need)
        fit = (labels[which] == a.labels[at[who]]) == a.same
        if a.same:
            fit &= ids[which] != a.ids[at[who]]
        who, which, scores = who[fit], which[fit], scores[fit]
        cuts = np.searchsorted(who, np.arange(len(at) + 1))
        owner = a.owner[w0:w1] - first
        for j in np.flatnonzero(cuts[owner + 1] > cuts[owner]):
            own = slice(cuts[owner[j]], cuts[owner[j] + 1])
            inside = (scores[own] >= max(a.low[w0 + j], best.scores[w0 + j, -1])) & (scores[own] <= a.high[w0 + j])
            if inside.any():
                best.add(w0 + j, scores[own][inside], ids[which[own][inside]])


def _by_dims(rows: list[Row], windows: dict[int, list[tuple[int, int, int]]], same: bool, k: int) -> dict[int, Anchors]:
    """Anchors by their number of dimensions; `windows` has number, low and high by anchor id."""
    out = {}
    for d in {r["dims"] for r in rows}:
        own = [r for r in rows if r["dims"] == d and r["id"] in windows]
        if own:
            owner, number, low, high = (
                np.array(x, np.int64) for x in zip(*((i, *w) for i, r in enumerate(own) for w in windows[r["id"]]))
            )
            held = {"vector": [r["vector"] for r in own], "wide": [r["wide"] for r in own]}
            out[d] = Anchors(np.array([r["id"] for r in own]), np.array([r["label"] for r in own]), _unpack(held),
                             owner, number, low, high, same, k)
    return out


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _fill(
    packed: DataFrame, held: list[Row], windows: list[tuple[int, int, int, int]], same: bool, k: int, parts: Sequence[tuple[int, int]]
) -> DataFrame:
    """The first k rows of each window (anchor, number, low, high) and their `rank`.

    `parts` are growing parts of a window, as fractions from its upper end; the whole window
    follows. A window that is full after some part is not searched further.
    """
    spark = packed.sparkSession
    found = []
    todo = {(a, n): (low, high, high, 0) for a, n, low, high in windows if low <= high}
    for over, under in [*parts, (1, 1)]:
        now: dict[int, list[tuple[int, int, int]]] = {}
        after = {}
        for (a, n), (low, top, high, have) in todo.items():
            begin = top - (top - low) * over // under
            if begin <= high:
                now.setdefault(a, []).append((n, begin, high))
            after[a, n] = (low, top, min(high, begin - 1), have)
        if not now:
            continue
        anchors = spark.sparkContext.broadcast(_by_dims(held, now, same, k))
        rows = durable(_first(packed.mapInArrow(_search(anchors), FOUND), k).drop("rank"))
        anchors.unpersist()
        found.append(rows)
        for row in rows.groupBy("anchor", "window").count().collect():  # one row a window at most
            low, top, high, have = after[row["anchor"], row["window"]]
            after[row["anchor"], row["window"]] = (low, top, high, have + row["count"])
        todo = {key: w for key, w in after.items() if w[3] < k and w[0] <= w[2]}
    if not found:
        return spark.createDataFrame([], FOUND + ", rank int")
    return _first(reduce(DataFrame.unionByName, found), k)


def mine(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    *,
    anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    chunk: int = CHUNK,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    The score of a row is its inner product with the anchor, in whole numbers. An anchor's
    positives are its first `positives` other rows of the same label; for each of them come
    the first `negatives` rows of other labels whose score is from `low_percent` to
    `high_percent` of the positive's. Higher scores come first, ties by smaller id; there may
    be fewer rows, and a positive with a negative score has none.

    `anchor` tells anchors by `id` (default: divisible by 100), `label` is a column by default.
    Nulls, numbers that are not finite and repeated ids are settled by `prepare`. Vectors of
    another length than the anchor's are not compared with it; those of empty vectors score
    0. An empty table gives no rows. Other columns are not read.

    `chunk` anchors at a time, with their windows, are held by the driver and by every task,
    and each job reads all vectors once; nothing that is held grows with the input.
    """
    spark = rows.sparkSession
    packed = prepare(rows, id_col, vector_col, F.col("label") if label is None else label)
    anchors = packed.where(F.col("id") % 100 == 0 if anchor is None else anchor)
    total, longest = packed.agg(F.count(F.lit(1)), F.max("norm")).first()
    chunks = max(1, math.ceil(1.1 * anchors.count() / chunk))
    # The more rows compete for a window, the nearer to its upper end it is full.
    depth = max(1, math.ceil(math.log(max(total, 1_000) / 500, 4)))
    out = []
    for c in range(chunks):
        held = anchors.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).collect()
        ends = [(r["id"], math.ceil(r["norm"] * longest)) for r in held]
        # From the largest score there can be to its negative; half of it is all scores above zero.
        first = durable(_fill(packed, held, [(i, 0, -end, end) for i, end in ends], True, positives, [(n, 8) for n in range(1, 5)]))
        numbered = [(r["anchor"], r["rank"], r["score"]) for r in first.select("anchor", "rank", "score").collect()]
        windows = [(a, n, -(-low_percent * s // 100), high_percent * s // 100) for a, n, s in numbered]
        second = _fill(packed, held, windows, False, negatives, [(1, 4**n) for n in range(depth, 0, -1)])
        of = first.select("anchor", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out.append(second.join(of, ["anchor", "window"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ))
    return reduce(DataFrame.unionByName, out)
