"""SimHash near-duplicates found with Burkhard-Keller trees.

A tree holds distinct fingerprints; the children of a node are keyed by their integer
Hamming distance to it. A search that is d away from a node follows only the edges keyed
d - radius to d + radius, which the triangle inequality proves sufficient.

Trees are sharded by content: the 64 bits are cut into radius + 1 bands, and a shard holds
the fingerprints that agree on one band. Two fingerprints within the radius agree on at
least one whole band, so they meet in a shard, and a search needs only its own radius + 1
shards out of all. Shard trees travel to their searches by the shuffle on the shard key.
A broadcast of all trees would gather every fingerprint on the driver, which no size
bounds, and every search would then visit every tree. A shard with too many fingerprints
is cut into blocks; every search of the shard visits the trees of all its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, small_batches
from .blocks import BLOCK, HIGH, LOW, block_pairs, per_whole_groups
from .components import components

SEED = 42
# Shingle hashes that are unpacked to bits at a time: 64 bytes each.
UNPACK = 65_536
# Fingerprints of one shard block, 8 bytes each beside the tree's arrays.
SHARD_LIMIT = 16_384
# Nodes that searches under way may visit at a time: a few dozen bytes each.
VISITS = 2_000_000


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text over its word shingles, repeats included.

    A-Z are lower-cased. Words end at blanks and the control characters 9 to 13. A text of
    fewer words than a shingle is one shingle; a text of no words has fingerprint zero.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = [b" ".join(s) for s in zip(*(parts[i:] for i in range(words)))]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), UNPACK):
        octets = hashes[at:at + UNPACK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """`id` and `fp` (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t, words) for t in map(pa.BinaryScalar.as_py, batch["text"])), np.uint64, batch.num_rows
            )
            yield pa.record_batch({"id": batch["id"], "fp": pa.array(found.view(np.int64))})

    kind = docs.schema[id_col].dataType.simpleString()
    pair = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    return pair.mapInArrow(run, f"id {kind}, fp long")


class Forest:
    """Burkhard-Keller trees over the fingerprints of several groups, built level by level.

    The first fingerprint of a group is its root; the rest of the group falls into child
    groups by distance to it, and so on, which gives the trees of one-by-one insertion.
    """

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        size = len(prints)
        self.prints = prints
        parent, edge = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        order = np.argsort(group, kind="stable")
        first = np.ones(size, bool)
        first[1:] = group[order[1:]] != group[order[:-1]]
        self.root_group, self.root = group[order[first]], order[first]
        self.tree_size = np.diff(np.append(np.flatnonzero(first), size))
        owner = order[first][np.cumsum(first) - 1]
        rest, owner = order[~first], owner[~first]
        while len(rest):
            gap = np.bitwise_count(prints[rest] ^ prints[owner]).astype(np.int64)
            parent[rest], edge[rest] = owner, gap  # final only for those that become nodes now
            key = owner * 128 + gap
            by = np.lexsort((rest, key))
            rest, key = rest[by], key[by]
            first = np.ones(len(rest), bool)
            first[1:] = key[1:] != key[:-1]
            owner = rest[first][np.cumsum(first) - 1]
            rest, owner = rest[~first], owner[~first]
        child = np.flatnonzero(parent >= 0)
        slot = parent[child] * 128 + edge[child]
        by = np.argsort(slot)
        self.child, self.slot = child[by], slot[by]

    def search(self, group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (search, node) within `radius`, each search in the tree of its group.

        Searches advance together, as many at a time as bound the visited nodes by VISITS.
        """
        at = np.searchsorted(self.root_group, group)
        known = at < len(self.root_group)
        known[known] = self.root_group[at[known]] == group[known]
        asks, roots = np.flatnonzero(known), at[known]
        turn = np.cumsum(self.tree_size[roots]) // VISITS
        found = [
            self._descend(asks[turn == t], self.root[roots[turn == t]], prints, radius) for t in np.unique(turn)
        ]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _descend(
        self, ask: np.ndarray, node: np.ndarray, prints: np.ndarray, radius: int
    ) -> tuple[np.ndarray, np.ndarray]:
        asked, met = [], []
        while len(ask):
            gap = np.bitwise_count(prints[ask] ^ self.prints[node]).astype(np.int64)
            near = gap <= radius
            asked.append(ask[near])
            met.append(node[near])
            low = np.searchsorted(self.slot, node * 128 + np.maximum(gap - radius, 0), "left")
            high = np.searchsorted(self.slot, node * 128 + gap + radius, "right")
            many = high - low
            ask = np.repeat(ask, many)
            step = np.arange(len(ask)) - np.repeat(np.cumsum(many) - many, many)
            node = self.child[np.repeat(low, many) + step]
        return np.concatenate(asked), np.concatenate(met)


def _band_edges(bands: int) -> list[tuple[int, int]]:
    """(shift, bits) of each band of a 64-bit fingerprint."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


def near_links(prints: DataFrame, radius: int = 3, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """All pairs `a` < `b` of the distinct longs `fp` that differ in 1 to `radius` bits, once each."""
    edges = _band_edges(radius + 1)
    masks = [np.uint64(((1 << bits) - 1) << low) for low, bits in edges]
    shards = [
        F.struct(
            F.lit(i).alias("band"),
            F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("shard"),
        )
        for i, (low, bits) in enumerate(edges)
    ]
    spread = prints.select("fp", F.explode(F.array(*shards)).alias("s")).select("fp", "s.band", "s.shard")
    keyed = block_pairs(spread, ["band", "shard"], "fp", shard_limit)
    keys = ["band", "shard", LOW, HIGH]

    def compare(table: pa.Table) -> pa.Table:
        column = {c: table[c].to_numpy() for c in table.column_names}
        fp = column["fp"].view(np.uint64)
        new = np.ones(len(fp), bool)
        new[1:] = np.logical_or.reduce([column[k][1:] != column[k][:-1] for k in keys])
        group = np.cumsum(new)
        planted = column[BLOCK] == column[HIGH]
        # Within one block every fingerprint searches; across two, those of the lower block do.
        asks = planted & (column[LOW] == column[HIGH]) | (column[BLOCK] != column[HIGH])
        forest = Forest(group[planted], fp[planted])
        i, j = forest.search(group[asks], fp[asks], radius)
        band = column["band"][asks][i]
        x, y = fp[asks][i], fp[planted][j]
        same_block = (column[LOW] == column[HIGH])[asks][i]
        keep = (x.view(np.int64) < y.view(np.int64)) | (~same_block & (x != y))
        # A pair that agrees on several bands is given by the first of them.
        for k in range(radius):
            keep &= (band <= k) | ((x ^ y) & masks[k] != 0)
        x, y = x[keep].view(np.int64), y[keep].view(np.int64)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return per_whole_groups(keyed, keys, compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, radius: int = 3
) -> DataFrame:
    """`id`, `fp` and `component_id` for every row: the smallest id reachable over links.

    Documents link when their fingerprints differ in at most `radius` bits; equal
    fingerprints, those of texts without words included, link as well. Links are sought
    between distinct fingerprints only, so copies cost one row each and no pairs. A null
    text counts as empty. Rows that repeat an id share its component; a row of null id
    takes the smallest id of its group, or null where the group has none. An empty table
    gives an empty result; other columns are neither read nor returned.
    """
    small_batches(docs.sparkSession)
    prints = durable(with_fingerprints(docs, id_col, text_col, words))
    classes = durable(prints.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(near_links(classes.select("fp"), radius))
    # Components are named by their smallest fingerprint, then by their smallest document.
    placed = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = placed.join(named, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of every group the smallest id stays.

    Rows that repeat the id that stays are one document and all stay, as do rows without id.
    """
    found = near_duplicates(docs, id_col, text_col)
    dropped = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("_dropped")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["_dropped"], "left_anti")
