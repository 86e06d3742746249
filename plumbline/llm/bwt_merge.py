"""Burrows-Wheeler transforms of short texts, and their merge by interleave refinement.

A collection's transform lists, in the order of the suffixes of all its texts, the byte
before each suffix. Every text ends in a terminator of its own; terminators sort before
all bytes and among themselves by text. Rows 0 to n - 1 of a collection of n texts are
those of its terminators.

Merging does not sort the suffixes of the union. It starts from the shards laid end to
end, which is an interleave sorted by no byte, and refines it: reading the transforms in
the order of the interleave and dealing the rows to the bytes read gives the interleave
sorted by one byte more. Where rows of one block part in round h, their common prefix is
h bytes long. After `depth` rounds the blocks that are left whole are the intervals of
suffixes that share `depth` bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END = 0  # the terminator; bytes are 1 to 256


@dataclass
class Transform:
    """`symbols` by row, and `steps`: the row of the suffix that is one byte longer."""

    symbols: np.ndarray
    steps: np.ndarray
    texts: int

    def walk(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text and the start offset of the suffix of every row, walking back from the ends."""
        text = np.empty(len(self.symbols), np.int32)
        offset = np.empty(len(self.symbols), np.int32)
        row, who, left = np.arange(self.texts), np.arange(self.texts), lengths.copy()
        while len(row):
            text[row], offset[row] = who, left
            more = left > 0
            row, who, left = self.steps[row[more]], who[more], left[more] - 1
        return text, offset


def _steps(symbols: np.ndarray) -> np.ndarray:
    """Row of the longer suffix: the k-th row that reads a byte leads to the k-th that begins with it."""
    order = np.argsort(symbols, kind="stable")
    steps = np.empty(len(symbols), np.int32)
    steps[order] = np.arange(len(symbols), dtype=np.int32)
    return steps  # what it says of terminators is never used


def transform(data: np.ndarray, lengths: np.ndarray) -> Transform:
    """The transform of the texts laid end to end in `data` (bytes as uint8)."""
    texts = len(lengths)
    total = len(data) + texts
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[ends] = False
    symbols[inside] = data.astype(np.int64) + 1
    # Ranks by six symbols, then by twice as many until all differ; terminators differ by text.
    rank = np.zeros(total, np.int64)
    width = 6
    padded = np.concatenate([symbols, np.zeros(width, np.int64)])
    after_end = np.zeros(total, np.int64)
    after_end[:] = np.repeat(ends, lengths + 1) - np.arange(total)  # symbols before the terminator
    for i in range(width):
        rank = rank * 257 + np.where(i < after_end, padded[i:i + total], 0)
    own = np.repeat(np.arange(texts), lengths + 1)
    longest = int(lengths.max(initial=0)) + 1
    order = np.argsort(rank, kind="stable")
    while True:
        new = np.ones(total, bool)
        new[1:] = rank[order[1:]] != rank[order[:-1]]
        dense = np.empty(total, np.int64)
        dense[order] = np.cumsum(new)
        if width >= longest:
            break
        # Past the terminator stands the text's number, below every rank of a suffix.
        beyond = after_end < width
        ahead = np.where(beyond, own, dense[np.minimum(np.arange(total) + width, total - 1)] + texts)
        rank = dense * (total + texts + 2) + ahead
        order = np.argsort(rank, kind="stable")
        width *= 2
    # Suffixes that are equal up to their terminators sort by text.
    order = np.lexsort((own, dense))
    before = symbols[order - 1]
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = np.zeros(total, bool)
    first[starts] = True
    found = np.where(first[order], END, before).astype(np.uint16)
    return Transform(found, _steps(found), texts)


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated intervals of the union: rows in merged order, their block, and common prefixes.

    Rows are numbered one shard after the other. The third array has for every row how many
    bytes, up to `depth`, the row's suffix shares with the closest other suffix: the rounds
    until it stood alone. A row that stands alone only leads to rows that do, so it leaves
    the interleave; the rows returned are those in blocks of two or more after all rounds.
    Terminators differ, so no block crosses the end of a text.
    """
    bases = np.cumsum([0] + [len(s.symbols) for s in shards])
    symbols = np.concatenate([s.symbols for s in shards])
    steps = np.concatenate([s.steps + base for s, base in zip(shards, bases)]).astype(np.int32)
    narrow = (symbols - 1).astype(np.uint8)
    readable = symbols != END
    order = np.arange(len(symbols), dtype=np.int32)
    block = np.zeros(len(symbols), np.int32)
    shared = np.zeros(len(symbols), np.int32)
    for h in range(depth):
        keep = readable[order]
        rows, held = order[keep], block[keep]
        read = narrow[rows]
        deal = np.argsort(read, kind="stable")
        rows, held, read = steps[rows[deal]], held[deal], read[deal]
        part = np.ones(len(rows) + 1, bool)
        part[1:-1] = (read[1:] != read[:-1]) | (held[1:] != held[:-1])
        alone = part[1:] & part[:-1]
        order, block = rows[~alone], np.cumsum(part[:-1], dtype=np.int32)[~alone]
        shared[order] = h + 1
    return order, block, shared


def _intervals(
    texts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, depth: int, shard_bytes: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, least owner) of every `depth`-byte string found at least twice.

    `texts` is all texts end to end. They are cut into shards of about `shard_bytes`, each
    shard is transformed by itself, and the transforms are merged.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)])
    cuts = [0]
    while cuts[-1] < len(lengths):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + shard_bytes, "right")) - 1))
    shards, who, where = [], [], []
    for a, b in zip(cuts, cuts[1:]):
        shard = transform(texts[starts[a]:starts[b]], lengths[a:b])
        text, offset = shard.walk(lengths[a:b])
        shards.append(shard)
        who.append(text + a)
        where.append(offset)
    order, block, _ = merge(shards, depth)
    who, where = np.concatenate(who)[order], np.concatenate(where)[order]
    least = np.full(int(block.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, block, owner[who])
    return who, where, least[block]


def repeated(
    texts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, depth: int, shard_bytes: int
) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of every `depth`-byte string that a text of a smaller owner holds as well."""
    who, where, least = _intervals(texts, lengths, owner, depth, shard_bytes)
    later = owner[who] > least
    return who[later], where[later]


def first_owners(
    texts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, depth: int, shard_bytes: int
) -> np.ndarray:
    """Per text of exactly `depth` bytes, the least owner among the equal texts."""
    found = owner.copy()
    if len(owner):
        who, _, least = _intervals(texts, lengths, owner, depth, shard_bytes)
        found[who] = least
    return found
