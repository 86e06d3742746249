"""Packing documents into training windows by multiway differencing.

Each task packs the documents it reads, group by group. A document gives full windows and
a remainder; remainders are cut into short pieces. The pieces of a group are dealt to k
windows by the largest differencing method: every piece starts as a partial partition with
one loaded window, and again and again the two partial partitions with the largest spreads
are merged, the heaviest windows of one with the lightest of the other, so that imbalances
oppose each other. The k loads come out nearly equal. k starts at the least number that
could hold the tokens and rises by one whenever a load exceeds the capacity.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

CAPACITY = 2048
# Remainders are cut into pieces of up to so many tokens: more pieces per window, closer loads.
PIECE = 512
# Windows that are filled together; the work of one merge grows with it.
GROUP_WINDOWS = 128
END_ID = 1
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Ids of finished pieces that a task holds before it hands them on.
IDS_HELD = 500_000


def differencing(sizes: list[int], k: int) -> list[int]:
    """The window (0 to k - 1) of every piece, with nearly equal sums of sizes.

    A partial partition is its loaded windows as (load, members), heaviest first; windows
    left out are empty. Members are nested pairs, unfolded at the end.
    """
    if not sizes:
        return []
    # (negative spread, tie break, base load taken off all k windows, windows)
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    ticket = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        alone = k - len(b)  # windows of a that meet an empty window of b
        paired = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[alone:], reversed(b))] if alone < len(a) else []
        merged = a[:alone] + paired + b[:len(b) - len(paired)]
        merged.sort(key=lambda w: w[0], reverse=True)
        if len(merged) == k:
            low = merged[-1][0]
            merged = [(load - low, members) for load, members in merged]
        spread = merged[0][0]
        heapq.heappush(heap, (-spread, ticket, merged))
        ticket += 1
    window = [0] * len(sizes)
    for number, (_, members) in enumerate(heap[0][2]):
        pending = [members]
        while pending:
            x = pending.pop()
            if isinstance(x, tuple):
                pending.extend(x)
            else:
                window[x] = number
    return window


def fill_windows(sizes: list[int], capacity: int) -> list[int]:
    """Windows of pieces with no load above `capacity`, in as few windows as balance allows."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window = differencing(sizes, k)
        if not sizes or np.bincount(window, sizes).max() <= capacity:
            return window
        k += 1


class Encoder:
    """Token ids of the byte-level vocabulary in `folder`.

    The rank file gives the ids of ordinary text and is the faster way; a text with the
    string of the special token, or one that the pattern cannot split, goes through the
    JSON file, which both must equal.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, folder: str, name: str = "byte_bpe_50k"):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.path = os.path.join(folder, f"{name}.json")
        self.fast = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = None

    def __call__(self, text: str) -> np.ndarray:
        if self.SPECIAL not in text:
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except ValueError:  # the pattern's step limit, on very long runs of white space
                pass
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


def tokenizer_folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


class _Packer:
    """Packs a stream of documents; sequence numbers are unique over all tasks."""

    def __init__(self, task: int, capacity: int, with_ids: bool):
        self.next_sequence = task << 33
        self.capacity, self.with_ids = capacity, with_ids
        self.rows: list[tuple] = []
        self.pending: list[tuple] = []
        self.waiting = 0
        self.held = 0  # ids in `rows`

    def _put(self, doc, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int) -> None:
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        self.held += len(ids) if self.with_ids else 0
        self.rows.append((doc, start, len(ids), crc, tokens, sequence, offset, ids if self.with_ids else None))

    def add(self, doc, ids: np.ndarray) -> None:
        tokens, at = len(ids), 0
        while tokens - at >= self.capacity:
            self._put(doc, at, ids[at:at + self.capacity], tokens, self.next_sequence, 0)
            self.next_sequence += 1
            at += self.capacity
        self.waiting += tokens - at
        step = min(PIECE, self.capacity)
        self.pending.extend((doc, i, ids[i:min(i + step, tokens)], tokens) for i in range(at, tokens, step))
        if self.waiting >= GROUP_WINDOWS * self.capacity:
            self.flush()

    def flush(self) -> None:
        windows = fill_windows([len(p[2]) for p in self.pending], self.capacity)
        used = [0] * (max(windows, default=-1) + 1)
        for (doc, start, ids, tokens), w in zip(self.pending, windows):
            self._put(doc, start, ids, tokens, self.next_sequence + w, used[w])
            used[w] += len(ids)
        self.next_sequence += len(used)
        self.pending, self.waiting = [], 0

    def take(self, docs_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows))
        self.rows, self.held = [], 0
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        data = {n: pa.array(c, docs_type if n == "id" else pa.int64()) for n, c in zip(names, columns)}
        if self.with_ids:
            data["ids"] = pa.array([x.astype(np.int32) for x in columns[-1]], pa.list_(pa.int32()))
        return pa.record_batch(data)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = CAPACITY,
    folder: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: `id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset` (and `ids`).

    A document is its token ids and then END_ID; a null or empty text is END_ID alone. Each
    id lies in exactly one piece, and offsets in a sequence have no gaps. A trainer pads a
    sequence to `capacity`, unless its length is a power of two. Rows that repeat an id, or
    have none, are packed one by one. An empty table gives no pieces. Nothing is shuffled: a
    task holds the tokens of one group of windows and of one document. Sequence numbers
    follow the partitioning of the input.
    """
    small_batches(docs.sparkSession)
    folder = folder or tokenizer_folder()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(folder)
        packer = _Packer(TaskContext.get().partitionId(), capacity, with_ids)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for doc, text in zip(batch["id"].to_pylist(), batch["text"]):
                packer.add(doc, np.append(encode(text.as_py()), np.uint32(END_ID)))
                if len(packer.rows) >= 20_000 or packer.held >= IDS_HELD:
                    yield packer.take(id_type)
        packer.flush()
        if packer.rows:
            yield packer.take(id_type)

    schema = f"id {kind}, {PIECES}" + (", ids array<int>" if with_ids else "")
    pair = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return pair.mapInArrow(run, schema)
