"""Removal of repeated byte strings, found by merging Burrows-Wheeler transforms.

A byte is removed when a string of LENGTH bytes that covers it also starts in a document
with a smaller id. To let equal strings meet without moving every suffix, each string is
owned by an anchor: the least hash among the GRAM-byte grams in it. Equal strings have the
same anchor at the same place, so only strings of equal anchors need comparing.

1. Each task lists its documents' anchors with the run of strings each one owns. Runs that
   are equal as a whole, the inside of copies, collapse to those of the smallest document
   before anything is shuffled and again where equal anchors meet. Anchors in one document
   alone are done.
2. What is left are runs that share an anchor but differ: borders of copies, common lines
   in changing company. Their texts go to buckets by anchor.
3. In a bucket, runs are cut into short texts, texts without company are set aside by the
   hash of their core, and the rest are transformed shard by shard and merged; intervals of
   the merged transform that share LENGTH bytes give the repeats.
4. An anchor with very many runs goes string by string. A task first folds equal strings to
   one row with all their places; partial minima then leave one representative of a string
   in each of SHARDS shards, and only those are transformed and merged. The document that
   holds a string first is joined back to the folded places.

Equality of grams and runs in step 1 is that of 104-bit hashes; steps 3 and 4 compare bytes,
and the join back in step 4 is on 128-bit digests of the strings.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, release_shuffles, small_batches
from .blocks import per_whole_groups
from .bwt_merge import first_owners, repeated
from .packed import planes, unplanes

LENGTH = 50
GRAM = 16
# Buckets of anchors per shuffle partition; one bucket is resolved at a time.
BUCKETS_PER_PARTITION = 4
# Bytes of text per shuffle partition at most: about a thirtieth as many anchors per bucket.
PARTITION_BYTES = 128 << 20
# Shards that each keep one representative of a string of frequent anchors.
SHARDS = 4
# Strings of a run are compared in classes of so many starts.
STARTS = 9



@dataclass(frozen=True)
class Sizes:
    """What a task holds at a time. No result depends on it."""

    segment: int = 250_000  # bytes whose hashes are held
    flush: int = 250_000  # anchors collapsed, or places folded
    many_runs: int = 5_000  # an anchor with more differing runs is compared string by string
    run_rows: int = 50_000  # run texts compared, besides those of one anchor
    merge: int = 400_000  # bytes of texts that are merged together
    shard: int = 130_000  # bytes of one shard of them


U = np.uint64
_ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)]
_POSITION = U((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (16) bytes from every position on."""
    h = data.astype(U) + U(1)
    for step, odd in zip((1, 2, 4, 8), _ODD):
        h = h[:-step] * odd + h[step:]
    return h


def _spans_hash(grams: np.ndarray, seed: np.ndarray, first: np.ndarray, last: np.ndarray, most: int) -> np.ndarray:
    """Hash of the bytes from `first` to `last` + GRAM of each row, at most `most` bytes."""
    found = seed.astype(U)
    for at in range(0, most, GRAM):
        found = _mix(found * _ODD[0] + grams[np.minimum(first + at, last)])
    return found


@dataclass
class Anchors:
    """Anchors of one document part; positions count from the document's start."""

    key: np.ndarray  # hash of the anchor gram, 56 bits
    at: np.ndarray  # where the anchor starts
    first: np.ndarray  # first and last start of the strings it owns
    last: np.ndarray
    run: np.ndarray  # hash of the whole run


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Anchors, np.ndarray]:
    """Anchors of the strings that start in [starts, ends) of a buffer, and the row of each.

    Every row's strings lie wholly inside its own part of the buffer.
    """
    grams = _grams(data)
    mixed = _mix(grams)
    least = (mixed & ~_POSITION) | np.arange(len(mixed), dtype=U)
    span, reach = LENGTH - GRAM + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[:reach - span], least[span - reach:])
    sizes = ends - starts
    row = np.repeat(np.arange(len(starts)), sizes)
    string = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    at = (least[string] & _POSITION).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    at, first, last, row = at[head], string[head], string[tail], row[head]
    seed = (at - first) * 64 + (last - first)
    run = _spans_hash(grams, seed, first, last + LENGTH - GRAM, LENGTH + span)
    return Anchors(mixed[at] >> U(8), at, first, last, run >> U(16)), row


def _parts(
    docs: Iterator[tuple[int, bytes]], segment: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about `segment` bytes: data, string starts and ends, offset in the document, id.

    A long document is cut into parts that overlap by what anchors and runs at their borders need.
    """
    margin = LENGTH + (LENGTH - GRAM) * 2
    held: list[bytes] = []
    rows: list[tuple[int, int, int, int]] = []
    used = 0
    for doc, text in docs:
        strings = len(text) - LENGTH + 1
        for at in range(0, strings, segment):
            low = max(0, at - margin)
            upto = min(at + segment, strings)
            part = text[low:min(len(text), upto + margin)] if len(text) > segment else text
            rows.append((used + at - low, used + upto - low, low - used, doc))
            held.append(part)
            used += len(part)
            if used >= segment:
                yield (np.frombuffer(b"".join(held), np.uint8), *np.array(rows, np.int64).T)
                held, rows, used = [], [], 0
    if rows:
        yield (np.frombuffer(b"".join(held), np.uint8), *np.array(rows, np.int64).T)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for key, text in zip(batch["key"].to_pylist(), batch["text"]):
            text = text.as_py()
            if len(text) >= LENGTH:
                yield key, text


def _group_ids(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Numbers of the groups of equal values along `order`, ascending."""
    new = np.zeros(len(order), np.int64)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _least(groups: np.ndarray, values: np.ndarray, pick=np.minimum) -> np.ndarray:
    """Per row, the least value of its group (groups ascending)."""
    heads = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    return pick.reduceat(values, heads)[groups - groups[0]] if len(values) else values


ANCHOR_ROWS = "bucket int, count int, base long, keys binary, runs binary, docs binary, firsts binary, shape binary"
# Marks on documents, packed for a bucket of documents: spans to remove (low, high), or open runs
# (first and last start, the anchor's place, whether it is frequent).
MARKS = "bucket int, count int, kind int, docs binary, lows binary, highs binary, places binary, flags binary"
SPAN, OPEN = 0, 1
# All marks of one document, as uint32 pairs or quadruples; whether a frequent anchor is open.
GATHERED = "key long, spans binary, open binary, hot int"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.record_batch(
        [pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows), schema.split(", "))], names=_names(schema)
    )


def _marks(buckets: int, spans: tuple[np.ndarray, ...], rest: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """MARKS rows from removed spans (doc, low, high) and open runs (doc, first, last, at, frequent)."""
    rows = []
    for kind, columns in ((SPAN, (*spans, _NONE, _NONE)), (OPEN, rest)):
        if not len(columns[0]):
            continue
        where = (_mix(columns[0].astype(U)) % U(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(buckets + 1))
        for b, (low, high) in enumerate(zip(edges, edges[1:])):
            if low < high:
                some = order[low:high]
                rows.append((b, high - low, kind, *(planes(c[some] if len(c) else c) for c in columns)))
    if rows:
        yield _record(MARKS, rows)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its spans merged, and one with its open runs."""
    rows = (row.as_py() for batch in batches for row in batch.to_struct_array())
    for _, bucket in groupby(rows, itemgetter("bucket")):
        found: dict[int, list[tuple[np.ndarray, ...]]] = {SPAN: [], OPEN: []}
        for r in bucket:
            width = 3 if r["kind"] == SPAN else 5
            columns = ("docs", "lows", "highs", "places", "flags")[:width]
            found[r["kind"]].append(tuple(unplanes(r[c], r["count"]).astype(np.int64) for c in columns))
        if found[SPAN]:
            docs, packed = _span_rows(*_joined(found[SPAN]))
            yield _record(GATHERED, [(d, p, None, 0) for d, p in zip(docs.tolist(), packed)])
        if found[OPEN]:
            doc, *columns = _joined(found[OPEN])
            order = np.argsort(doc, kind="stable")
            doc = doc[order]
            quads = np.stack([c[order] for c in columns], 1).astype("<u4")
            cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            yield _record(GATHERED, [
                (d, None, p.tobytes(), int(p[:, 3].any())) for d, p in zip(doc[cut].tolist(), np.split(quads, cut[1:]))
            ])


def _span_rows(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """One row per document with its spans merged."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    # A start within the furthest end so far continues a span; documents are set apart.
    shift = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * (int(high.max()) + 2)
    reach = np.maximum.accumulate(high + shift)
    head = np.flatnonzero(np.append(True, (low + shift)[1:] > reach[:-1]))
    tail = np.append(head[1:], len(doc)) - 1
    spans = np.stack([low[head], (reach - shift)[tail]], 1).astype("<u4")
    cut = np.flatnonzero(np.append(True, doc[head][1:] != doc[head][:-1]))
    return doc[head][cut], [s.tobytes() for s in np.split(spans, cut[1:])]


_NONE = np.zeros(0, np.int64)


def _anchor_rows(buckets: int, sizes: Sizes):
    """Step 1 by task: anchors in compact columns per bucket; spans of collapsed runs
    pass through as rows without keys."""

    def pack(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, run, doc, first, shape = (np.concatenate(c) for c in zip(*found))
        both = _mix(key * _ODD[1] + run)
        order = np.argsort(both, kind="stable")
        groups = _group_ids(order, both)
        least = np.empty(len(doc), np.int64)
        least[order] = _least(groups, doc[order])
        later = doc > least
        rows: list[tuple] = []
        if later.any():
            docs, packed = _span_rows(doc[later], first[later], first[later] + (shape[later] & 63) + LENGTH)
            for at in range(0, len(docs), 2_000):
                some = packed[at:at + 2_000]
                counts = np.array([len(s) // 8 for s in some])
                spans = np.frombuffer(b"".join(some), "<u4").astype(np.int64).reshape(-1, 2)
                owner = np.repeat(docs[at:at + 2_000], counts)
                # Where these rows go is open; they only pass through.
                bucket = int(docs[at] % buckets)
                rows.append((bucket, len(owner), 0, b"", b"", planes(owner), planes(spans[:, 0]), planes(spans[:, 1])))
        key, run, doc, first, shape = (c[~later] for c in (key, run, doc, first, shape))
        order = np.argsort(key)
        key, run, doc, first, shape = (c[order] for c in (key, run, doc, first, shape))
        edges = np.searchsorted(key, [(b << 56) // buckets for b in range(buckets)] + [1 << 56])
        for b, (low, high) in enumerate(zip(edges, edges[1:])):
            if low == high:
                continue
            base = int(doc[low:high].min())
            rows.append((
                b, high - low, base, planes(np.diff(key[low:high], prepend=U(0))), planes(run[low:high]),
                planes(doc[low:high] - base), planes(first[low:high]), planes(shape[low:high]),
            ))
        if rows:
            yield _record(ANCHOR_ROWS, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], 0
        for data, starts, ends, offset, doc in _parts(_documents(batches), sizes.segment):
            a, row = _anchors(data, starts, ends)
            found.append((
                a.key, a.run, doc[row], a.first + offset[row], (a.at - a.first) * 64 + (a.last - a.first),
            ))
            count += len(row)
            if count >= sizes.flush:
                yield from pack(found)
                found, count = [], 0
        if found:
            yield from pack(found)
        # The worker stays for the next tasks; what the pool keeps would count against them.
        pa.default_memory_pool().release_unused()

    return run


def _resolve(buckets: int, sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Step 1 where equal anchors meet: marks of the anchors of one bucket after the other."""
        rows = (row.as_py() for batch in batches for row in batch.to_struct_array())
        spans, rest, count = [], [], 0
        for _, bucket in groupby(rows, itemgetter("bucket")):
            gone, opened = _resolve_bucket(bucket, sizes.many_runs)
            spans.append(gone)
            rest.append(opened)
            count += len(gone[0]) + len(opened[0])
            if count >= sizes.flush:
                yield from _marks(buckets, _joined(spans), _joined(rest))
                spans, rest, count = [], [], 0
        if count:
            yield from _marks(buckets, _joined(spans), _joined(rest))

    return run


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*parts))


def _resolve_bucket(rows: Iterator[dict], many_runs: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Removed spans (doc, low, high) and open runs (doc, first, last, at, frequent) of a bucket."""
    found: list[list[np.ndarray]] = []
    spans: list[list[np.ndarray]] = []
    for r in rows:
        columns = [unplanes(r[c], r["count"]).astype(np.int64) for c in ("docs", "firsts", "shape")]
        if not r["keys"]:
            spans.append(columns)
            continue
        keys, runs = (unplanes(r[c], r["count"]) for c in ("keys", "runs"))
        found.append([np.cumsum(keys, dtype=U), runs, columns[0] + r["base"], *columns[1:]])
    gone = _joined(spans) if spans else (_NONE,) * 3
    if not found:
        return gone, (_NONE,) * 5
    key, run, doc, first, shape = (np.concatenate(c) for c in zip(*found))
    del found
    order = np.argsort(key, kind="stable")
    groups = _group_ids(order, key)
    some = order[_least(groups, doc[order]) != _least(groups, doc[order], np.maximum)]
    key, run, doc, first, shape = (c[some] for c in (key, run, doc, first, shape))
    order = np.lexsort((doc, run, key))
    key, run, doc, first, shape = (c[order] for c in (key, run, doc, first, shape))
    along = np.arange(len(key))
    later = doc > _least(_group_ids(along, key, run), doc)
    last = first + (shape & 63)
    gone = tuple(np.concatenate(c) for c in zip(gone, (doc[later], first[later], last[later] + LENGTH)))
    key, run, doc, first, last, shape = (c[~later] for c in (key, run, doc, first, last, shape))
    groups = _group_ids(np.arange(len(key)), key)
    company = _least(groups, doc) != _least(groups, doc, np.maximum)
    sizes = np.bincount(groups)[groups] if len(groups) else groups
    opened = (doc, first, last, first + (shape >> 6), (sizes > many_runs).astype(np.int64))
    return gone, tuple(c[company] for c in opened)


RUN_TEXTS = "bucket long, doc long, first long, place int, text binary"


def _open_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, int, int, int, int]]:
    """(document, text, first, last, anchor, frequent) of the open runs of a batch."""
    for key, text, opened in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), batch["open"].to_pylist()):
        for run in np.frombuffer(opened, "<u4").reshape(-1, 4).tolist():
            yield key, text, *run


def _run_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: the texts of open runs of anchors that are not frequent."""
    for batch in batches:
        rows = [
            (_route(text[at:at + GRAM]), key, first, at - first, text[first:last + LENGTH])
            for key, text, first, last, at, frequent in _open_runs(batch) if not frequent
        ]
        if rows:
            yield _record(RUN_TEXTS, rows)


def _route(gram: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(gram, digest_size=8).digest(), "little", signed=True)


def _compare(buckets: int, limits: Sizes):
    def run(table: pa.Table) -> pa.Table:
        """Step 3: marks of the strings repeated among the run texts of whole buckets."""
        bucket, doc, first, place = (table[c].to_numpy() for c in ("bucket", "doc", "first", "place"))
        texts = table["text"].chunk(0) if table["text"].num_chunks == 1 else table["text"].combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        starts, sizes = offsets[:-1], np.diff(offsets)
        grams = _grams(data)
        gone: list[tuple[np.ndarray, ...]] = []
        place = place.astype(np.int64)
        low_lead, high_lead = place - (sizes - LENGTH), place  # from a string's start to the anchor
        for c in range(-(-(LENGTH - GRAM + 1) // STARTS)):
            # Strings of a class start c * STARTS to c * STARTS + STARTS - 1 bytes before the anchor
            # and all hold the same core of LENGTH - STARTS + 1 bytes.
            lead_low, lead_high = np.maximum(low_lead, c * STARTS), np.minimum(high_lead, c * STARTS + STARTS - 1)
            rows = np.flatnonzero(lead_low <= lead_high)
            if not len(rows):
                continue
            core = starts[rows] + place[rows] - c * STARTS
            mark = _spans_hash(grams, bucket[rows].view(U), core, core + LENGTH - STARTS + 1 - GRAM, LENGTH)
            order = np.argsort(mark, kind="stable")
            groups = _group_ids(order, mark)
            owners = doc[rows][order]
            keep = _least(groups, owners) != _least(groups, owners, np.maximum)
            rows, groups = rows[order[keep]], groups[keep]
            if not len(rows):
                continue
            begin = starts[rows] + place[rows] - lead_high[rows]
            length = lead_high[rows] - lead_low[rows] + LENGTH
            # Batches hold whole core groups, which alone can share strings.
            cut = np.cumsum(length) // limits.merge
            head = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            batch = np.repeat(cut[head], np.diff(np.append(head, len(groups))))
            for b in np.unique(batch):
                some = batch == b
                n = length[some]
                spot = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                text, offset = repeated(data[spot], n, doc[rows[some]], LENGTH, limits.shard)
                row = rows[some][text]
                low = first[row] + (begin[some][text] - starts[row]) + offset
                gone.append((doc[row], low, low + LENGTH))
        marks = _marks(buckets, _joined(gone), (_NONE,) * 5) if gone else ()
        return pa.Table.from_batches(marks, _record(MARKS, [(0,) * 3 + (b"",) * 5]).schema)

    return run


# A string of frequent anchors: halves of its digest, the bytes, the least and greatest document
# of its places, and the places as pairs (document, start) of longs.
FOLDED = "high long, low long, string binary, least long, most long, places binary"


def _folded(sizes: Sizes):
    def rows(places: dict[bytes, array]) -> pa.RecordBatch:
        return _record(FOLDED, [
            (*_digest(string), string, min(p[::2]), max(p[::2]), p.tobytes()) for string, p in places.items()
        ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Step 4 by task: strings of frequent anchors, equal ones folded to one row."""
        places: dict[bytes, array] = {}
        count = 0
        for batch in batches:
            for key, text, first, last, _, frequent in _open_runs(batch):
                if not frequent:
                    continue
                for start in range(first, last + 1):
                    places.setdefault(text[start:start + LENGTH], array("q")).extend((key, start))
                count += last - first + 1
                if count >= sizes.flush:
                    yield rows(places)
                    places, count = {}, 0
        if places:
            yield rows(places)

    return run


def _digest(string: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(string, digest_size=16).digest())


HOLDERS = "high long, low long, holder long"
_LEAST = [f"least_{i}" for i in range(SHARDS)]


def _holders(sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Step 4: the first document of every string, from the merged transforms of its representatives."""
        for batch in batches:
            strings = batch["string"].to_pylist()
            owners = np.stack([batch[c].fill_null(-1).to_numpy() for c in _LEAST])
            present = np.stack([batch[c].is_valid().to_numpy(zero_copy_only=False) for c in _LEAST])
            # Shard by shard, as the transforms are cut.
            shard, row = np.nonzero(present)
            texts = np.frombuffer(b"".join(strings[i] for i in row.tolist()), np.uint8)
            holder = first_owners(texts, np.full(len(row), LENGTH), owners[shard, row], LENGTH, sizes.shard)
            _, pick = np.unique(row, return_index=True)
            if len(pick):
                yield _record(HOLDERS, [(*_digest(s), h) for s, h in zip(strings, holder[pick].tolist())])

    return run


def _later_places(buckets: int, sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Step 4: marks of the places of strings outside their first document."""
        gone, count = [], 0
        for batch in batches:
            packed = batch["places"].to_pylist()
            places = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
            holder = np.repeat(batch["holder"].to_numpy(), [len(p) // 16 for p in packed])
            doc, low = places[places[:, 0] > holder].T
            gone.append((doc, low, low + LENGTH))
            count += len(doc)
            if count >= sizes.flush:
                yield from _marks(buckets, _joined(gone), (_NONE,) * 5)
                gone, count = [], 0
        if count:
            yield from _marks(buckets, _joined(gone), (_NONE,) * 5)

    return run


def _frequent_marks(folded: DataFrame, buckets: int, sizes: Sizes) -> DataFrame:
    """Step 4: MARKS rows of the strings of frequent anchors.

    A string in a third of all documents is one folded row a flush before anything moves,
    at most one row a task and shard for the minima, SHARDS short texts for the merge, and
    its folded rows meet its first document in a join that adaptive execution may split.
    """
    shard = F.pmod(F.xxhash64("least"), F.lit(SHARDS))
    least = [F.min(F.when(shard == i, F.col("least"))).alias(name) for i, name in enumerate(_LEAST)]
    seen = folded.groupBy("string").agg(*least, F.max("most").alias("most"))
    shared = seen.where(F.least(*_LEAST) < F.col("most")).select("string", *_LEAST).mapInArrow(_holders(sizes), HOLDERS)
    places = folded.select("high", "low", "places").join(shared, ["high", "low"])
    return places.mapInArrow(_later_places(buckets, sizes), MARKS)


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """`id`, `key`, `text` (bytes), `carry` (the columns to pass on): keys order documents as their ids do and tell unequal rows apart.

    The id is its own key where ids are all present and distinct. Otherwise rows are ranked by
    id, nulls last, then by a hash of the text; equal rows share a key.
    """
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        F.struct(*(carry or [F.lit(None).cast("boolean").alias("none")])).alias("carry"),
    )
    odd = plain.groupBy("id").count().where(F.col("id").isNull() | (F.col("count") > 1))
    if odd.isEmpty():
        return plain.withColumn("key", F.col("id"))
    hashed = plain.withColumn("hash", F.xxhash64("text"))
    ranks = durable(
        hashed.select("id", "hash").distinct().orderBy(F.col("id").asc_nulls_last(), "hash")
        .withColumn("key", F.monotonically_increasing_id())
    )
    same = hashed["id"].eqNullSafe(ranks["id"]) & (hashed["hash"] == ranks["hash"])
    return hashed.join(ranks, same).select(hashed["id"], "key", "text", "carry")


def _by_bucket(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket")


def _settled_by_hash(keyed: DataFrame, parts: int, buckets: int, sizes: Sizes) -> DataFrame:
    """Step 1: GATHERED rows of the spans of collapsed runs and of the runs still open."""
    anchors = keyed.select("key", "text").mapInArrow(_anchor_rows(buckets, sizes), ANCHOR_ROWS)
    marks = _by_bucket(anchors, parts).mapInArrow(_resolve(buckets, sizes), MARKS)
    return durable(_by_bucket(marks, parts).mapInArrow(_gather, GATHERED))


def repeated_spans(
    docs: DataFrame, id_col: str, text_col: str, carry: list[str], sizes: Sizes = Sizes()
) -> DataFrame:
    """`id`, `text` (bytes), `carry` and `marks` (arrays of span lists) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    buckets = parts * BUCKETS_PER_PARTITION
    keyed = _keyed(docs, id_col, text_col, carry)
    first = _settled_by_hash(keyed, parts, buckets, sizes)
    # The anchors' exchange, larger than all others, is not needed beside them.
    release_shuffles(spark)
    # Both uses of the documents read all columns, so that one exchange serves them.
    dealt = keyed.repartition(parts, "key")
    opened = first.where(F.col("open").isNotNull())
    texts = dealt.join(opened.select("key", "open").hint("shuffle_hash"), "key").mapInArrow(_run_texts, RUN_TEXTS)
    late = per_whole_groups(texts, ["bucket"], _compare(buckets, sizes), MARKS, sizes.run_rows)
    frequent = opened.where("hot = 1").select("key", "open")
    if not frequent.isEmpty():
        folded = dealt.join(frequent.hint("shuffle_hash"), "key").mapInArrow(_folded(sizes), FOLDED)
        late = late.unionByName(_frequent_marks(folded, buckets, sizes))
    spans = first.where(F.col("spans").isNotNull()).select("key", "spans")
    late_spans = _by_bucket(late, parts).mapInArrow(_gather, GATHERED).select("key", F.col("spans").alias("late"))
    return (
        dealt.join(spans.hint("shuffle_hash"), "key", "left").join(late_spans.hint("shuffle_hash"), "key", "left")
        .select("id", "text", "carry", F.filter(F.array("spans", "late"), lambda x: x.isNotNull()).alias("marks"))
    )


def _merged(marks: list[bytes] | None) -> np.ndarray:
    """Maximal removed runs of one document, as (low, high) rows."""
    if not marks:
        return np.zeros((0, 2), np.int64)
    spans = np.frombuffer(b"".join(marks), "<u4").astype(np.int64).reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[head, 0], reach[np.append(head[1:], len(spans)) - 1]], 1)


def _rest(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _whole_characters(text: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs shrunk so that they hold whole UTF-8 characters only."""
    if not len(runs):
        return runs
    inner = (np.frombuffer(text + b" ", np.uint8) & 0xC0) == 0x80
    shrunk = []
    for low, high in runs.tolist():
        while low < high and inner[low]:
            low += 1
        while high > low and inner[high]:
            high -= 1
        if low < high:
            shrunk.append((low, high))
    return np.array(shrunk, np.int64).reshape(-1, 2)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """`id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, `kept_text`, `carry` for every row.

    `carry` is a struct of the columns named, as they were.
    The counts and the digest are of bytes; `kept_text` drops only characters all of whose
    bytes are removed. Strings are judged on the input, not on what is left. A null text is
    empty, and texts below LENGTH bytes are kept whole. Rows of a repeated id with different
    texts count as documents in the order of a text hash, null ids come after all others,
    and equal rows are one document and are each returned. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks in zip(batch["text"].to_pylist(), batch["marks"].to_pylist()):
                runs = _merged(marks)
                digest = hashlib.sha256(_rest(text, runs)).hexdigest()
                kept = _rest(text, _whole_characters(text, runs)).decode()
                out.append((len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), digest, kept))
            n_bytes, removed, spans, digests, kept = zip(*out) if out else ((),) * 5
            yield pa.record_batch({
                "id": batch["id"], "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
                "kept_text": pa.array(kept, pa.string()), "carry": batch["carry"],
            })

    found = repeated_spans(docs, id_col, text_col, list(carry), sizes)
    schema = (
        "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, "
        f"carry {found.schema['carry'].dataType.simpleString()}"
    )
    return found.mapInArrow(run, schema)
