"""Divergence of sources within a language, from term frequencies of a single-pass in-memory index.

Every task reads its documents once and builds the postings of a block in memory: documents
and occurrences of each term by source. A full block is spilled as a run whose terms are
sorted within hash shards. The runs of a shard meet in one task and are merged by a heap, a
bounded number of runs at a time; what is left are the frequencies of the terms that enough
documents of their language hold. Two sources that both lack a term differ by the same
small amount for every such term, so a pair starts from that amount times the vocabulary,
and the frequencies are streamed once more for the corrections of the terms that one or
both of them hold. All arithmetic is in integers.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, durable, lookup_join, small_batches
from .packed import planes, unplanes

# Terms are runs of ASCII letters and of everything beyond ASCII, on UTF-8 bytes.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
# Postings (a term with a source) that a block holds before it is spilled: about 60 MB.
BLOCK_POSTINGS = 400_000
# A long text goes through the block in slices of about so many bytes, cut between terms.
SLICE_BYTES = 1 << 20
# Bytes of text whose postings share a shard, which one task holds at a time.
SHARD_BYTES = 8 << 20
# Shards that one pass deals its runs to, and runs that one merge takes.
PASS_SHARDS, FAN_IN = 4_096, 1_024
# Cells of one step of the pair corrections: about 16 MB an array.
PAIR_CELLS = 2_000_000

RUN = "shard long, part long, run long, lang string, sources array<string>, n long, terms binary, docs binary, " \
      "widths binary, owners binary, counts binary"
FREQUENCIES = "lang string, term string, docs long, total long, sources array<string>, counts array<long>"


@dataclass
class _Run:
    """Sorted terms of one language; term i has widths[i] postings (owner, count), owners by `sources`."""

    lang: str
    sources: list[str]
    terms: list[bytes]
    docs: np.ndarray
    widths: np.ndarray
    owners: np.ndarray
    counts: np.ndarray

    def take(self, order: np.ndarray) -> _Run:
        """The terms at the positions `order`, with their postings."""
        starts = np.cumsum(self.widths) - self.widths
        widths = self.widths[order]
        ends = np.cumsum(widths)
        held = np.repeat(starts[order] - (ends - widths), widths) + np.arange(ends[-1] if len(ends) else 0)
        return _Run(self.lang, self.sources, [self.terms[i] for i in order], self.docs[order], widths,
                    self.owners[held], self.counts[held])


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > SLICE_BYTES:
        found = BREAK.search(text, at + SLICE_BYTES)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class _Block:
    """Postings of the documents read since the last spill."""

    def __init__(self) -> None:
        self.docs: dict[str, Counter] = {}
        self.held: dict[str, dict[str, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        docs = self.docs.setdefault(lang, Counter())
        counts = self.held.setdefault(lang, {}).setdefault(source, Counter())
        before = len(counts)
        seen: set[bytes] = set()
        for piece in _slices(text.lower()):  # bytes: only A-Z change
            terms = TERM.findall(piece)
            counts.update(terms)
            seen.update(terms)
        docs.update(seen)
        self.size += len(counts) - before

    def runs(self) -> Iterator[_Run]:
        for lang, docs in self.docs.items():
            terms = sorted(docs)
            at = {t: i for i, t in enumerate(terms)}
            sources = sorted(self.held[lang])
            counters = [self.held[lang][s] for s in sources]
            place = np.concatenate([np.fromiter(map(at.__getitem__, c), np.int64, len(c)) for c in counters])
            counts = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in counters])
            owners = np.repeat(np.arange(len(sources)), [len(c) for c in counters])
            order = np.argsort(place, kind="stable")
            yield _Run(lang, sources, terms, np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms)),
                       np.bincount(place, minlength=len(terms)), owners[order], counts[order])


def _spill(runs: Iterator[_Run], number: int, shards: int, fan_in: int) -> Iterator[pa.RecordBatch]:
    """Rows of the runs, one for each hash shard that a run has terms in."""
    columns: dict[str, list] = {c.split()[0]: [] for c in RUN.replace("array<string>", "list").split(", ")}
    for run in runs:
        shard = np.fromiter(map(zlib.crc32, run.terms), np.int64, len(run.terms)) % shards
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            piece = run.take(order[a:b])
            used, owners = np.unique(piece.owners, return_inverse=True)
            row = (shard[order[a]], number // fan_in, number, run.lang, [run.sources[i] for i in used], b - a,
                   b"\n".join(piece.terms), planes(piece.docs), planes(piece.widths), planes(owners), planes(piece.counts))
            for held, value in zip(columns.values(), row):
                held.append(value)
    if columns["shard"]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.string()), pa.int64()] + [pa.binary()] * 5
        table = pa.table([pa.array(v, k) for v, k in zip(columns.values(), kinds)], names=list(columns))
        yield from table.to_batches(max_chunksize=2_000)


def _build(shards: int, fan_in: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        spilled, now = 0, _Block()
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary())):
                now.add(lang, source, text.as_py())
                if now.size >= block:
                    yield from _spill(now.runs(), (task << 20) + spilled, shards, fan_in)
                    spilled, now = spilled + 1, _Block()
        yield from _spill(now.runs(), (task << 20) + spilled, shards, fan_in)

    return run


def _read(row: dict) -> _Run:
    n = row["n"]
    widths = unplanes(row["widths"], n).astype(np.int64)
    postings = int(widths.sum())
    values = [unplanes(row[c], postings).astype(np.int64) for c in ("owners", "counts")]
    return _Run(row["lang"], row["sources"], row["terms"].split(b"\n"), unplanes(row["docs"], n).astype(np.int64), widths, *values)


def _heap_merge(runs: list[_Run], min_docs: int) -> _Run:
    """One run of all terms that at least `min_docs` documents of the runs hold."""
    sources = sorted({s for r in runs for s in r.sources})
    at = {s: i for i, s in enumerate(sources)}
    bases = np.cumsum([0, *(len(r.terms) for r in runs)])
    streams = [zip(r.terms, range(base, base + len(r.terms))) for r, base in zip(runs, bases)]
    merged = list(heapq.merge(*streams))
    order = np.fromiter((i for _, i in merged), np.int64, len(merged))
    terms = [t for t, _ in merged]
    first = np.fromiter((i == 0 or terms[i] != terms[i - 1] for i in range(len(terms))), bool, len(terms))
    whole = _Run(runs[0].lang, sources, [t for r in runs for t in r.terms], *(np.concatenate(x) for x in (
        [r.docs for r in runs], [r.widths for r in runs],
        [np.array([at[s] for s in r.sources], np.int64)[r.owners] for r in runs], [r.counts for r in runs])))
    starts = np.flatnonzero(first)
    docs = np.add.reduceat(whole.docs[order], starts)
    keep = docs >= min_docs
    number = np.cumsum(first) - 1
    kept = whole.take(order[keep[number]])
    fresh = (np.cumsum(keep) - 1)[number[keep[number]]]
    # Postings of one term and source from several runs become one.
    key = np.repeat(fresh, kept.widths) * len(sources) + kept.owners
    by = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.diff(key[by], prepend=-1))
    counts = np.add.reduceat(kept.counts[by], heads) if len(heads) else kept.counts
    one = key[by][heads]
    return _Run(whole.lang, sources, [terms[i] for i in starts[keep]], docs[keep],
                np.bincount(one // len(sources), minlength=int(keep.sum())), one % len(sources), counts)


def _shard_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[_Run]]]:
    """Runs of one language that meet in a shard and part; input is sorted by these three."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for (_, part, _), group in groupby(rows, key=lambda r: (r["shard"], r["part"], r["lang"])):
        yield part, [_read(row) for row in group]


def _remerge(shards: int, fan_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, runs in _shard_runs(batches):
            yield from _spill(iter([_heap_merge(runs, 1)]), part, shards, fan_in)

    return run


def _finish(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, runs in _shard_runs(batches):
            got = _heap_merge(runs, min_docs)
            if not got.terms:
                continue
            starts = np.cumsum(got.widths) - got.widths
            ends = pa.array(np.append(starts, len(got.counts)), pa.int32())
            names = pa.array(got.sources).take(pa.array(got.owners))
            yield pa.record_batch({
                "lang": pa.array([got.lang] * len(got.terms)), "term": pa.array(got.terms, pa.binary()).cast(pa.string()),
                "docs": pa.array(got.docs), "total": pa.array(np.add.reduceat(got.counts, starts)),
                "sources": pa.ListArray.from_arrays(ends, names), "counts": pa.ListArray.from_arrays(ends, pa.array(got.counts)),
            })

    return run


def _texts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    columns = {"lang": lang_col, "source": source_col, "text": text_col}
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in columns.items()))


def term_frequencies(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    *,
    min_docs: int = MIN_DOCS,
    text_bytes: int | None = None,
    block: int = BLOCK_POSTINGS,
    shard_bytes: int = SHARD_BYTES,
    pass_shards: int = PASS_SHARDS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """`lang`, `term`, `docs`, `total`, `sources`, `counts` of every term in `min_docs` documents of its language.

    Nulls count as empty strings, and a text without terms adds nothing. A repeated row is a
    document of its own. The number of shards follows from the bytes of all texts (counted,
    unless given); a pass deals to at most `pass_shards` of them and merges at most `fan_in`
    runs of a shard, so a task holds one block, or those runs of one shard, at any size of
    the input. The most frequent term is one posting a run and source.
    """
    small_batches(docs.sparkSession)
    texts = _texts(docs, lang_col, source_col, text_col)
    if text_bytes is None:
        text_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(text_bytes / shard_bytes))
    # A posting of a block stands for at least one term and what ends it.
    most_runs = texts.rdd.getNumPartitions() + text_bytes // (2 * block)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(runs: DataFrame) -> DataFrame:
        return runs.repartition(parts, "shard", "part").sortWithinPartitions("shard", "part", "lang")

    now = min(shards, pass_shards)
    # In the last pass all runs of a shard are one part.
    last = most_runs <= fan_in and now == shards
    runs = texts.mapInArrow(_build(now, 1 << 62 if last else fan_in, block), RUN)
    while not last:
        most_runs = math.ceil(most_runs / fan_in)
        now = min(shards, now * pass_shards)
        last = most_runs <= fan_in and now == shards
        runs = dealt(runs).mapInArrow(_remerge(now, 1 << 62 if last else fan_in), RUN)
    return dealt(runs).mapInArrow(_finish(min_docs), FREQUENCIES)


def share(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / size), by long division in steps of a thousand, exact for sizes below 9e15."""
    whole, rest = np.divmod(count + 1, size)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + digit
    return whole + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _add_pairs(delta: np.ndarray, widths: np.ndarray, owners: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
    """Add to delta[a, b] what the terms change against both a and b lacking them."""
    n = len(sizes)
    lacking = share(np.zeros(n, np.int64), sizes)
    base = gap(lacking[:, None], lacking[None, :])
    # One side holds the term: rows of equal source and count are one.
    pairs, times = np.unique(np.stack([owners, counts]), axis=1, return_counts=True)
    who, held = pairs[0], share(pairs[1], sizes[pairs[0]])
    heads = np.flatnonzero(np.diff(who, prepend=-1))
    for other in range(n):
        alone = times * (gap(held, lacking[other]) - base[who, other])
        met = times * (gap(lacking[other], held) - base[other, who])
        delta[who[heads], other] += np.add.reduceat(alone, heads)
        delta[other, who[heads]] += np.add.reduceat(met, heads)
    # Both hold it: terms by the number of their sources, in blocks.
    p = share(counts, sizes[owners])
    starts = np.cumsum(widths) - widths
    for width in np.unique(widths[widths > 1]):
        rows = starts[widths == width]
        step = max(1, PAIR_CELLS // int(width * width))
        for k in range(0, len(rows), step):
            at = rows[k:k + step, None] + np.arange(width)
            a, b = owners[at][:, :, None], owners[at][:, None, :]
            pa_, pb = p[at][:, :, None], p[at][:, None, :]
            change = gap(pa_, pb) - gap(pa_, lacking[b]) - gap(lacking[a], pb) + base[a, b]
            np.add.at(delta, (np.broadcast_to(a, change.shape), np.broadcast_to(b, change.shape)), change)


def _corrections(sizes_by_lang: dict[str, tuple[list[str], list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas = {}
        for batch in batches:
            for lang in pc.unique(batch["lang"]).to_pylist():
                names, sizes = sizes_by_lang[lang]
                rows = batch.filter(pc.equal(batch["lang"], lang))
                widths = pc.list_value_length(rows["sources"]).to_numpy().astype(np.int64)
                owners = pc.index_in(rows["sources"].flatten(), value_set=pa.array(names)).to_numpy().astype(np.int64)
                counts = rows["counts"].flatten().to_numpy()
                delta = deltas.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
                _add_pairs(delta, widths, owners, counts, np.array(sizes, np.int64))
        for lang, delta in deltas.items():
            names = sizes_by_lang[lang][0]
            a, b = np.nonzero(delta)
            yield pa.record_batch({
                "lang": pa.array([lang] * len(a), pa.string()), "source": pa.array([names[i] for i in a], pa.string()),
                "item": pa.array([names[i] for i in b], pa.string()), "delta": pa.array(delta[a, b]),
            })

    return run


def _shares(count: str, size: str) -> F.Column:
    return F.expr(f"1 + (cast({count} + 1 as decimal(20,0)) * {SCALE} div {size})")


def divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    *,
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    **index: int,
) -> DataFrame:
    """How far each source of a language is from the others, and by which terms from the language.

    `lang`, `source`, `part`, `item`, `value`, `rank`. With p = 1 + floor(SCALE * (count + 1) / (N + V)),
    a source's smoothed share of a term, part `pair` has for each other source (`item`, shares q)
    the sum over all V kept terms of floor((p - q)^2 / q), and part `term` has the `top_terms` terms
    that the source holds above the language's share q, by the same measure. Larger values come
    first, ties by item in byte order. A source without terms has its pairs and no terms; a
    language without kept terms has pairs of value 0; a single source has no pairs. An empty
    table gives no rows. Null language, source and text are empty strings, repeated rows are
    documents of their own, and other columns are not read.

    The table of (language, source) groups goes to every task: pairs are rows of the result,
    so it is the square root of what is asked for.
    """
    groups = durable(
        _texts(docs, lang_col, source_col, text_col).groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    )
    text_bytes = groups.agg(F.sum("bytes")).first()[0] or 0
    terms = durable(term_frequencies(docs, lang_col, source_col, text_col, min_docs=min_docs, text_bytes=text_bytes, **index))
    held = terms.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("h")).select(
        "lang", "term", "total", F.col("h.sources").alias("source"), F.col("h.counts").alias("count")
    )
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sizes = durable(
        groups.select("lang", "source").join(langs, "lang", "left")
        .join(held.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.col("lang_n"), F.coalesce("n", F.lit(0)).alias("n"))
    )
    discard(groups)
    by_lang: dict[str, tuple[list[str], list[int]]] = {}
    for row in sizes.where("v > 0").orderBy("lang", "source").collect():
        names, totals = by_lang.setdefault(row["lang"], ([], []))
        names.append(row["source"])
        totals.append(row["n"] + row["v"])
    changes = (
        terms.select("lang", "sources", "counts").mapInArrow(_corrections(by_lang), "lang string, source string, item string, delta long")
        .groupBy("lang", "source", "item").agg(F.sum("delta").alias("delta"))
    )
    zero = sizes.withColumn("p", F.when(F.col("v") > 0, _shares("0", "greatest(n + v, 1)")))
    pairs = (
        zero.select("lang", "source", "v", "p").join(zero.select("lang", F.col("source").alias("item"), F.col("p").alias("q")), "lang")
        .where(F.col("source") != F.col("item")).join(changes, ["lang", "source", "item"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item",
                F.expr("coalesce(v * ((p - q) * (p - q) div q), 0) + coalesce(delta, 0)").alias("value"))
    )
    above = (
        lookup_join(held, sizes, ["lang", "source"])
        .withColumn("p", _shares("count", "(n + v)")).withColumn("q", _shares("total", "(lang_n + v)")).where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
