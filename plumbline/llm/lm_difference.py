"""Cross-entropy difference of matched bigram models.

A target model is trained on the target documents and a background model on all documents.
Both are matched: the same vocabulary, the same retained bigrams, the same smoothing. A
document's score is its mean loss per token under the target model minus that under the
background model; the lower, the more it resembles the target. No document is scored by its
own counts: they are taken off the models that hold it, so that documents which happen to be
in the target compare with equally good ones that are not. Copies of it still count. Only
the vocabulary and the choice of retained bigrams are those of all documents.

Words are what white space separates, with A-Z lower-cased. The vocabulary is every word
found MIN_COUNT times or more in all documents, the target's among them; other words are
one unknown word. Bigrams are kept from PAIR_COUNT on, rarer ones fall back to the unigram.
Both are fixed counts, so the models grow with the corpus and a score does not change its
meaning with the size of the input.

No table of a model is gathered anywhere. Texts are cut into parts of a few megabytes, which
are written once as word codes. A part asks for the counts of its distinct words, then of
its distinct bigrams: the keys go with the part's own counts to the bucket of their hash,
which adds up the counts of all parts and answers each part with the sums. Keys are 64-bit
hashes. A key comes once from each part, so common words do not fill a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, release_shuffles, small_batches
from .packed import planes, unplanes

MIN_COUNT = 1
PAIR_COUNT = 1
# Pseudo-counts: of the unigram in a context, and of every word in the unigram.
CONTEXT_PRIOR = 5.0
WORD_PRIOR = 0.1
# Bytes of text in a part, unless one text has more.
HELD = 8_000_000
# Keys that parts may send to one bucket, and places that are scored at a time unless one text has more.
BUCKET_KEYS = 1_000_000
SCORED_PLACES = 100_000

ASKED = "bucket int, part long, count int, keys binary, target binary, background binary"
ANSWERED = (
    "part long, bucket int, count int, target binary, background binary, known long, known_target long,"
    " known_background long"
)
U = np.uint64
# Hashes that stand for the unknown word, the start and the end of a document.
MARKS = np.array([0x51ED270B4D2C6A01, 0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03], U)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the word at every place, and the words of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    row = pc.list_parent_indices(split).to_numpy()
    coded = flat.dictionary_encode()
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), U, len(distinct))
    codes = coded.indices.to_numpy()
    # Leading and trailing white space leaves empty strings, which are no words.
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return hashes, codes[full], np.bincount(row[full], minlength=len(texts))


def _parts(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.Table]:
    """The rows of a task in parts of about `held` bytes of text, at least one row each."""
    waiting, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype=np.int64)
        low, before = 0, 0
        while low < batch.num_rows:
            high = max(int(np.searchsorted(ends, before + held - size, "right")), low if waiting else low + 1)
            if high > low:
                waiting.append(batch.slice(low, high - low))
                size += int(ends[high - 1]) - before
                low, before = high, int(ends[high - 1])
            if low < batch.num_rows:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _encode(held: int, id_type: str):
    """One row per part: ids, words and flags of its texts, word codes, distinct words and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(_parts(batches, held)):
            hashes, codes, sizes = _words(part["text"].combine_chunks())
            chosen = part["chosen"].to_numpy()
            found = np.bincount(codes, minlength=len(hashes))
            words, place = np.unique(hashes[found > 0], return_inverse=True)
            to_word = np.zeros(len(hashes), np.int64)
            to_word[found > 0] = place
            codes = to_word[codes]
            target = np.bincount(codes[np.repeat(chosen, sizes)], minlength=len(words))
            background = np.bincount(codes, minlength=len(words))
            ids = part["id"].combine_chunks()
            yield pa.record_batch({
                "part": pa.array([first + k]), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "n_docs": pa.array([len(ids)]), "n_target": pa.array([int(chosen.sum())]),
                "n_words": pa.array([len(codes)]), "n_target_words": pa.array([int(target.sum())]),
                "sizes": pa.array([planes(sizes)], pa.binary()), "chosen": pa.array([np.packbits(chosen).tobytes()], pa.binary()),
                "codes": pa.array([planes(codes)], pa.binary()), "n_distinct": pa.array([len(words)]),
                "words": pa.array([planes(np.diff(words, prepend=U(0)))], pa.binary()),
                "target": pa.array([planes(target)], pa.binary()), "background": pa.array([planes(background)], pa.binary()),
            })

    return run, (
        f"part long, ids array<{id_type}>, n_docs long, n_target long, n_words long, n_target_words long, sizes binary,"
        " chosen binary, codes binary, n_distinct long, words binary, target binary, background binary"
    )


def _asked(part: int, keys: np.ndarray, target: np.ndarray, background: np.ndarray, buckets: int) -> pa.Table:
    """Rows of ascending keys and their counts in one part, by buckets that follow the order of keys."""
    where = (keys >> U(32)) * U(buckets) >> U(32)
    edges = np.searchsorted(where, np.arange(buckets + 1, dtype=U))
    rows = [
        (b, part, high - low, planes(np.diff(keys[low:high], prepend=U(0))), planes(target[low:high]), planes(background[low:high]))
        for b, (low, high) in enumerate(zip(edges, edges[1:])) if low < high
    ]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in ASKED.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.cumsum(unplanes(r["words"], r["n_distinct"]), dtype=U)
                counts = (unplanes(r[c], r["n_distinct"]) for c in ("target", "background"))
                yield from _asked(r["part"], keys, *counts, buckets).to_batches()

    return run


def _answer(least: int):
    """For each row that asks, the sums over all parts; on one row of a bucket what it has in `least` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                by_bucket.setdefault(r["bucket"], []).append(r)
        for bucket in list(by_bucket):
            asked = by_bucket.pop(bucket)
            keys = np.concatenate([np.cumsum(unplanes(r["keys"], r["count"]), dtype=U) for r in asked])
            distinct, place = np.unique(keys, return_inverse=True)
            sums = []
            for c in ("target", "background"):
                total = np.zeros(len(distinct), np.int64)
                np.add.at(total, place, np.concatenate([unplanes(r[c], r["count"]) for r in asked]).astype(np.int64))
                sums.append(total)
            known = sums[1] >= least
            stats = [int(known.sum()), int(sums[0][known].sum()), int(sums[1][known].sum())]
            edges = np.cumsum([0, *(r["count"] for r in asked)])
            rows = [
                (r["part"], bucket, r["count"], *(planes(x[place[low:high]]) for x in sums), *(stats if not low else (0, 0, 0)))
                for r, low, high in zip(asked, edges, edges[1:])
            ]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in ANSWERED.split(", ")]
            )
        pa.default_memory_pool().release_unused()

    return run


def _sums(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all parts of one part's keys, in the order of the keys."""
    mine = answers.filter(pc.equal(answers["kind"], kind)).select(["bucket", "count", "target", "background"])
    rows = mine.sort_by("bucket").to_pylist()
    return tuple(
        np.concatenate([np.zeros(0, np.int64), *(unplanes(r[c], r["count"]).astype(np.int64) for r in rows)])
        for c in ("target", "background")
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Part:
    """The places of one part: its words, then the unknown word, the start and the end by number."""

    def __init__(self, row: dict, answers: pa.Table, least: int):
        self.number, self.ids = row["part"], row["ids"]
        hashes = np.concatenate([np.cumsum(unplanes(row["words"], row["n_distinct"]), dtype=U), MARKS])
        self.target, self.background = _sums(answers, 0)
        self.unknown, self.start, self.end = np.arange(row["n_distinct"], row["n_distinct"] + 3)
        ids = np.where(self.background >= least, np.arange(row["n_distinct"]), self.unknown).astype(np.int32)
        self.sizes = unplanes(row["sizes"], row["n_docs"]).astype(np.int64)
        self.places = self.sizes + 1
        ends = np.cumsum(self.places) - 1
        self.heads = ends - self.sizes
        token = np.full(int(self.places.sum()), self.end, np.int32)
        inner = np.ones(len(token), bool)
        inner[ends] = False
        token[inner] = ids[unplanes(row["codes"], row["n_words"])]
        context = np.empty(len(token), np.int32)
        context[1:] = token[:-1]
        context[self.heads] = self.start
        keys = _mixed(hashes[context] ^ _mixed(hashes[token] + U(0x9E3779B97F4A7C15)))
        # Distinct bigrams in the order of their keys, one of the places of each, and the bigram at every place.
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        self.keys, at = keys[new], order[new]
        self.pair = np.empty(len(order), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - 1
        del keys, order, new
        self.context, self.token = context[at], token[at]
        chosen = np.unpackbits(np.frombuffer(row["chosen"], np.uint8), count=row["n_docs"]).astype(bool)
        self.chosen = np.repeat(chosen, self.places)


def _ask_pairs(buckets: int, least: int):
    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        part = _Part(parts.to_pylist()[0], answers, least)
        target = np.bincount(part.pair[part.chosen], minlength=len(part.keys))
        return _asked(part.number, part.keys, target, np.bincount(part.pair, minlength=len(part.keys)), buckets)

    return run


def _own(doc: np.ndarray, item: np.ndarray, items: int) -> np.ndarray:
    """At every place, how often its item is found in its document."""
    _, place, count = np.unique(doc * np.int64(items) + item, return_inverse=True, return_counts=True)
    return count[place]


def _score(least: int, pair_least: int, size: int, sides: list[tuple[int, int, int]]):
    """`size` counts the known words; `sides` has unknown words, all words and documents of target and background."""

    def run(parts: pa.Table, answers: pa.Table) -> pa.Table:
        part = _Part(parts.to_pylist()[0], answers, least)
        pairs = _sums(answers, 1)
        known = pairs[1] >= pair_least
        unigrams = [np.concatenate([own, [side[0], 0, side[2]]]) for own, side in zip((part.target, part.background), sides)]
        found = np.empty((2, len(part.places)))
        first = 0
        while first < len(part.places):
            low = part.heads[first]
            last = max(first + 1, int(np.searchsorted(part.heads + part.places, low + SCORED_PLACES, "right")))
            places, heads = part.places[first:last], part.heads[first:last] - low
            at = slice(low, low + int(places.sum()))
            pair, chosen = part.pair[at], part.chosen[at]
            token, context = part.token[pair], part.context[pair]
            doc = np.repeat(np.arange(last - first), places)
            own_pair, own_word = _own(doc, pair, len(part.keys)), _own(doc, token, len(unigrams[0]))
            own_seen = np.concatenate([[1], own_word[:-1]])
            own_seen[heads] = 1
            for k, (holds, (_, words, docs)) in enumerate(zip((chosen, np.ones(len(chosen), bool)), sides)):
                # The start is never predicted: the known words, the unknown one and the end are.
                others = words + docs - np.where(holds, places[doc], 0)
                word = (unigrams[k][token] - own_word * holds + WORD_PRIOR) / (others + WORD_PRIOR * (size + 2))
                seen = np.where(context == part.start, docs, unigrams[k][context]) - own_seen * holds
                joint = np.where(known[pair], pairs[k][pair] - own_pair * holds, 0)
                loss = -np.log((joint + CONTEXT_PRIOR * word) / (seen + CONTEXT_PRIOR))
                found[k, first:last] = np.add.reduceat(loss, heads) / places
            first = last
        pa.default_memory_pool().release_unused()
        return pa.table({
            "id": parts["ids"].combine_chunks().flatten(), "n_tokens": pa.array(part.places), "target_loss": pa.array(found[0]),
            "background_loss": pa.array(found[1]), "score": pa.array(found[0] - found[1]),
        })

    return run


def scores(
    docs: DataFrame, id_col: str, text_col: str, target_col: str, *,
    min_share: float | None = None, pair_share: float | None = None,
) -> DataFrame:
    """`id`, `n_tokens`, `target_loss`, `background_loss`, `score` for every row of `docs`.

    `target_col` is a boolean; null counts as false. Losses are means in nats per token; the
    end of a text is its last token, so a null or empty text has one. Repeated rows count
    and are scored each, by the models without that row. Without other target documents the
    target model is its priors; an empty
    table gives no rows. Other columns are not read. Shares of all words and tokens, where
    given, replace the fixed counts from which words and bigrams are kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(target_col), F.lit(False)).alias("chosen"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    parts = durable(rows.mapInArrow(*_encode(HELD, kind)))
    totals = ["n_words", "n_target_words", "n_docs", "n_target"]
    total, target_total, n_docs, n_target = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in totals]).first()
    least = MIN_COUNT if min_share is None else max(1, int(np.ceil(min_share * total)))
    pair_least = PAIR_COUNT if pair_share is None else max(1, int(np.ceil(pair_share * (total + n_docs))))

    # Every place of a part asks for one word and one bigram at most; tasks are as many as buckets.
    buckets = max(partitions, -(-(total + n_docs) // BUCKET_KEYS))

    def answered(asked: DataFrame, least: int) -> DataFrame:
        answers = durable(asked.repartition(buckets, "bucket").mapInArrow(_answer(least), ANSWERED))
        release_shuffles(spark)
        return answers

    words = answered(parts.select("part", "n_distinct", "words", "target", "background").mapInArrow(_ask_words(buckets), ASKED), least)
    size, known_target, known = words.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("known", "known_target", "known_background")]).first()
    places = parts.select("part", "ids", "n_docs", "n_words", "sizes", "chosen", "codes", "n_distinct", "words")

    def with_answers(answers: DataFrame, run, schema: str) -> DataFrame:
        return places.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, schema)

    def told(answers: DataFrame, kind: int) -> DataFrame:
        return answers.select("part", "bucket", "count", "target", "background", F.lit(kind).alias("kind"))

    asked = with_answers(told(words, 0), _ask_pairs(buckets, least), ASKED)
    pairs = answered(asked, pair_least)
    sides = [(target_total - known_target, target_total, n_target), (total - known, total, n_docs)]
    return with_answers(
        told(words, 0).unionByName(told(pairs, 1)), _score(least, pair_least, size, sides),
        f"id {kind}, n_tokens long, target_loss double, background_loss double, score double",
    )
