"""Shards, source divergence and hard negatives, held to their rules and to brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives, shard_propagation, source_divergence

DOCS = "doc_id long, text string, lang string, source string, shard int, link string, n long, key long"


def documents(spark, rows):
    """Rows of (id, text, lang, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "x", 1, 2) for r in rows], DOCS).repartition(3)


def mixed_texts(seed=3):
    rng = random.Random(seed)
    texts = [f"text {rng.random()}" * rng.randint(1, 9) for _ in range(180)]
    for size in (2, 3, 5, 40, 150):  # the last is more than a third, and than any shard may hold
        texts += [f"copy of {size} " * (size % 7 + 1)] * size
    texts += [None, "", None, "ü" * 400]
    rng.shuffle(texts)
    return [(i, t, "en", "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_even_and_keep_groups(spark, law):
    rows = mixed_texts()
    got = shard_propagation.shards(documents(spark, rows), law=law, count=6).collect()
    assert sorted(r["id"] for r in got) == [r[0] for r in rows]
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(texts[r["id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["id"]]) for r in got)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    assert set(by_shard) <= set(range(6))
    assert all(sorted(x["slot"] for x in own) == list(range(len(own))) for own in by_shard.values())
    if law == "rows":
        counts = [len(by_shard[j]) for j in range(6)]
        assert max(counts) - min(counts) <= 1
    else:
        sizes, longest = [sum(x["size"] for x in by_shard[j]) for j in range(6)], max(r["size"] for r in got)
        assert all(abs(s - sum(sizes) / 6) <= 2 * longest for s in sizes)
    # A group lies in the fewest shards that can hold it, but for one that is cut at the end.
    group = defaultdict(set)
    weight = Counter()
    for r in got:
        group[texts[r["id"]]].add(r["shard"])
        weight[texts[r["id"]]] += 1 if law == "rows" else r["size"]
    room = sum(weight.values()) / 6
    extra = [len(s) - math.ceil(weight[t] / room) for t, s in group.items()]
    assert sum(max(0, e) for e in extra) <= 1


def test_shards_follow_given_links(spark):
    rows = [(i, f"text {i}", "en", "s") for i in range(120)]
    # Chains of documents that share a link with the next only: neighbours, though no text is repeated.
    links = [(i, f"link{j}") for i in range(60) for j in (i, i + 1) if (j % 10 or j == i) and j]
    table = spark.createDataFrame([*links, (3, None)], "id long, link string")
    got = {r["id"]: r["shard"] for r in shard_propagation.shards(documents(spark, rows), links=table, count=4).collect()}
    counts = Counter(got.values())
    assert max(counts.values()) - min(counts.values()) <= 1
    holders = defaultdict(list)
    for i, link in links:
        holders[link].append(got[i])
    shared = [h for h in holders.values() if len(h) > 1]
    apart = sum(len(h) - max(Counter(h).values()) for h in shared)
    assert apart < 0.5 * len(shared)  # a random placing leaves three in four apart


def test_shards_are_the_same_again_and_accept_strange_tables(spark):
    docs = documents(spark, mixed_texts(5)).coalesce(1).sortWithinPartitions("doc_id")
    first, second = (shard_propagation.shards(docs, count=5).orderBy("id").collect() for _ in range(2))
    assert first == second
    assert shard_propagation.shards(docs.limit(0), count=5).count() == 0
    few = documents(spark, [(1, "a", "en", "s"), (1, "a", "en", "s"), (None, None, None, None)])
    got = shard_propagation.shards(few, count=5)
    assert got.count() == 3 and got.select("shard").distinct().count() == 3 or got.select("shard").distinct().count() == 2


def test_moves_accepted_stay_within_room():
    asked = {(0, 1, 3): 10.0, (0, 1, 1): 10.0, (1, 0, 0): 5.0, (2, 1, 2): 8.0}
    share = shard_propagation.accepted_shares(asked, [20.0, 18.0, 20.0], [20.0, 20.0, 20.0])
    taken = {k: w * share[k[1], k[2]] for k, w in asked.items()}
    assert taken[0, 1, 3] + taken[0, 1, 1] + taken[2, 1, 2] <= 2 + taken[1, 0, 0] + 1e-3
    assert share[1, 3] >= share[1, 2] >= share[1, 1]  # the largest gains first


# -- source divergence -------------------------------------------------------------------


def plain_divergence(rows, min_docs=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        keep = set(kept)
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in keep)
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = [(-sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept), item.encode()) for item, o in counts.items() if item != s]
            terms = [(-((p(c, t) - p(whole, t)) ** 2 // p(whole, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


def source_rows(seed=9):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(90)] + ["Ünder", "ünder", "ÉTÉ", "naïve", "日本", "straße", "İx"]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "ä", None] + ["hot"] * 5)
        some = words[: rng.randint(3, len(words))]
        rows.append((i, "".join(rng.choice(some) + rng.choice([" ", "1", "_", "-", "\n", "\x7f"]) for _ in range(rng.randint(0, 60))), lang, source))
    rows += [(900, None, "en", "null"), (901, "123 456", "en", "noterms"), (902, "only here", "xx", "one"), (903, "only", "xx", "two"), (904, "Ab" * 3000, "xx", "two")]
    return rows + rows[:7]


@pytest.mark.parametrize("bounds", [{}, {"block": 40, "shard_bytes": 2_000, "pass_shards": 3, "fan_in": 4}])
def test_divergence_equals_plain_counting(spark, bounds):
    rows = source_rows()
    got = source_divergence.divergence(documents(spark, rows), **bounds)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows)


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 10)
    text = b"abc defghijklmnopq rs  tuvw " * 20 + b"x" * 40
    assert [t for piece in source_divergence._slices(text) for t in source_divergence.TERM.findall(piece)] == source_divergence.TERM.findall(text)


def test_divergence_of_empty_and_single_sources(spark):
    assert source_divergence.divergence(documents(spark, [(1, "a b", "en", "s")]).limit(0)).count() == 0
    one = documents(spark, [(i, "same words", "en", "s") for i in range(4)])
    assert source_divergence.divergence(one).collect() == []  # no other source, and no term above the language's share


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 5, 10**12, 4 * 10**15])
    sizes = np.array([3, 7 * 10**9, 3 * 10**12, 8 * 10**15])
    assert source_divergence.share(counts, sizes).tolist() == [1 + 10**9 * (c + 1) // s for c, s in zip(counts.tolist(), sizes.tolist())]


# -- hard negatives ----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, rank int, window long, score long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3) for i, v, label in rows], VECTORS).repartition(3)


def plain_negatives(rows, step=100, positives=5, negatives=10):
    fit = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for a, va, la in fit:
        if a % step:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in fit if len(v) == len(va)]
        for ps, p, _ in sorted(x for x in scored if x[2] == la and x[1] != a)[:positives]:
            inside = sorted(x for x in scored if x[2] != la and -30 * ps <= -100 * x[0] <= -90 * ps)[:negatives]
            out += [(a, p, rank, i, -ps, -s) for rank, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def vector_rows(seed=2, n=700, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dims))
    rows = []
    for i in range(n):
        v = centres[i % 9] + 0.4 * rng.standard_normal(dims)
        if i % 3 == 0:
            v = centres[0] * 0.9  # a third of all rows are copies
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 4))))
    rows += [(n + 100, None, 1), (n + 101, [None] + [0.1] * (dims - 1), 1), (n + 102, [math.nan] * dims, 2), (n + 103, [math.inf] * dims, 2)]
    rows += [(n + 104, [0.1] * dims, None), (n + 105, [0.0] * dims, 1), (10_000, [0.5, 0.5], 1), (10_001, [0.5, 0.4], 1), (10_002, [0.3, 0.3], 2)]
    rows += [(10_100, [], 1), (10_101, [], 1), (10_102, [], 3), (10_200, [-1.0] * dims, 0)]
    return rows


@pytest.mark.parametrize("chunk", [hard_negatives.CHUNK, 3])
def test_negatives_equal_brute_force(spark, chunk):
    rows = vector_rows()
    got = hard_negatives.mine(vectors(spark, rows), chunk=chunk)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_negatives_of_repeated_and_no_rows(spark):
    rows = vector_rows(4, 150)
    repeated = vectors(spark, rows + rows[:60])
    assert sorted(tuple(r) for r in hard_negatives.mine(repeated).collect()) == plain_negatives(rows)
    assert hard_negatives.mine(repeated.limit(0)).collect() == []
    everyone = hard_negatives.mine(vectors(spark, rows), anchor=F.col("id") % 10 == 0, positives=2, negatives=3)
    assert sorted(tuple(r) for r in everyone.collect()) == plain_negatives(rows, 10, 2, 3)


def test_pruning_keeps_all_pairs_that_reach_the_threshold():
    rng = np.random.default_rng(8)
    q, x = rng.integers(-90, 91, (20, 30)), rng.integers(-90, 91, (500, 30))
    q[:, 20:] //= 10  # the last dimensions are covered by their norms
    x[250:, 10:] = 0
    scores = q @ x.T
    windows = np.arange(20)
    a = hard_negatives.Anchors(windows, windows, q, windows, windows, windows, windows, True, 1)
    for need in (scores.max(axis=1) - 5_000, np.full(20, 40_000), np.full(20, -10**9), np.full(20, 10**9)):
        who, which, got = hard_negatives._scores(a, np.arange(20), x, need)
        want = {(i, j, scores[i, j]) for i, j in zip(*np.nonzero(scores >= need[:, None]))}
        assert set(zip(who.tolist(), which.tolist(), got.tolist())) == want
