"""Vector hashing and language-model scores, held to brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import lm_difference, pstable_lsh
from plumbline.llm.components import components


def smallest_reachable(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label



def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 400)] + [(5, x) for x in range(500, 700)] + [(8, 8), (9, 7), (7, 9), (7, 6)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    want = smallest_reachable(links, {x for link in links for x in link})
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(frame.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, vec string, cid int"


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((60, 24))
    rows = [(i, v) for i, v in enumerate(base)]
    for i in range(40):
        for step in (0.02, 0.1, 0.3):
            rows.append((len(rows), base[i] + step * rng.standard_normal(24)))
    rows += [(len(rows) + k, base[0] * (k + 1)) for k in range(6)]
    table = spark.createDataFrame([(i, [float(x) for x in v], 1, "x", 0) for i, v in rows], VECTORS)
    stored = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    ids = sorted(stored)
    unit = np.stack([stored[i] / np.linalg.norm(stored[i]) for i in ids])
    close = unit @ unit.T >= 0.9
    links = [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j and close[i, j]]
    want = smallest_reachable(links, ids)
    counts = Counter(x for link in links for x in link)
    # A recall this high misses no pair of so few, so the result is exact.
    got = {r["id"]: r for r in pstable_lsh.near_duplicates(table, recall=0.999999).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: counts[i] for i in ids}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_unusable_repeated_and_unequal_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, nan]), (6, [inf, 1.0]),
            (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [2.0, 0.0]), (None, [0.0, 5.0]), (10, [1e-30, 0.0])]
    got = pstable_lsh.near_duplicates(spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows], VECTORS)).collect()
    found = sorted((r["id"] if r["id"] is not None else 99, r["n_links"], r["component_id"], r["kept"]) for r in got if r["id"])
    assert found == [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
                     (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 4, 1, False)]
    assert sorted((r["n_links"], r["component_id"]) for r in got if r["id"] is None and r["component_id"]) == [(4, 1)]
    assert pstable_lsh.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("limit", [4, 4096])
def test_recall_and_blocks_against_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(pstable_lsh, "BLOCK_LIMIT", limit)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    # Partners at a cosine just above the threshold, where tables miss most.
    other = rng.standard_normal((300, 16))
    other -= (other * unit).sum(axis=1, keepdims=True) * unit
    partner = 0.91 * unit + math.sqrt(1 - 0.91**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0, "", 0) for i, v in enumerate(np.concatenate([unit, partner]))]
    got = pstable_lsh.near_duplicates(spark.createDataFrame(rows, VECTORS)).agg({"n_links": "sum"}).first()[0]
    whole = np.concatenate([unit, partner]).astype(np.float32).astype(float)
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    pairs = int(np.triu(whole @ whole.T >= 0.9, 1).sum())
    assert 0.97 * pairs <= got / 2 <= pairs


def brute_scores(rows, min_share, pair_share):
    lower = {c: c + 32 for c in range(65, 91)}
    texts = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for _, t, _ in rows]
    words = Counter(w for t in texts for w in t)
    total = sum(words.values())
    kept = {w for w, c in words.items() if c >= max(1, math.ceil(min_share * total))}
    runs = [["<s>", *(w if w in kept else "<unk>" for w in t), "</s>"] for t in texts]
    models = []
    for only in (True, False):
        some = [r for r, (_, _, good) in zip(runs, rows) if good or not only]
        models.append((Counter(w for r in some for w in r[1:]), Counter(p for r in some for p in zip(r, r[1:])), len(some)))
    least = max(1, math.ceil(pair_share * (total + len(rows))))
    pairs = {p for p, c in models[1][1].items() if c >= least}
    found = []
    for run, (_, _, good) in zip(runs, rows):
        losses = []
        for (unigrams, bigrams, docs), inside in zip(models, (good, True)):
            if inside:  # no document counts for its own score
                unigrams, bigrams, docs = unigrams - Counter(run[1:]), bigrams - Counter(zip(run, run[1:])), docs - 1
            size = sum(unigrams.values()) + lm_difference.WORD_PRIOR * (len(kept) + 2)
            loss = 0.0
            for v, w in zip(run, run[1:]):
                word = (unigrams[w] + lm_difference.WORD_PRIOR) / size
                seen = docs if v == "<s>" else unigrams[v]
                joint = bigrams[v, w] if (v, w) in pairs else 0
                loss -= math.log((joint + lm_difference.CONTEXT_PRIOR * word) / (seen + lm_difference.CONTEXT_PRIOR))
            losses.append(loss / (len(run) - 1))
        found.append((len(run) - 1, *losses))
    return found


SCORED = "doc_id long, text string, good boolean, id int, chosen string, n int"


@pytest.mark.parametrize("shares", [(1e-6, 2e-7), (0.01, 0.004)])
def test_scores_equal_brute_force(spark, monkeypatch, shares):
    monkeypatch.setattr(lm_difference, "HELD", 50)
    rng = random.Random(6)
    rows = []
    for i in range(80):
        good = rng.choice([True, False, None])
        pool = ["Red", "green", "blue", "é"] if good else ["one", "TWO", "three", "green"]
        rows.append((i, " ".join(rng.choice(pool) + str(rng.randrange(9)) for _ in range(rng.randrange(0, 40))), good))
    rows += [(100, None, None), (101, "", True), (102, " \t\n", False), (103, "x " * 30_000, False), (103, "x y", True), (None, "\x0bred1\x0c", None)]
    frame = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCORED)
    got = lm_difference.scores(frame, "doc_id", "text", "good", min_share=shares[0], pair_share=shares[1]).collect()
    want = sorted(brute_scores(rows, *shares))
    found = sorted((r["n_tokens"], r["target_loss"], r["background_loss"]) for r in got)
    assert np.allclose(found, want, rtol=1e-12)
    if shares[0] < 0.01:  # with every word known, the target's documents resemble it more
        mean = {k: np.mean([r["score"] for r in got if (r["id"] or 99) < 80 and bool(rows[r["id"]][2]) == k]) for k in (True, False)}
        assert mean[True] < mean[False]


def test_rare_words_of_the_target_are_kept_whatever_the_size_of_the_corpus(spark):
    # 1.2 million words: by share of all tokens, words and bigrams of two documents would be unknown.
    rows = [(1, "rareone raretwo common", True), (2, "raretwo rareone common", False), (3, "rareone raretwo", True)]
    rows += [(10 + i, "common " * 20_000, False) for i in range(60)]
    frame = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCORED)
    got = {r["id"]: r for r in lm_difference.scores(frame, "doc_id", "text", "good").collect()}
    want = dict(zip((r[0] for r in rows), brute_scores(rows, 0, 0)))
    for i in got:
        assert np.allclose((got[i]["n_tokens"], got[i]["target_loss"], got[i]["background_loss"]), want[i], rtol=1e-9)
    assert max(got[1]["score"], got[2]["score"]) < 0 < min(got[10 + i]["score"] for i in range(60))


def test_equally_good_documents_score_alike_inside_and_outside_the_target(spark, monkeypatch):
    monkeypatch.setattr(lm_difference, "SCORED_PLACES", 300)
    rng = random.Random(9)
    kinds = {"fine": [f"fine{i}" for i in range(60)], "odd": [f"odd{i}" for i in range(60)]}
    texts = [(i, "fine" if i % 3 else "odd") for i in range(360)]
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k == "fine" and i % 2 == 0) for i, k in texts]
    frame = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCORED)
    got = {r["id"]: r["score"] for r in lm_difference.scores(frame, "doc_id", "text", "good").collect()}
    inside, outside, odd = (
        np.array([got[i] for i, k in texts if want(i, k)]) for want in (
            lambda i, k: k == "fine" and i % 2 == 0, lambda i, k: k == "fine" and i % 2, lambda i, k: k == "odd")
    )
    noise = np.hypot(*(x.std() / np.sqrt(len(x)) for x in (inside, outside)))
    assert abs(inside.mean() - outside.mean()) < 4 * noise + 0.02 and max(inside.max(), outside.max()) < odd.min()


def test_scores_of_no_rows_no_words_and_no_target(spark):
    assert lm_difference.scores(spark.createDataFrame([], SCORED), "doc_id", "text", "good").count() == 0
    bare = spark.createDataFrame([(1, None, None, 1, "", 1), (2, "", None, 1, "", 1)], SCORED)
    got = lm_difference.scores(bare, "doc_id", "text", "good").collect()
    assert [r["n_tokens"] for r in got] == [1, 1] and all(math.isfinite(r["score"]) for r in got)
