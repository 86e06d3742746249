"""SimHash trees and repeated strings, held to brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from plumbline.llm import simhash_bk, suffix_dedup
from plumbline.llm.bwt_merge import first_owners, merge, repeated, transform
from plumbline.llm.suffix_dedup import Sizes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, _dropped int, key int"


def docs_of(spark, rows):
    """Rows of (id, text) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 1, 2) for i, t in rows], DOCS)


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


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def prose(rng, words):
    return " ".join(rng.choice(["alder", "Birch", "cedar", "DOGWOOD", "elm", "fir", "ginkgo"]) + str(rng.randrange(40)) for _ in range(words))


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(5)
    base = prose(rng, 300)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(40)]
    rows += [(50, base), (51, base), (52, base + " extra"), (53, base.replace("cedar1 ", "oak ", 1)), (54, "\t \n"), (55, ""),
             (56, None), (57, "one"), (58, "One"), (59, "É é x" * 3), (60, prose(rng, 40_000))]
    got = {r["id"]: r for r in simhash_bk.near_duplicates(docs_of(spark, rows)).collect()}
    prints = {i: plain_fingerprint(t or "") for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = smallest_reachable(links, prints)
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert want[51] == 50 and want[56] == 54


def test_repeated_null_and_missing_rows(spark):
    rows = [(3, "same words here now"), (3, "same words here now"), (None, "same words here now"), (None, "q r s t u v")]
    got = simhash_bk.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r["id"] or -1, r["component_id"]) for r in got if r["component_id"]) == [(-1, 3), (3, 3), (3, 3)]
    assert simhash_bk.near_duplicates(docs_of(spark, [])).count() == 0
    kept = simhash_bk.keep_one(docs_of(spark, rows + [(9, "same words here now")]))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 3, 3]


@pytest.mark.parametrize("limit", [3, 10_000])
def test_trees_find_every_pair_with_and_without_blocks(spark, limit):
    rng = random.Random(8)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for _ in range(4):
            for _ in range(rng.randrange(1, 6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = sorted((r["a"], r["b"]) for r in simhash_bk.near_links(prints, 3, shard_limit=limit).collect())
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3)
    assert got == want and len(want) > 50


def test_tree_follows_edges_within_the_radius_only():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**63, 400, dtype=np.uint64)
    group = np.sort(rng.integers(0, 3, 400))
    forest = simhash_bk.Forest(group, prints)
    asked, met = forest.search(group, prints, 26)
    gaps = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(gaps <= 26)) if group[i] == group[j]}
    assert set(zip(asked.tolist(), met.tolist())) == want and len(asked) == len(want)


def brute_removal(rows, length=50):
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            least[data[i:i + length]] = min(doc, least.get(data[i:i + length], doc))
    found = {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if least[data[i:i + length]] < doc:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = int((gone[1:] < gone[:-1]).sum())
        found[doc] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return found


def passages(rng):
    shared = [prose(rng, 20) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 30)) for _ in range(rng.randrange(1, 4))]
        for s in rng.sample(shared, rng.randrange(0, 4)):
            parts.insert(rng.randrange(len(parts) + 1), s[rng.randrange(30):])
        rows.append((i, "§".join(parts)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, None), (73, ""), (74, "a" * 300), (75, "a" * 49), (76, "b" + "a" * 80),
             (77, "\x00" * 120), (78, "\x00" * 60 + "é" * 40), (79, "x" + "é" * 60)]
    return rows


@pytest.mark.parametrize("many", [1, 5_000])
def test_removed_bytes_equal_brute_force(spark, many):
    rng = random.Random(many)
    rows = passages(rng)
    rng.shuffle(rows)
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), carry=("lang", "key"), sizes=Sizes(many_runs=many)).collect()
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_removal(rows)
    assert all(r["carry"].asDict() == {"lang": "en", "key": 2} for r in got)
    assert next(r["kept_text"] for r in got if r["id"] == 79) is not None


@pytest.mark.parametrize("many", [1, 5_000])
def test_parts_of_a_long_text_and_small_flushes(spark, many):
    small = Sizes(segment=700, flush=40, many_runs=many, run_rows=20, merge=300, shard=100)
    rng = random.Random(2)
    rows = passages(rng)
    long = prose(rng, 900)
    rows += [(90, long), (91, prose(rng, 50) + long[2000:5000] + prose(rng, 200) + long[100:170])]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), sizes=small).collect()
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_removal(rows)


def test_hot_line_meets_as_folded_rows(spark, monkeypatch):
    rng = random.Random(5)
    line = "All rights reserved; this very common line is in many of the documents."
    rows = [(i, f"{prose(rng, 8)} {line if i % 3 else ''} {prose(rng, 8)}") for i in range(900)]
    met = []
    marks = suffix_dedup._frequent_marks
    monkeypatch.setattr(suffix_dedup, "_frequent_marks", lambda folded, *rest: met.append(folded) or marks(folded, *rest))
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), sizes=Sizes(many_runs=50)).collect()
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_removal(rows)
    # 600 places of each string of the line, but at most one row a task.
    per_string = met[0].groupBy("string").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("places") / 16).alias("places"))
    held = per_string.where("places > 500").collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert held and all(f" {line} ".encode().find(r["string"]) >= 0 and r["rows"] <= parts for r in held)


def test_repeated_and_null_ids_of_texts(spark):
    text, other = "first sentence of forty or more bytes and then some more", "second text that has nothing in common with it, really"
    rows = [(1, text), (1, text), (1, other), (2, text), (None, other), (None, None)]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows)).collect()
    assert len(got) == 6
    removed = sorted((r["id"] or 99, r["n_bytes"], r["n_removed"]) for r in got)
    n, m = len(text), len(other)
    assert removed == sorted([(1, n, 0), (1, n, 0), (1, m, 0), (2, n, n), (99, m, m), (99, 0, 0)])
    assert suffix_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_first_owners_of_equal_texts():
    rng = random.Random(3)
    for _ in range(20):
        texts = [bytes(rng.choice(b"ab") for _ in range(4)) for _ in range(rng.randrange(30))]
        owner = np.array([rng.randrange(50) for _ in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        got = first_owners(data, np.full(len(texts), 4), owner, 4, rng.choice([8, 500]))
        assert got.tolist() == [min(o for t, o in zip(texts, owner) if t == text) for text in texts]


def test_merge_of_transforms_gives_sorted_intervals_and_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        depth = rng.choice([1, 2, 4])
        texts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(depth, 12))) for _ in range(rng.randrange(1, 9))]
        sizes = np.array([len(t) for t in texts])
        owner = np.array([rng.randrange(4) for _ in texts])
        who, where = repeated(np.frombuffer(b"".join(texts), np.uint8), sizes, owner, depth, rng.choice([4, 500]))
        least = {}
        for t, o in zip(texts, owner):
            for i in range(len(t) - depth + 1):
                least[t[i:i + depth]] = min(o, least.get(t[i:i + depth], o))
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - depth + 1) if least[t[i:i + depth]] < owner[k]}
        assert set(zip(who.tolist(), where.tolist())) == want
        one = transform(np.frombuffer(b"".join(texts), np.uint8), sizes)
        text, offset = one.walk(sizes)
        suffixes = [texts[t][o:] for t, o in zip(text, offset)]
        assert suffixes == sorted(suffixes)
        _, _, shared = merge([one], depth)

        def common(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        for k, s in enumerate(suffixes):
            near = [common(s, x) for j, x in enumerate(suffixes) if j != k]
            assert shared[k] == min(depth, max(near, default=0))
