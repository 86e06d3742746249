"""Revisit resolution, the pipeline's stages, and registered queries against their SQL."""

import random
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import adaptive_quality, kk_packing, revisits, simhash_bk, suffix_dedup, water_filling

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0] + "/tools")
from check import rows as canonical_rows  # noqa: E402

SF = "/root/testdata/sf0.001"
HEADERS = "array<struct<name: string, value: string>>"
CAPTURES = (
    f"record_id string, kind string, url string, captured_at long, status int, headers {HEADERS}, payload_digest string, "
    "last int, turn string, response string"
)


def captures_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", "r") for r in rows], CAPTURES)


def response(record, url, at, *headers, digest="p"):
    return (record, "response", url, at, 200, list(headers), digest + (record or ""))


def revisit(record, url, at, *headers):
    return (record, "revisit", url, at, 304, list(headers), None)


def test_outcomes_and_header_merge(spark):
    tag, other, day = ("ETag", '"a"'), ("etag", '"b"'), ("Last-Modified", "mon")
    rows = [
        response("r1", "http://www.Host.com/a/?utm_source=x&b=2&a=1#top", 10, tag, day, ("Content-Type", "t"), ("X", "1"), ("X", "2")),
        revisit("v1", "https://host.com:443/a?a=1&b=2", 11, ("ETAG", 'W/"a"'), ("x", "3"), ("Content-Type", "u"), ("Connection", "close, Y"), ("Y", "9")),
        revisit("v2", "host.com/a?a=1&b=2", 12, other),
        revisit("v3", "host.com/a?a=1&b=2", 12, day),
        revisit("v4", "host.com/a?a=1&b=2", 12, ("Last-Modified", "tue")),
        revisit("v5", "host.com/a?a=1&b=2", 12),
        revisit("v6", "host.com/a?a=1&b=2", 10, tag),  # not earlier
        revisit("v7", "host.com/A?a=1&b=2", 12, tag),  # another path
        response("r2", "host.com/a?b=2&a=1", 20, other), response("r3", "host.com/a?b=2&a=1", 20, ("Server", "s")),
        revisit("v8", "host.com/a?a=1&b=2", 21, tag),  # r3 is latest and has no validator
        revisit("v9", None, 21, tag), revisit(None, "host.com/a?a=1&b=2", None, tag), ("x", "request", "host.com/a", 1, None, None, None),
        revisit("v1", "https://host.com:443/a?a=1&b=2", 11, ("ETag", '"a"')),
        ("va", "revisit", "host.com/a?a=1&b=2", 13, 304, None, None),
    ]
    got = revisits.resolve_revisits(captures_of(spark, rows)).collect()
    found = sorted((r["record_id"] or "", r["outcome"], r["refers_to"]) for r in got)
    assert found == sorted([
        ("v1", "same_etag", "r1"), ("v1", "same_etag", "r1"), ("v2", "other_etag", "r1"), ("v3", "same_date", "r1"),
        ("v4", "other_date", "r1"), ("v5", "no_validator", "r1"), ("v6", "no_earlier_response", None),
        ("v7", "no_earlier_response", None), ("v8", "validator_missing", "r3"), ("v9", "no_earlier_response", None),
        ("", "no_earlier_response", None), ("va", "no_validator", "r1"),
    ])
    updated = next(r["headers"] for r in got if r["record_id"] == "v1" and any(h["name"] == "x" for h in r["headers"]))
    assert sorted((h["name"].lower(), h["value"]) for h in updated) == [("content-type", "t"), ("etag", 'W/"a"'), ("last-modified", "mon"), ("x", "3")]
    refused = next(r for r in got if r["record_id"] == "v2")
    assert refused["status"] is None and [tuple(h) for h in refused["headers"]] == [other]
    payloads = spark.createDataFrame([("r1", "body")], "record_id string, payload string")
    bodies = {r["record_id"]: r["payload"] for r in revisits.with_payload(revisits.resolve_revisits(captures_of(spark, rows)), payloads).collect()}
    assert bodies["v1"] == "body" and bodies["v2"] is None
    assert revisits.resolve_revisits(captures_of(spark, [])).count() == 0


def test_one_hot_url_in_chunks_equals_the_plain_window(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        url, at = rng.choice(["h/a", "h/a", "h/a", f"h/{i % 9}"]), rng.randrange(200)
        rows.append(response(f"r{i}", url, at, ("ETag", str(i % 3))) if i % 4 == 0 else revisit(f"v{i}", url, at, ("ETag", str(i % 3))))
    plain = sorted(map(str, revisits.resolve_revisits(captures_of(spark, rows)).collect()))
    monkeypatch.setattr(revisits, "CHUNK_ROWS", 20)
    assert sorted(map(str, revisits.resolve_revisits(captures_of(spark, rows)).collect())) == plain


def test_stages_keep_columns_and_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df, c: sorted(r[c] for r in df.select(c).collect())
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    assert good.columns == docs.columns
    assert ids(good, "doc_id") == ids(adaptive_quality.quality(docs).where("kept"), "id")
    single = corpus_pipeline.near_duplicates(spark, good, SF)
    assert single.columns == docs.columns
    assert ids(single, "doc_id") == ids(simhash_bk.near_duplicates(good).where("id = component_id"), "id")
    cut = corpus_pipeline.repeated_passages(spark, single, SF)
    assert cut.columns == docs.columns and ids(cut, "doc_id") == ids(single, "doc_id")
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    mixed = corpus_pipeline.mix_sources(spark, cut, SF)
    assert mixed.columns == docs.columns and set(ids(mixed, "doc_id")) <= set(ids(cut, "doc_id"))
    sizes = {r["id"]: r["size"] for r in water_filling.mix(cut).collect()}
    targets = {r["source"]: r["target"] for r in water_filling.mix(cut).collect()}
    assert abs(sum(sizes[i] for i in ids(mixed, "doc_id")) - sum(targets.values())) <= len(targets) * max(sizes.values())
    packed = corpus_pipeline.pack_windows(spark, mixed, SF)
    assert sum(r["length"] for r in packed.collect()) == sum(
        r["doc_tokens"] for r in corpus_pipeline.pack_windows(spark, mixed, SF).where("start = 0").collect())


def test_a_removed_passage_leaves_whole_characters(spark):
    shared = "é" * 60
    docs = spark.createDataFrame([(1, "x" + shared), (2, "ä" + shared + "ü")], "doc_id long, text string")
    got = {r["id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[2]["kept_text"] == "äü" and got[1]["n_removed"] == 0


def test_pipeline_runs_on_its_own_stages(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "repeated_passages", "mix_sources", "pack_windows"]
    assert corpus_pipeline.run(spark, SF).count() > 50
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_training_windows_can_be_built_from_what_the_pipeline_returns(spark, monkeypatch):
    monkeypatch.setattr(kk_packing, "IDS_HELD", 1_000)
    texts = {1: "one two three " * 3_000, 2: "four", 3: "", 4: "five six " * 50}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(4, texts[4], "en", "s", len(texts[4]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    pieces = corpus_pipeline.pack_windows(spark, docs, SF).collect()
    encode = kk_packing.Encoder(kk_packing.tokenizer_folder())
    want = sorted((i, [*encode(t).tolist(), kk_packing.END_ID]) for i, t, *_ in rows)
    windows, whole = {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        window = windows.setdefault(p["sequence_id"], [])
        assert p["offset"] == len(window) and p["length"] == len(p["ids"])
        window += p["ids"]
        whole.setdefault(p["doc_id"], []).extend([(p["start"], p["ids"])])
    assert max(map(len, windows.values())) <= kk_packing.CAPACITY
    assert sorted(x for w in windows.values() for x in w) == sorted(x for _, ids in want for x in ids)
    for i in (1, 2, 3):
        assert [x for _, ids in sorted(whole[i]) for x in ids] == dict(want)[i]


LLM = sorted(k for k in entry.oracle_sql() if k.startswith("op"))


@pytest.mark.parametrize("name", LLM)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert canonical_rows(found.columns, [tuple(r) for r in found.collect()]) == canonical_rows(want.columns, want.fetchall())


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names
