"""Captures derived from the `pages` table: what a crawler that returns to pages would store.

Every page is captured once in full. Every fourth is captured again with other content, and
up to three not-modified answers follow, some before the first capture, with validators that
match, differ or are absent, as a hash of the page number decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The same expressions serve DuckDB; {h} is the hash number of a page, {d} its content digest.
FIRST_AT = "1700000000 + h % 10000000"


def _headers(*pairs: tuple[str, str, str]) -> str:
    """SQL of an array of header fields from (condition, name, value)."""
    fields = ", ".join(
        f"CASE WHEN {when} THEN named_struct('name', '{name}', 'value', {value}) END" for when, name, value in pairs
    )
    return f"filter(array({fields}), x -> x IS NOT NULL)"


RESPONSE = [
    ("true", "Content-Type", "'text/html'"),
    ("true", "Content-Length", "cast(n_bytes AS STRING)"),
    ("h % 5 <> 0", "ETag", "concat('\"', digest, '\"')"),
    ("h % 3 <> 0", "Last-Modified", "concat('d', cast(first_at AS STRING))"),
    ("true", "Cache-Control", "'max-age=60'"),
    ("h % 2 = 0", "Set-Cookie", "'a=1'"),
]
CHANGED = [
    ("true", "Content-Type", "'text/html'"),
    ("true", "Content-Length", "cast(n_bytes + 1 AS STRING)"),
    ("true", "ETag", "concat('\"', reverse(digest), '\"')"),
    ("true", "Last-Modified", "concat('d', cast(first_at + 500000 AS STRING))"),
]
REVISIT = [
    ("true", "Content-Length", "'0'"),
    ("true", "Connection", "'close, X-Hop'"),
    ("true", "X-Hop", "'1'"),
    ("(h + i) % 4 <> 0", "ETag", "concat(CASE WHEN i = 1 THEN 'W/' ELSE '' END, '\"', digest, '\"')"),
    ("(h + i) % 7 <> 0", "Last-Modified", "concat('d', cast(first_at AS STRING))"),
    ("true", "cache-control", "'max-age=600'"),
    ("h % 2 = 0", "Set-Cookie", "concat('a=', cast(i + 2 AS STRING))"),
]


def captures(pages: DataFrame) -> DataFrame:
    """Captures in the form that `resolve_revisits` takes; `captured_at` in seconds."""
    base = pages.select(
        "page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("long").alias("h"),
    ).withColumn("first_at", F.expr(FIRST_AT))

    def capture(kind: str, record: str, url: str, at: str, status: int, headers: str, digest: str) -> str:
        return (
            f"named_struct('record_id', {record}, 'kind', '{kind}', 'url', {url}, 'captured_at', {at}, "
            f"'status', {status}, 'headers', {headers}, 'payload_digest', {digest})"
        )

    made = [
        capture("response", "concat('r', page_id)", "url", "first_at", 200, _headers(*RESPONSE), "digest"),
        "CASE WHEN h % 4 = 0 THEN " + capture(
            "response", "concat('q', page_id)", "concat(url, '#again')", "first_at + 500000", 200, _headers(*CHANGED),
            "reverse(digest)",
        ) + " END",
    ]
    for i in range(3):
        headers = _headers(*[(w.replace("i)", f"{i})").replace("i =", f"{i} ="), n, v.replace("i =", f"{i} =").replace("i +", f"{i} +"))
                             for w, n, v in REVISIT])
        made.append(f"CASE WHEN (h + {i}) % 3 <> 2 THEN " + capture(
            "revisit", f"concat('v', page_id, '-{i}')", "regexp_replace(url, '^https?://(www[.])?', 'HTTP://www.')",
            f"first_at + {i} * 400000 - 100000", 304, headers, "cast(NULL AS STRING)",
        ) + " END")
    return base.select(F.explode(F.expr(f"array({', '.join(made)})")).alias("c")).where("c IS NOT NULL").select("c.*")
