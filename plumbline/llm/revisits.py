"""WARC revisit records of unchanged pages, resolved to the captures they refer to.

A server that answers "not modified" sends no content. Such a record is resolved by an
as-of join: the latest full response of the same canonical URL strictly before it. The
validators of both must agree; then the record takes the response's status, payload and
headers, with those header fields that a not-modified answer may update put in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import running_last
from ..session import durable

# Fields of one connection only, and fields that describe the stored content.
HOP_BY_HOP = [
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization",
    "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
CONTENT_BOUND = ["content-encoding", "content-length", "content-range", "content-type"]
# Query parameters that do not name content.
TRACKING = "^(?:utm_[a-z]+|gclid|fbclid|sessionid|jsessionid|phpsessid)(?:=|$)"
_URL = "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)(?:\\?([^#]*))?"


# Records of one URL that a single task may order; above it, URLs are cut into chunks of time.
CHUNK_ROWS = 1_000_000


def canonical_url(url: Column) -> Column:
    """Host without case, `www` and default port; path without closing slash; query sorted, untracked.

    Scheme and fragment do not count. A null URL stays null.
    """
    url = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), "^www[0-9]*\\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")
    pairs = F.filter(
        F.split(F.regexp_extract(url, _URL, 3), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)
    )
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def field(headers: Column, name: str) -> Column:
    """The first value of a header field, or null."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def _opaque(etag: Column) -> Column:
    """Entity tags compare weakly: a weak mark does not count."""
    return F.regexp_replace(etag, "^W/", "")


def outcome(old: Column, new: Column) -> Column:
    """How the validators of a revisit (`new` headers) relate to those of a response (`old`)."""
    old_tag, new_tag = field(old, "etag"), field(new, "etag")
    old_date, new_date = field(old, "last-modified"), field(new, "last-modified")
    tags, dates = old_tag.isNotNull() & new_tag.isNotNull(), old_date.isNotNull() & new_date.isNotNull()
    return (
        F.when(tags & (_opaque(old_tag) == _opaque(new_tag)), "same_etag")
        .when(tags, "other_etag")
        .when(dates & (old_date == new_date), "same_date")
        .when(dates, "other_date")
        .when(new_tag.isNull() & new_date.isNull(), "no_validator")
        .otherwise("validator_missing")
    )


# With no validator in the answer, the condition of the request was met all the same.
RESOLVED = ["same_etag", "same_date", "no_validator"]


def merged_headers(old: Column, new: Column) -> Column:
    """The stored fields, those that the answer may update replaced by the answer's."""
    listed = F.transform(
        F.split(F.lower(F.coalesce(field(new, "connection"), F.lit(""))), ","), lambda x: F.trim(x)
    )
    barred = F.array_union(F.array(*map(F.lit, HOP_BY_HOP + CONTENT_BOUND)), listed)
    update = F.filter(new, lambda h: ~F.array_contains(barred, F.lower(h["name"])))
    names = F.transform(update, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(old, lambda h: ~F.array_contains(names, F.lower(h["name"]))), update)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per revisit record of `captures`, with what it was resolved to.

    `captures` has `record_id`, `kind` ("response" or "revisit"), `url`, `captured_at` (any
    ordered type), `status`, `headers` (array of name and value) and `payload_digest`. The
    result has the revisit's `record_id`, `canonical_url`, `captured_at`, `outcome`,
    `refers_to` and `refers_to_at`, and, where the outcome is one of RESOLVED, `status`,
    `payload_digest` and the merged `headers`; otherwise those are null, the headers the
    revisit's own. Responses captured at the same moment are not earlier; among responses of
    one moment the largest id is the latest. A record without URL or time resolves to nothing
    ("no_earlier_response"), and null headers count as none. Repeated records are resolved
    each. Payloads are not moved: `with_payload` adds them by `refers_to`. The join runs in
    chunks of time with one carried row per URL and chunk, so one URL may hold most records.
    """
    none = F.array().cast("array<struct<name: string, value: string>>")
    plain = durable(captures.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", "status",
        F.coalesce("headers", none).alias("headers"), "payload_digest",
    ))
    usable = F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull()
    response = F.struct(
        "record_id", "captured_at", "status", "headers", "payload_digest"
    )
    # Revisits sort before the responses of their moment, which are not earlier.
    events = plain.where(usable).select(
        "*", F.when(F.col("kind") == "response", 1).otherwise(0).alias("turn"),
        F.when(F.col("kind") == "response", response).alias("response"),
        F.coalesce("record_id", F.lit("")).alias("tie"),
    )
    placed = running_last(
        events, ["canonical_url"], ["captured_at", "turn", "tie"], "response", name="last",
        small_group=CHUNK_ROWS,
    )
    revisits = placed.where("kind = 'revisit'").unionByName(
        plain.where(~usable & (F.col("kind") == "revisit")).withColumn("last", F.lit(None).cast(placed.schema["last"].dataType)),
        allowMissingColumns=True,
    )
    judged = revisits.withColumn(
        "outcome", F.when(F.col("last").isNull(), "no_earlier_response").otherwise(outcome(F.col("last.headers"), F.col("headers")))
    )
    good = F.col("outcome").isin(RESOLVED)
    return judged.select(
        "record_id", "canonical_url", "captured_at", "outcome", F.col("last.record_id").alias("refers_to"),
        F.col("last.captured_at").alias("refers_to_at"), F.when(good, F.col("last.status")).alias("status"),
        F.when(good, F.col("last.payload_digest")).alias("payload_digest"),
        F.when(good, merged_headers(F.col("last.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Resolved records with the column `payload` of the response they refer to (`record_id`, `payload`)."""
    known = payloads.select(F.col("record_id").alias("_of"), "payload")
    good = F.col("outcome").isin(RESOLVED)
    return resolved.join(known, good & (F.col("refers_to") == F.col("_of")), "left").drop("_of")


def header_lines(headers: Column) -> Column:
    """Header fields as sorted `name: value` lines, names in lower case."""
    return F.array_join(F.array_sort(F.transform(headers, lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"]))), "\n")
