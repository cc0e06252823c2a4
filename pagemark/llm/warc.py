"""Not-modified revisit resolution for web archives.

Every revisit record (an HTTP 304) is joined as of its time to the latest
earlier full response of the same canonical URL. The response serves it if
their validators agree: payload digests if both carry one, else entity tags
(weak comparison) if both do, else modification dates. The resolved record
takes the response's headers, overlaid by those a 304 may update; headers that
describe the stored body stay the response's.

The as-of join is a window per (URL, time bucket); what a bucket needs from
earlier ones comes from one aggregate row per (URL, bucket). A URL with a third
of all records spreads over its buckets, and responses travel without bodies:
the result points to the response record.

Equal times: a response at the revisit's own time is not earlier; of responses
at one time the one with the largest id counts. Null URLs or times never
match. Null headers are empty, header names are compared in lower case.
Repeated rows stay. Empty tables give empty results. Extra columns are
ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagemark.llm.common import narrow

BUCKET_SECONDS = 86_400
# Header fields a 304 may not update: they describe the stored representation
# or one connection.
KEPT = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection", "trailer")
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, without default port, fragment and tracking
    parameters; parameters sorted; an empty path is ``/``. A URL without ``scheme://`` is
    only trimmed and loses its fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[^:/?]*://([^/?]*)", 1))
    port = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(
        scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_extract(bare, r"^[^:/?]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)")))
    full = F.concat(scheme, F.lit("://"), port, F.when(path == "", F.lit("/")).otherwise(path),
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(scheme == "", bare).otherwise(full)


def _lowered(headers: Column) -> Column:
    """Lower-case names; of a repeated name the last value."""
    entries = F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string,string>)")))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), F.lower(e["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def merge_headers(stored: Column, update: Column) -> Column:
    """Stored headers overlaid by the permitted ones of a 304 (both lower-cased)."""
    allowed = F.map_filter(update, lambda k, v: ~k.isin(*KEPT) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve(records: DataFrame, id_col: str = "record_id", url_col: str = "url", ts_col: str = "ts",
            status_col: str = "status", headers_col: str = "headers", digest_col: str = "digest",
            bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Per 304 record ``record_id, canonical_url, ts, response_id, outcome, headers``.
    ``ts`` in seconds. Outcomes: ``resolved``, ``validator_mismatch``, ``no_response``;
    the last two keep their own headers."""
    base = records.select(
        F.col(id_col).alias("record_id"), canonical_url(F.col(url_col)).alias("canonical_url"),
        F.col(ts_col).cast("long").alias("ts"), F.col(status_col).cast("int").alias("status"),
        _lowered(F.col(headers_col)).alias("headers"), F.col(digest_col).alias("digest"),
    ).filter(F.col("status").isin(200, 304))
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    full = F.when((F.col("status") == 200) & usable, F.struct("ts", "record_id", F.to_json("headers").alias("headers"), "digest"))
    rows = base.withColumn("bucket", F.floor(F.col("ts") / bucket_seconds)).withColumn("full", full)
    # Rows with no URL or time get keys of their own.
    rows = rows.withColumn("key", F.when(usable, F.col("canonical_url")).otherwise(F.concat(F.lit("\u0000"), F.col("record_id").cast("string"))))
    last = rows.groupBy("key", "bucket").agg(F.max("full").alias("last"))
    earlier = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("key", "bucket", F.max("last").over(earlier).alias("carried")).filter("carried IS NOT NULL")
    # Earlier within the bucket: strictly smaller time.
    within = W.partitionBy("key", "bucket").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    seen = rows.withColumn("inside", F.max("full").over(within)).filter("status = 304")
    joined = seen.join(carried, ["key", "bucket"], "left").withColumn("found", F.coalesce("inside", "carried"))
    stored = F.from_json(F.col("found.headers"), "map<string,string>")
    tag = lambda h: F.regexp_replace(F.trim(h["etag"]), r"^W/", "")
    pair = joined.withColumn("stored", stored)
    same = (F.when(F.col("digest").isNotNull() & F.col("found.digest").isNotNull(), F.col("digest") == F.col("found.digest"))
            .when(F.col("headers")["etag"].isNotNull() & F.col("stored")["etag"].isNotNull(), tag(F.col("headers")) == tag(F.col("stored")))
            .otherwise(F.coalesce(F.col("headers")["last-modified"] == F.col("stored")["last-modified"], F.lit(False))))
    outcome = F.when(F.col("found").isNull(), "no_response").when(same, "resolved").otherwise("validator_mismatch")
    told = pair.withColumn("outcome", outcome)
    return narrow(told).select(
        "record_id", "canonical_url", "ts",
        F.when(F.col("outcome") == "resolved", F.col("found.record_id")).alias("response_id"), "outcome",
        F.when(F.col("outcome") == "resolved", merge_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))
