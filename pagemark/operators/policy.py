"""Request-log policy.

Per-request checks are projections; the key set and the host allow-list are
small tables joined by equality (AQE broadcasts them by measured size); key
rotation is an as-of merge inside time buckets; the rate
limit is the only shuffle by identity (see ``folds``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemark.functions.urls import query_param
from pagemark.operators import folds

# --- fixed values: the discovery path and the redacted parameter -------------
WELL_KNOWN = "/.well-known"
KEY_RE = "([?&]key=)[^&\\s]+"
WS_TRIM_RE = "^[ \t\r\n]+|[ \t\r\n]+$"


def header_map(headers: Column) -> Column:
    """Header names lower-cased; with the session's LAST_WIN dedup policy a
    repeated name keeps its last value."""
    return F.map_from_entries(F.transform(headers, lambda h: F.struct(
        F.lower(h["name"]).alias("name"), h["value"].alias("value"))))


def client_identity(requests: DataFrame) -> DataFrame:
    """L1: cf-connecting-ip, else first x-forwarded-for item trimmed, else
    the peer, else `unknown`; empty values count as absent."""
    h = F.col("_h")
    xff = F.regexp_replace(F.split(F.coalesce(h["x-forwarded-for"], F.lit("")), ",").getItem(0), WS_TRIM_RE, "")
    d = requests.withColumn("_h", header_map(F.col("headers")))
    return d.withColumn("identity", F.coalesce(
        F.nullif(h["cf-connecting-ip"], F.lit("")), F.nullif(xff, F.lit("")),
        F.col("client_ip"), F.lit("unknown"))).withColumn(
        "host_header", F.regexp_extract(F.coalesce(h["host"], F.lit("")), "^(\\[[^\\]]*\\]|[^:]*)", 1)).drop("_h")


def key_set(lines: DataFrame) -> DataFrame:
    """A4: trimmed, non-blank, non-comment lines as a set (per version)."""
    t = F.regexp_replace(F.col("line"), WS_TRIM_RE, "")
    return (lines.select("loaded_at", t.alias("key"))
            .where((F.col("key") != "") & ~F.col("key").startswith("#"))
            .distinct())


def allowed_hosts(option: str, spark) -> DataFrame:
    """Comma list option split, trimmed, empties dropped."""
    df = spark.createDataFrame([(option,)], "opt string")
    return df.select(F.explode(F.filter(F.transform(F.split("opt", ","), lambda x: F.trim(x)),
                                        lambda x: x != "")).alias("host")).distinct()


BUCKET_US = 60_000_000   # as-of windows run per minute
SUPER = 1024             # buckets of one carry group


def key_asof(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """``loaded_at`` of the key-file version in force at each request
    (the latest load at or before it; null before the first).

    An as-of merge: versions and requests in one table, ordered by time inside a
    minute, the last version so far. What a minute needs from earlier ones comes
    from one row per minute that has versions, in two steps: earlier minutes of its
    group of ``SUPER``, and one row that lists the last version of each group. The
    work is that of one shuffle of the requests, however many versions there are.
    Requests without a time have no version.
    """
    us = F.unix_micros("ts")
    bucket = F.floor(us / BUCKET_US).cast("long")
    group = lambda b: F.floor(b / SUPER).cast("long")
    versions = keys.select(F.col("loaded_at").alias("_version")).where("loaded_at IS NOT NULL").distinct()
    r = requests.select(F.struct(*requests.columns).alias("_row"), F.col("ts").alias("_at"), F.lit(1).alias("_kind"), bucket.alias("_bucket"),
                        F.lit(None).cast("timestamp").alias("_version"))
    marks = versions.select(
        F.lit(None).cast(r.schema["_row"].dataType).alias("_row"), F.col("_version").alias("_at"), F.lit(0).alias("_kind"),
        F.floor(F.unix_micros("_version") / BUCKET_US).cast("long").alias("_bucket"), "_version")
    so_far = Window.partitionBy("_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most one row per minute that has versions, and one list of the groups' last ones.
    last = marks.groupBy("_bucket").agg(F.max("_version").alias("_last"))
    lists = last.groupBy(group(F.col("_bucket")).alias("_group")).agg(
        F.max("_last").alias("_group_last"), F.array_sort(F.collect_list(F.struct("_bucket", "_last"))).alias("_inside"))
    groups = lists.agg(F.array_sort(F.collect_list(F.struct("_group", "_group_last"))).alias("_groups"))
    merged = r.unionByName(marks).withColumn("_here", F.last("_version", True).over(so_far)).where("_kind = 1")
    merged = merged.withColumn("_group", group(F.col("_bucket"))).join(lists.select("_group", "_inside"), "_group", "left").crossJoin(F.broadcast(groups))
    inside = F.array_max(F.transform(F.filter("_inside", lambda x: x["_bucket"] < F.col("_bucket")), lambda x: x["_last"]))
    before = F.array_max(F.transform(F.filter("_groups", lambda x: x["_group"] < F.col("_group")), lambda x: x["_group_last"]))
    return merged.select("_row.*", F.coalesce("_here", inside, before).alias("loaded_at"))


def key_asof_intervals(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """L7 for a stream of requests, which no window can order: the newest, open version is
    one aggregated row; the closed intervals of the static side are cut into days
    and matched by an equi-join on the day plus the range.
    """
    versions = keys.select("loaded_at").distinct()
    newest = versions.agg(F.max("loaded_at").alias("_newest"))
    to_day = lambda c: F.floor(F.unix_seconds(c) / 86400).cast("long")
    closed = (versions.withColumn("_until", F.lead("loaded_at").over(Window.orderBy("loaded_at")))
              .where(F.col("_until").isNotNull())
              .select(F.col("loaded_at").alias("_from"), "_until", F.explode(F.sequence(
                  to_day(F.col("loaded_at")), to_day(F.col("_until")))).alias("_vday")))
    inside = (F.col("_day") == F.col("_vday")) & (F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_until"))
    r = requests.withColumn("_day", to_day(F.col("ts"))).join(closed, inside, "left")
    return (r.crossJoin(F.broadcast(newest))  # one row
            .withColumn("loaded_at", F.when(F.col("ts") >= F.col("_newest"), F.col("_newest")).otherwise(F.col("_from")))
            .drop("_day", "_vday", "_from", "_until", "_newest"))


def key_check(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """L5 + L6 (+L7): presented key (first non-blank `key`, decoded) is valid
    when non-empty and in the key set of the version in force."""
    r = requests.withColumn("presented", query_param(F.col("query_string"), "key"))
    r = (key_asof_intervals if requests.isStreaming else key_asof)(r, keys)
    k = keys.select("loaded_at", F.col("key").alias("presented"), F.lit(True).alias("_ok"))
    j = r.join(k, ["loaded_at", "presented"], "left")
    return j.withColumn("key_ok", (F.col("presented") != "") & F.col("_ok").isNotNull()).drop("_ok")


def is_discovery(path: Column) -> Column:
    """L4: `/.well-known` itself or anything below it."""
    return (path == WELL_KNOWN) | path.startswith(WELL_KNOWN + "/")


def policy(requests: DataFrame, keys: DataFrame, bucket: folds.Bucket = folds.Bucket()) -> DataFrame:
    """Non-http passes uncharged; then the rate limit (429), discovery
    (404), key (401), else passed. Rate is charged before the other checks.

    Identity, key and path checks are computed first as narrow columns and
    carried through the rate fold, so its output needs no join back."""
    r = client_identity(requests).select("id", "ts", "query_string", "scope_type", "identity", "host_header",
                                         is_discovery(F.col("path")).alias("discovery"))
    r = key_check(r, keys)
    r = r.select("id", "ts", F.unix_micros("ts").alias("ts_us"), "scope_type", "identity", "host_header", "discovery", "key_ok")
    http = folds.token_bucket(r.where(F.col("scope_type") == "http"), "identity", "ts_us", "id", bucket)
    other = r.where(F.col("scope_type") != "http").withColumns(
        {"allowed": F.lit(None).cast("boolean"), "tokens_after": F.lit(None).cast("long")})
    d = http.unionByName(other)
    status = (F.when(F.col("scope_type") != "http", F.lit(None).cast("int"))
              .when(~F.col("allowed"), 429)
              .when(F.col("discovery"), 404)
              .when(~F.col("key_ok"), 401))
    reason = (F.when(F.col("scope_type") != "http", "passed (not http)")
              .when(~F.col("allowed"), "rate limited")
              .when(F.col("discovery"), "not found")
              .when(~F.col("key_ok"), "unauthorized").otherwise("passed"))
    return d.withColumn("status", status).withColumn("reason", reason)


def host_allow(decisions: DataFrame, hosts: DataFrame) -> DataFrame:
    """Requests the gate passed must carry an allowed Host (400 else)."""
    passed = decisions.where(F.col("reason") == "passed")
    ok = hosts.select(F.col("host").alias("host_header"), F.lit(True).alias("_allowed"))
    j = passed.join(ok, "host_header", "left")
    return j.withColumn("host_ok", F.col("_allowed").isNotNull()).drop("_allowed")


def redact(c: Column, only_if_key: bool = False) -> Column:
    """`?key=`/`&key=` values replaced by REDACTED."""
    out = F.regexp_replace(c, KEY_RE, "$1REDACTED")
    return F.when(c.contains("key="), out).otherwise(c) if only_if_key else out


def redacted_log(lines: DataFrame) -> DataFrame:
    """Message (only when it holds `key=`) and every string argument."""
    return lines.select("id", redact(F.col("msg"), True).alias("msg"),
                        F.transform("args", lambda a: redact(a)).alias("args"))


def policy_report(decisions: DataFrame) -> DataFrame:
    """Requests by identity, hour and status."""
    return decisions.groupBy("identity", F.window("ts", "1 hour").start.alias("hour"), "reason").agg(
        F.count(F.lit(1)).alias("n"))
