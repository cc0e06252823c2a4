"""Registered streaming queries (W1, W2, W4): each replays derived data as a
file stream through the stateful operator and returns the sink read back,
so it is checked against the same DuckDB twin as its batch form."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemark.operators import policy as P
from pagemark.plans import policy_job as PJ
from pagemark.session import tables_dir
from pagemark.sources import derived, files
from pagemark.streaming import stateful as W
from pagemark.streaming.replay import run_stream


def q_stream_token_bucket(spark, sf_dir):
    """Token bucket as keyed streaming state."""
    src = P.client_identity(derived.requests(spark, sf_dir)).select("id", "ts", "scope_type", "identity")
    out = run_stream(spark, "token_bucket", src, "ts",
                     lambda s: W.token_bucket_stream(s, PJ.EVENTS_BUCKET))
    return out.select("id", "identity", "allowed", "tokens_after")


def q_stream_lookup_reuse(spark, sf_dir):
    """Decision reuse as keyed streaming state with TTL timeouts."""
    src = derived.lookups(spark, sf_dir)
    out = run_stream(spark, "lookup_reuse", src, "ts",
                     lambda s: W.decision_reuse_stream(s, PJ.EVENTS_TTL_US))
    return out.select("id", "host", "port", "hit")


def q_stream_static_gate(spark, sf_dir):
    """The request stream joined with the static key versions."""
    src = derived.requests(spark, sf_dir)
    keys = P.key_set(derived.key_lines(spark))
    out = run_stream(spark, "static_gate", src, "ts", lambda s: W.static_gate_stream(s, keys))
    return out.select("id", "presented", "key_ok")


def q_stream_snapshots(spark, sf_dir):
    """Snapshot stabilization as keyed streaming state; each URL's captures
    end with an end-of-captures event."""
    from pagemark.operators import snapshots as S
    caps = S.select_mode(derived.snapshots(spark, sf_dir), derived.render_requests(spark, sf_dir))
    base = F.lit(1704067200000)  # polls on one clock: 2024-01-01 + elapsed
    caps = caps.select("url", "elapsed_ms", "md", "poll_budget_ms", "poll_interval_ms",
                       F.lit(False).alias("is_end"))
    ends = caps.groupBy("url", "poll_budget_ms", "poll_interval_ms").agg(
        (F.max("elapsed_ms") + 1).alias("elapsed_ms")).select(
        "url", "elapsed_ms", F.lit(None).cast("string").alias("md"), "poll_budget_ms", "poll_interval_ms",
        F.lit(True).alias("is_end"))
    src = caps.unionByName(ends).withColumn("ts", F.timestamp_millis(base + F.col("elapsed_ms")))
    out = run_stream(spark, "snapshots", src, "ts", lambda s: W.snapshot_stream(s))
    return out.select("url", "polls", "how", "md")


def q_stream_admission(spark, sf_dir):
    """The work list as a stream against address classes and host verdicts."""
    res = derived.resolutions(spark, sf_dir)
    src = derived.url_list(spark, sf_dir).select("page_id", "url", F.timestamp_seconds(F.col("page_id") % 100_000_000).alias("ts"))
    out = run_stream(spark, "admission", src, "ts", lambda s: W.admission_stream(s, res).select(
        "page_id", "url", "scheme", "host", "port", "status", "reason", "message"))
    return out


def q_stream_first_lookups(spark, sf_dir):
    """W2, close variant: which host and port is looked up anew at which time, with a
    horizon of eight days on lookups at times eight days apart. Which of equal
    lookups is kept is Spark's choice, so the id is left out."""
    out = run_stream(spark, "first_lookups", derived.sparse_lookups(spark, sf_dir), "ts", lambda s: W.first_lookups_stream(s, "8 days"))
    return out.select("host", F.col("port").cast("long").alias("port"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def q_stream_capture_scan(spark, sf_dir):
    """A3: render captures written as JSON lines in two deliveries and read as a stream
    that takes a few files a micro-batch and runs on from its checkpoint."""
    base = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    caps = derived.snapshot_pages(spark, sf_dir).withColumn("ts", F.timestamp_millis(F.lit(1704067200000) + F.col("elapsed_ms")))
    for early in (True, False):
        files.write_captured(caps.where((F.col("elapsed_ms") < 1000) == F.lit(early)).drop("page_id"), f"{base}/in")
        stream = files.read_captures(spark, f"{base}/in", stream=True, max_files=8)
        (stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/chk").option("path", f"{base}/out")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{base}/out").select(
        "url", "elapsed_ms", "capture_mode", F.unix_millis("ts").alias("ts_ms"), F.md5("html").alias("html_md5"), "error")


QUERIES = {
    "stream_capture_scan": q_stream_capture_scan,
    "stream_first_lookups": q_stream_first_lookups,
    "stream_admission": q_stream_admission,
    "stream_snapshots": q_stream_snapshots,
    "stream_token_bucket": q_stream_token_bucket,
    "stream_lookup_reuse": q_stream_lookup_reuse,
    "stream_static_gate": q_stream_static_gate,
}

from pagemark.plans.admission_job import ORACLE as _ADMISSION  # noqa: E402
from pagemark.plans.snapshots_job import ORACLE as _SNAP_ORACLE, snapshots_sql  # noqa: E402

# A lookup at slot e is forgotten once the watermark, the latest slot seen less one, has
# passed e + 1: at e + 2, when that slot's rows have been judged. Slot e + 3 counts again.
FIRST_LOOKUPS_SQL = """
WITH l AS (
  SELECT DISTINCT 'h' || (event_id * 7919 % 3571) || '.example' AS host, CASE WHEN event_type IN ('purchase', 'signup') THEN 443 ELSE 80 END AS port,
    least((epoch_us(ts) // 1000000 - 1704067200) // 691200, 3) AS slot FROM events),
p AS (SELECT host, port, bool_or(slot = 0) AS s0, bool_or(slot = 1) AS s1, bool_or(slot = 2) AS s2, bool_or(slot = 3) AS s3 FROM l GROUP BY ALL),
f AS (SELECT host, port, unnest([CASE WHEN s0 THEN 0 END, CASE WHEN s1 AND NOT s0 THEN 1 END, CASE WHEN s2 AND NOT s0 AND NOT s1 THEN 2 END,
    CASE WHEN s3 AND NOT (s1 AND NOT s0) AND NOT (s2 AND NOT s0 AND NOT s1) THEN 3 END]) AS slot FROM p)
SELECT host, port::BIGINT AS port, strftime(TIMESTAMP '2024-01-01' + slot * INTERVAL 8 DAY, '%Y-%m-%d') AS day FROM f WHERE slot IS NOT NULL"""

CAPTURES_SQL = "WITH " + snapshots_sql("coalesce(html, '')", "'<p>flicker ' || poll || '</p>'", "'<p>headed</p>'").strip() + """
SELECT url, elapsed_ms::BIGINT AS elapsed_ms, capture_mode, 1704067200000 + elapsed_ms AS ts_ms, md5(md) AS html_md5, NULL::VARCHAR AS error FROM captures
UNION ALL SELECT url, 500, 'headless', 1704067200500, NULL, 'page ' || page_id || ' closed' FROM pages WHERE page_id % 13 = 4"""

ORACLE = {
    "stream_capture_scan": CAPTURES_SQL,
    "stream_first_lookups": FIRST_LOOKUPS_SQL,
    "stream_admission": _ADMISSION["url_admission"],
    "stream_snapshots": _SNAP_ORACLE["snapshot_stable"],
    "stream_token_bucket": PJ.ORACLE["token_bucket"],
    "stream_lookup_reuse": PJ.ORACLE["lookup_reuse"],
    "stream_static_gate": PJ.ORACLE["key_check"],
}
