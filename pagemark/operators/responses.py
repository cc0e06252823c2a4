"""Redirects and HTTP tiers.

The redirect walk is one frontier of distinct URLs through six left joins
with a narrow edge table (what a walk does at a response, next hop, verdict);
bodies join for the final responses only. Each hop's verdict is computed once
per captured response, not once per walk. Everything here is per distinct URL;
work-list rows join back many-to-one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemark.functions.urls import resolve
from pagemark.operators import admission as ADM
from pagemark.operators import markdown as M
from pagemark.session import cut_lineage

# --- fixed values of the reference -------------------------------------------
REDIRECT_CODES = (301, 302, 303, 307, 308)
MAX_REDIRECTS = 5
FAST_PATH_TIMEOUT_MS = 10000
MIN_EXTRACTED_CHARS = 200
MIN_RAW_CHARS = 5000


def header(name: str, headers: str = "headers"):
    """A header by its lower-case name, however the server wrote it."""
    return F.transform_keys(F.col(headers), lambda k, v: F.lower(k))[name]


def media_type(headers: str = "headers"):
    """Part before the first `;`, trimmed, lower-cased; '' if missing."""
    ct = F.coalesce(header("content-type", headers), F.lit(""))
    return F.lower(F.trim(F.substring_index(ct, ";", 1)))


def hops(responses: DataFrame) -> DataFrame:
    """C1 + C2 + C7 per captured response, header columns only: redirect flag
    and the resolved next hop."""
    r = responses.select(
        "url", F.col("status").alias("http_status"), "elapsed_ms", "error",
        media_type().alias("media_type"), header("location").alias("location"))
    r = r.withColumn("is_redirect", F.coalesce(
        F.col("http_status").isin(*REDIRECT_CODES) & F.col("location").isNotNull(), F.lit(False)))
    return r.withColumn("next_url", F.when(F.col("is_redirect"), resolve(F.col("url"), F.col("location")))
                        ).drop("location")


def hop_targets(hop_table: DataFrame) -> DataFrame:
    """Distinct next-hop URLs of all captured redirects (column ``url``) of ``hops``."""
    return hop_table.where(F.col("next_url").isNotNull()).select(F.col("next_url").alias("url")).distinct()


def edges(hop_table: DataFrame, resolutions: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """C4 per captured response of ``hops``: the next hop with its admission verdict.

    ``verdicts`` (url, status, message) may already hold the hop targets
    (one materialized verdict table for start URLs and hops); otherwise the
    distinct targets are vetted here and materialized once.
    """
    h = hop_table
    if verdicts is None:
        verdicts = cut_lineage(ADM.admission(hop_targets(h), resolutions).select(
            "url", "status", "message"))
    v = verdicts.select(F.col("url").alias("next_url"), F.col("status").alias("next_status"),
                        F.col("message").alias("next_message"))
    failed = F.col("http_status").isNull() | F.col("error").isNotNull() | (F.col("elapsed_ms") > FAST_PATH_TIMEOUT_MS)
    # What a walk does at this response, but for the hop limit.
    step = (F.when(F.coalesce(failed, F.lit(False)), "fetch_failed").when(~F.col("is_redirect"), "response")
            .when(F.col("next_status") == "refused", "refused")
            .when(F.col("next_status") == "invalid_url", "invalid_hop").otherwise("go"))
    # Materialized once: all six walk steps read it, and their filters would
    # otherwise be pushed into the hop derivation.
    return cut_lineage(h.join(v, "next_url", "left").select(
        F.col("url").alias("at"), step.alias("step"), F.col("http_status").alias("at_status"), "next_url", "next_message"))


def follow(starts: DataFrame, responses: DataFrame, resolutions: DataFrame,
           verdicts: DataFrame | None = None, hop_table: DataFrame | None = None) -> DataFrame:
    """Walk at most five redirects from each distinct start URL.

    One frontier passes through six left joins; a walk that has ended carries
    its outcome along. Output per start: start_url, hops, final_url, path
    (`a -> b -> c`), outcome (`response` | `refused` | `fetch_failed`),
    http_status, message. ``hop_table``: ``hops`` of the responses, if it is at hand.
    """
    e = edges(hops(responses) if hop_table is None else hop_table, resolutions, verdicts)
    walk = starts.select(F.col("url").alias("start_url")).distinct().select(
        "start_url", F.lit(0).alias("hops"), F.col("start_url").alias("final_url"), F.col("start_url").alias("path"),
        F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("int").alias("http_status"),
        F.lit(None).cast("string").alias("message"))
    for hop in range(MAX_REDIRECTS + 1):
        last = hop == MAX_REDIRECTS
        j = walk.join(e, (F.col("final_url") == F.col("at")) & F.col("outcome").isNull(), "left")
        step = F.when(F.col("outcome").isNull(), F.coalesce("step", F.lit("fetch_failed")))
        ends = (F.when(step.isin("fetch_failed", "response"), step)
                .when(F.lit(last) & step.isNotNull(), "refused")
                .when(step == "refused", "refused").when(step == "invalid_hop", "fetch_failed"))
        told = F.concat(F.lit("too many redirects following "), F.col("start_url")) if last else F.col("next_message")
        go = step == "go"
        walk = j.withColumn("ends", ends).withColumn("go", F.coalesce(go & F.lit(not last), F.lit(False))).select(
            "start_url", (F.col("hops") + F.col("go").cast("int")).alias("hops"),
            F.when(F.col("go"), F.col("next_url")).otherwise(F.col("final_url")).alias("final_url"),
            F.when(F.col("go"), F.concat_ws(" -> ", "path", "next_url")).otherwise(F.col("path")).alias("path"),
            F.coalesce("outcome", "ends").alias("outcome"),
            F.when(F.col("ends") == "response", F.col("at_status")).otherwise(F.col("http_status")).alias("http_status"),
            F.when(F.col("ends") == "refused", told).otherwise(F.col("message")).alias("message"))
    return walk


def route(walked: DataFrame, responses: DataFrame) -> DataFrame:
    """Per walked URL the tier that answers it.

    Output: url, route (`refused`, `native`, `extract`, `render`), tier (1, 2
    or null), markdown, reason, plus the shell features of extracted pages.
    """
    w = walked.withColumnRenamed("start_url", "url")
    final = w.join(responses.select(F.col("url").alias("final_url"), "body",
                                    media_type().alias("media_type")), "final_url", "left")
    base = final
    ok2xx = (F.col("outcome") == "response") & F.col("http_status").between(200, 299)
    native = ok2xx & (F.col("media_type") == "text/markdown")
    base = base.withColumn("kind", F.when(F.col("outcome") == "refused", "refused")
                           .when(native, "native").when(ok2xx, "extract").otherwise("render"))
    # Tier 2: extraction of 2xx non-Markdown bodies; links resolve against
    # the requested URL (note 7), not the final one.
    cand = base.where(F.col("kind") == "extract").select(F.col("url").alias("page_id"), "url", F.col("body").alias("html"))
    md = M.page_markdown(cut_lineage(cand)).select("url", F.col("markdown").alias("extracted"))
    # Beyond extraction only a native body is carried on.
    base = base.select("url", "outcome", "http_status", "message", "kind", F.length("body").alias("body_chars"),
                       F.when(F.col("kind") == "native", F.col("body")).alias("native_body"))
    b = base.join(md, "url", "left")
    md_len = F.length("extracted")
    b = b.withColumns({
        "md_chars": md_len.cast("long"),
        "raw_chars": F.col("body_chars").cast("long"),
        "js_stub": F.coalesce((md_len < MIN_EXTRACTED_CHARS) & F.lower("extracted").contains("javascript"),
                              F.lit(False)),
        "sparse": F.coalesce((md_len < MIN_EXTRACTED_CHARS) & (F.col("body_chars") > MIN_RAW_CHARS),
                             F.lit(False))})
    accepted = (F.col("kind") == "extract") & F.coalesce(F.col("extracted") != "", F.lit(False)) \
        & ~F.col("js_stub") & ~F.col("sparse")
    b = b.withColumn("accepted", accepted)
    routed = (F.when(F.col("kind") == "refused", "refused").when(F.col("kind") == "native", "native")
              .when(F.col("accepted"), "extract").otherwise("render"))
    reason = (F.when(F.col("kind") == "refused", F.col("message"))
              .when(F.col("outcome") == "fetch_failed", "fetch failed")
              .when((F.col("kind") == "render"), F.format_string("status %d", F.col("http_status")))
              .when(F.col("kind") == "extract",
                    F.when(F.coalesce(F.col("extracted"), F.lit("")) == "", "no content")
                    .when(F.col("js_stub"), "javascript stub").when(F.col("sparse"), "sparse extraction")))
    return b.select(
        "url", routed.alias("route"),
        F.when(routed == "native", 1).when(routed == "extract", 2).cast("long").alias("tier"),
        F.when(routed == "native", F.col("native_body")).when(routed == "extract", F.col("extracted")).alias("markdown"),
        reason.alias("reason"), "kind", "md_chars", "raw_chars", "js_stub", "sparse", "accepted")
