"""Conversion cascade and outcomes.

Tiers are disjoint branches split by filters and recombined with
``unionByName``; each heavier tier only sees the rows the cheaper ones left.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: retry advice for the render tier --------------------------
RETRY_BUDGET_MS = {"empty": 10000, "nav_timeout": 15000}


def cascade(verdicts: DataFrame, routed: DataFrame, nav: DataFrame, settled: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """T1 + T2: one typed outcome per URL of ``verdicts``; every input has one row
    per URL.

    verdicts: url, status, message (top-level admission)
    routed:   url, route, tier, markdown, reason (tiers 1-2)
    nav:      url, nav_status, timeout_ms (render navigation)
    settled:  url, md (render snapshots, F1-F3; a row for every URL with captures)
    errors:   url, render_error (why a render failed; a row ends it as `failed`)
    """
    none = F.lit(None).cast("string")
    refused_text = lambda why: F.concat(F.lit("refused to fetch "), F.col("url"), F.lit(": "), why)
    refused = verdicts.where(F.col("status") != "admitted").select(
        "url", F.lit(0).alias("tier"),
        F.when(F.col("status") == "invalid_url", "invalid_url").otherwise("refused").alias("status"),
        none.alias("markdown"), refused_text(F.col("message")).alias("message"))
    # Tiers 1 and 2 and refused hops: one projection of the routed rows.
    hop = F.col("route") == "refused"
    fetched = routed.where(F.col("route") != "render").select(
        "url", F.when(hop, 0).otherwise(F.col("tier")).cast("int").alias("tier"),
        F.when(hop, "refused").otherwise("ok").alias("status"),
        F.when(~hop, F.col("markdown")).alias("markdown"),
        F.when(hop, refused_text(F.col("reason"))).alias("message"))
    render = (routed.where(F.col("route") == "render").select("url")
              .join(nav.select("url", "nav_status", "timeout_ms"), "url", "left")
              .join(settled.select("url", F.col("md").alias("rendered"), F.lit(True).alias("has_captures")), "url", "left"))
    render = (render.withColumn("render_error", F.lit(None).cast("string")) if errors is None
              else render.join(errors.select("url", "render_error"), "url", "left"))
    status = (F.when(F.col("nav_status") == "nav_timeout", "nav_timeout")
              .when(F.col("render_error").isNotNull() | F.col("has_captures").isNull(), "failed")
              .when(F.coalesce(F.col("rendered"), F.lit("")) == "", "empty")
              .otherwise("ok"))
    render = render.withColumn("status", status)
    message = (F.when(F.col("status") == "nav_timeout",
                      F.format_string("navigation to %s timed out after %dms", F.col("url"), F.col("timeout_ms")))
               .when(F.col("status") == "failed",
                     F.concat(F.lit("failed to fetch "), F.col("url"), F.lit(": "), F.coalesce("render_error", F.lit("no render captures"))))
               .when(F.col("status") == "empty",
                     F.concat(F.lit("no extractable content found at "), F.col("url"))))
    render = render.select("url", F.lit(3).alias("tier"), "status",
                           F.when(F.col("status") == "ok", F.col("rendered")).alias("markdown"),
                           message.alias("message"))
    return (refused.unionByName(fetched).unionByName(render)
            .withColumn("tier", F.col("tier").cast("long")))


def retry_list(outcomes: DataFrame) -> DataFrame:
    """T4: render failures worth a headed retry with a larger budget."""
    budget = F.when(F.col("status") == "empty", RETRY_BUDGET_MS["empty"]).otherwise(
        RETRY_BUDGET_MS["nav_timeout"])
    return outcomes.where(F.col("status").isin("empty", "nav_timeout")).select(
        "page_id", "url", "status", F.lit(False).alias("headless"), budget.cast("long").alias("poll_budget_ms"))


def outcome_rollup(outcomes: DataFrame, host_col: str = "host") -> DataFrame:
    """T5: counts by host, tier and status with subtotals (rollup)."""
    return (outcomes.rollup(host_col, "tier", "status")
            .agg(F.count(F.lit(1)).cast("long").alias("n"),
                 F.grouping_id().cast("long").alias("level")))
