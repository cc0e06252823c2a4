"""Public entry point: the whole conversion cascade as one DataFrame function."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemark.operators import admission as ADM
from pagemark.operators import outcomes as T
from pagemark.operators import responses as R
from pagemark.operators import snapshots as S
from pagemark.session import cut_lineage


def verdict_table(urls: DataFrame, hop_table: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One admission verdict per distinct URL that the cascade may request:
    the work list and every captured redirect target, materialized once."""
    # Read twice (rows and their distinct hosts): written once, a narrow table.
    wanted = cut_lineage(urls.select("url").unionByName(R.hop_targets(hop_table)).distinct())
    return cut_lineage(ADM.admission(wanted, resolutions).select("url", "host", "status", "reason", "message"))


def convert(urls: DataFrame, responses: DataFrame, resolutions: DataFrame,
            captures: DataFrame, render_requests: DataFrame) -> DataFrame:
    """One typed outcome per URL (T1, T2): refuse, native Markdown, static
    extraction, or the render tier's settled snapshot.

    urls:            page_id, url
    responses:       url, status, headers map, body, elapsed_ms, error (A2)
    resolutions:     host, pos, ip (name resolution as data)
    captures:        url, elapsed_ms, capture_mode, html (A3), and optionally error: why
                     rendering failed, on a capture without html
    render_requests: page_id, url, wait_until, timeout_ms, headless,
                     poll_budget_ms, poll_interval_ms, nav_ms map (F5, F6)

    Returns page_id, url, host, tier, status, markdown, message: one row per row
    of ``urls``. Work is done once per distinct URL; of several render requests
    for one URL that with the smallest page_id holds, a URL without one has the
    tool's default options. Only captures of URLs
    that the cheaper tiers leave to rendering are extracted.
    """
    # Headers and next hops, without bodies: targets and edges read them.
    hop_table = cut_lineage(R.hops(responses))
    table = verdict_table(urls, hop_table, resolutions)
    verdicts = urls.select("url").distinct().join(table, "url")
    starts = verdicts.where(F.col("status") == "admitted").select("url")
    walked = cut_lineage(R.follow(starts, responses, resolutions, table, hop_table))
    # Read by three branches: written once.
    routed = cut_lineage(R.route(walked, responses))
    queue = routed.where(F.col("route") == "render").select("url")
    names = [c for c in render_requests.columns if c != "url"]
    asked = (render_requests.join(queue, "url", "left_semi")
             .groupBy("url").agg(F.min_by(F.struct(*names), "page_id").alias("r")).select("url", "r.*"))
    # Options that nobody gave have their defaults (A1); without timings navigation counts as ready.
    requests = S.with_defaults(queue.distinct().join(asked, "url", "left"))
    queued = S.select_mode(captures.join(queue, "url", "left_semi"), requests)
    settled = S.stabilize(S.extract(S.cadence(S.without_errors(queued), "html")))
    out = T.cascade(verdicts, routed, S.navigation(requests), settled, S.render_errors(queued))
    return (urls.select("page_id", "url").join(out, "url")
            .join(table.select("url", "host"), "url"))
