"""Registered queries of J7 (snapshot stabilization, render tier)."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagemark.operators import snapshots as S
from pagemark.sources import derived


def _polls(spark, sf_dir):
    caps = S.select_mode(derived.snapshots(spark, sf_dir), derived.render_requests(spark, sf_dir))
    return S.cadence(caps)


def q_snapshot_cadence(spark, sf_dir):
    """A3, F4 (+F6): the polls that count, one per interval, in order."""
    return _polls(spark, sf_dir).select("url", F.col("poll_no").cast("long").alias("poll_no"),
                                        "elapsed_ms", "md")


def q_snapshot_stable(spark, sf_dir):
    """Settled Markdown per URL."""
    return S.stabilize(_polls(spark, sf_dir))


def q_render_eligibility(spark, sf_dir):
    """navigation outcome per URL and the capture mode used."""
    n = S.navigation(derived.render_requests(spark, sf_dir))
    return n.select("url", "wait_until", "ready_ms", "timeout_ms", "nav_status", "nav_message",
                    F.when(F.col("headless"), "headless").otherwise("headed").alias("capture_mode"))


QUERIES = {
    "snapshot_cadence": q_snapshot_cadence,
    "snapshot_stable": q_snapshot_stable,
    "render_eligibility": q_render_eligibility,
}

def snapshots_sql(body: str, flicker: str, headed: str, unasked: str = "", asked: str = " WHERE page_id % 17 <> 6 ") -> str:
    """CTEs down to ``polls``; ``md`` is what a capture holds. ``asked``: which pages have a
    render request of their own; ``unasked``: more rows of render requests."""
    return f"""
caps_base AS (
  SELECT page_id, url, poll, poll * 250 AS elapsed_ms, 'headless' AS capture_mode,
    CASE WHEN poll < page_id % 3 THEN NULL
         ELSE substring(body, 1, ceil(length(body) * least(poll + 1, page_id % 6 + 1) / (page_id % 6 + 1))::INT) END AS md
  FROM (SELECT page_id, url, {body} AS body FROM pages),
       range(0, 8) r(poll)),
captures AS (
  SELECT page_id, url, elapsed_ms, capture_mode, md FROM caps_base
  UNION ALL SELECT page_id, url, elapsed_ms + 120, capture_mode, {flicker} FROM caps_base WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, url, elapsed_ms, 'headed', md || {headed} FROM caps_base WHERE page_id % 4 = 0),
req AS (
  SELECT page_id, url,
    ['load', 'domcontentloaded', 'networkidle', 'commit'][(page_id % 4 + 1)::INT] AS wait_until,
    30000 AS timeout_ms, true AS headless, 250 * (page_id % 7 + 2) AS poll_budget_ms, 250 AS poll_interval_ms,
    (page_id * 131) % 20000 AS n FROM pages{asked}{unasked}),
moded AS (
  SELECT c.*, r.poll_budget_ms, r.poll_interval_ms FROM captures c JOIN req r
    ON c.url = r.url AND c.capture_mode = CASE WHEN r.headless THEN 'headless' ELSE 'headed' END),
polls AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY elapsed_ms) - 1 AS poll_no FROM (
    SELECT *, row_number() OVER (PARTITION BY url, elapsed_ms // poll_interval_ms ORDER BY elapsed_ms, md) AS rn
    FROM moded) WHERE rn = 1)"""


SNAPSHOTS_SQL = snapshots_sql("regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')", "'flicker ' || poll", "' (headed)'", asked="")

ORACLE = {
    "snapshot_cadence": "WITH " + SNAPSHOTS_SQL.strip() + """
SELECT url, poll_no::BIGINT AS poll_no, elapsed_ms::BIGINT AS elapsed_ms, md FROM polls""",
    "snapshot_stable": "WITH " + SNAPSHOTS_SQL.strip() + """,
marked AS (
  SELECT *, coalesce(md <> '' AND md = lag(md) OVER w, false) AS stable, elapsed_ms >= poll_budget_ms AS expired,
    lead(poll_no) OVER w IS NULL AS last
  FROM polls WINDOW w AS (PARTITION BY url ORDER BY poll_no)),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY poll_no) AS k FROM marked WHERE stable OR expired OR last)
SELECT url, (poll_no + 1)::BIGINT AS polls,
  CASE WHEN stable THEN 'stable' WHEN expired THEN 'expired' ELSE 'exhausted' END AS how, md
FROM firsts WHERE k = 1""",
    "render_eligibility": "WITH " + SNAPSHOTS_SQL.strip() + """,
nav AS (
  SELECT url, wait_until, timeout_ms,
    CASE wait_until WHEN 'commit' THEN n WHEN 'domcontentloaded' THEN 2 * n WHEN 'load' THEN 4 * n ELSE 8 * n END AS ready_ms,
    headless FROM req)
SELECT url, wait_until, ready_ms::BIGINT AS ready_ms, timeout_ms::BIGINT AS timeout_ms,
  CASE WHEN ready_ms > timeout_ms THEN 'nav_timeout' ELSE 'ready' END AS nav_status,
  CASE WHEN ready_ms > timeout_ms THEN 'navigation to ' || url || ' timed out after ' || timeout_ms || 'ms' END AS nav_message,
  CASE WHEN headless THEN 'headless' ELSE 'headed' END AS capture_mode
FROM nav""",
}
