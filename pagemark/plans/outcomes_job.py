"""Registered queries of J8 (conversion cascade and outcomes)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemark.api import convert
from pagemark.operators import outcomes as T
from pagemark.plans import routing_job as RJ
from pagemark.plans import oracle_blocks as O
from pagemark.plans.snapshots_job import snapshots_sql
from pagemark.session import tables_dir
from pagemark.sources import derived
from pagemark.sources.files import write_outcomes


def outcomes(spark, sf_dir):
    return convert(derived.url_list(spark, sf_dir).select("page_id", "url"),
                   derived.responses(spark, sf_dir), derived.resolutions(spark, sf_dir),
                   derived.snapshot_pages(spark, sf_dir), derived.some_render_requests(spark, sf_dir))


def q_tier_cascade(spark, sf_dir):
    """The tier that settled each URL (0 admission, 1-3 fetch tiers)."""
    o = outcomes(spark, sf_dir)
    return o.select("url", "tier", F.when(F.col("tier") == 0, "refused").when(F.col("tier") == 1, "native")
                    .when(F.col("tier") == 2, "extract").otherwise("render").alias("branch"))


def q_outcomes(spark, sf_dir):
    """One typed outcome per URL (the sink's rows)."""
    return outcomes(spark, sf_dir).select("url", "status", "tier", "markdown", "message")


def q_outcome_sink(spark, sf_dir):
    """The outcome sink (one folder per status) written and read back."""
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    write_outcomes(outcomes(spark, sf_dir), path)
    return spark.read.parquet(path).select("page_id", "url", "host", "status", F.col("tier").cast("long").alias("tier"), "message")


def q_retry_list(spark, sf_dir):
    """T4: headed retries for empty results and navigation timeouts."""
    return T.retry_list(outcomes(spark, sf_dir)).select("url", "status", "headless", "poll_budget_ms")


def q_outcome_rollup(spark, sf_dir):
    """T5: outcome counts by host, tier, status with subtotals."""
    return T.outcome_rollup(outcomes(spark, sf_dir))


QUERIES = {
    "tier_cascade": q_tier_cascade,
    "outcomes": q_outcomes,
    "outcome_sink": q_outcome_sink,
    "retry_list": q_retry_list,
    "outcome_rollup": q_outcome_rollup,
}

OUTCOMES_SQL = RJ.CHAIN + ",\n" + snapshots_sql("coalesce(html, '')", "'<p>flicker ' || poll || '</p>'", "'<p>headed</p>'",
    "UNION ALL SELECT page_id, url, 'domcontentloaded', 60000, true, 5000, 250, NULL FROM pages WHERE page_id % 17 = 6").strip() + f""",
queued AS (SELECT p.* FROM polls p JOIN (SELECT url FROM routed WHERE route = 'render') USING (url)),
states AS (SELECT row_number() OVER () AS sid, url, md AS html FROM (SELECT DISTINCT url, md FROM queued WHERE md IS NOT NULL)),
state_md AS (WITH {O.chain('SELECT sid AS page_id, url, html FROM states', 'none').strip()}
  SELECT page_id AS sid, markdown FROM page_markdown),
extracted_polls AS (
  SELECT q.* EXCLUDE (md), m.markdown AS md FROM queued q
  LEFT JOIN states s ON s.url = q.url AND s.html = q.md LEFT JOIN state_md m ON m.sid = s.sid),
""" + """
verd AS (SELECT min(page_id) AS page_id, url, any_value(status) AS status, any_value(message) AS message FROM u_adm GROUP BY url),
navs AS (
  SELECT url, timeout_ms,
    CASE wait_until WHEN 'commit' THEN n WHEN 'domcontentloaded' THEN 2 * n WHEN 'load' THEN 4 * n ELSE 8 * n END
      > timeout_ms AS late FROM req),
marked AS (
  SELECT *, coalesce(md <> '' AND md = lag(md) OVER w, false) AS stable, elapsed_ms >= poll_budget_ms AS expired,
    lead(poll_no) OVER w IS NULL AS last
  FROM extracted_polls WINDOW w AS (PARTITION BY url ORDER BY poll_no)),
settled AS (
  SELECT url, md FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY poll_no) AS k FROM marked WHERE stable OR expired OR last)
  WHERE k = 1),
capd AS (SELECT DISTINCT url FROM moded),
rend AS (
  SELECT r.page_id, r.url, n.timeout_ms, s.md AS rendered, e.error,
    CASE WHEN n.late THEN 'nav_timeout' WHEN e.url IS NOT NULL OR c.url IS NULL THEN 'failed'
         WHEN coalesce(s.md, '') = '' THEN 'empty' ELSE 'ok' END AS status
  FROM routed r LEFT JOIN navs n ON n.url = r.url LEFT JOIN capd c ON c.url = r.url
  LEFT JOIN settled s ON s.url = r.url
  LEFT JOIN (SELECT url, 'page ' || page_id || ' closed' AS error FROM pages WHERE page_id % 13 = 4) e ON e.url = r.url
  WHERE r.route = 'render'),
outc AS (
  SELECT page_id, url, 0 AS tier, CASE WHEN status = 'invalid_url' THEN 'invalid_url' ELSE 'refused' END AS status,
    NULL AS markdown, 'refused to fetch ' || url || ': ' || message AS message
  FROM verd WHERE status <> 'admitted'
  UNION ALL
  SELECT page_id, url, 0, 'refused', NULL, 'refused to fetch ' || url || ': ' || message FROM routed WHERE route = 'refused'
  UNION ALL
  SELECT page_id, url, CASE route WHEN 'native' THEN 1 ELSE 2 END, 'ok',
    CASE route WHEN 'native' THEN body ELSE extracted END, NULL
  FROM routed WHERE route IN ('native', 'extract')
  UNION ALL
  SELECT page_id, url, 3, status, CASE WHEN status = 'ok' THEN rendered END,
    CASE status WHEN 'nav_timeout' THEN 'navigation to ' || url || ' timed out after ' || timeout_ms || 'ms'
                WHEN 'failed' THEN 'failed to fetch ' || url || ': ' || coalesce(error, 'no render captures')
                WHEN 'empty' THEN 'no extractable content found at ' || url END
  FROM rend),
outh AS (SELECT o.* EXCLUDE (page_id), v.page_id, v.host FROM u_adm v JOIN outc o ON v.url = o.url)"""

ORACLE = {
    "tier_cascade": OUTCOMES_SQL + """
SELECT url, tier::BIGINT AS tier,
  CASE tier WHEN 0 THEN 'refused' WHEN 1 THEN 'native' WHEN 2 THEN 'extract' ELSE 'render' END AS branch FROM outh""",
    "outcomes": OUTCOMES_SQL + """
SELECT url, status, tier::BIGINT AS tier, markdown, message FROM outh""",
    "outcome_sink": OUTCOMES_SQL + """
SELECT page_id, url, host, status, tier::BIGINT AS tier, message FROM outh""",
    "retry_list": OUTCOMES_SQL + """
SELECT url, status, false AS headless, CASE WHEN status = 'empty' THEN 10000 ELSE 15000 END::BIGINT AS poll_budget_ms
FROM outh WHERE status IN ('empty', 'nav_timeout')""",
    "outcome_rollup": OUTCOMES_SQL + """
SELECT host, tier::BIGINT AS tier, status, count(*)::BIGINT AS n,
  (grouping(host) * 4 + grouping(tier) * 2 + grouping(status))::BIGINT AS level
FROM outh GROUP BY ROLLUP (host, tier, status)""",
}
