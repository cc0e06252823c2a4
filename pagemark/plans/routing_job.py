"""Registered queries of J3 (redirect resolution) and J4 (response routing)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemark.api import verdict_table
from pagemark.operators import responses as R
from pagemark.plans import oracle_admission as OA
from pagemark.plans import oracle_blocks as O
from pagemark.session import cut_lineage, tables_dir
from pagemark.sources import derived, files


def verdicts(spark, sf_dir):
    """Verdict table for work-list URLs and redirect targets (materialized
    once) and the work list with its verdicts."""
    urls = derived.url_list(spark, sf_dir).select("page_id", "url")
    hop_table = cut_lineage(R.hops(derived.responses(spark, sf_dir)))
    table = verdict_table(urls, hop_table, derived.resolutions(spark, sf_dir))
    return table, hop_table, urls.join(table, "url")


def walk(spark, sf_dir):
    table, hop_table, v = verdicts(spark, sf_dir)
    starts = v.where(F.col("status") == "admitted").select("page_id", "url")
    return starts, R.follow(starts, derived.responses(spark, sf_dir), derived.resolutions(spark, sf_dir), table, hop_table)


def routed(spark, sf_dir):
    """Work-list rows that were admitted, and the tier of each distinct URL."""
    starts, w = walk(spark, sf_dir)
    return starts, R.route(cut_lineage(w), derived.responses(spark, sf_dir))


def q_redirect_chain(spark, sf_dir):
    """Final response, hop list or refusal per admitted URL."""
    _, w = walk(spark, sf_dir)
    return w.select(F.col("start_url").alias("url"), F.col("hops").cast("long").alias("hops"),
                    "final_url", "path", "outcome", F.col("http_status").cast("long").alias("http_status"),
                    "message")


def q_response_scan(spark, sf_dir):
    """A2: captured responses written as JSON lines with header pairs and read back."""
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    files.write_captured(derived.responses(spark, sf_dir).drop("page_id"), path)
    r = files.read_responses(spark, path)
    return r.select("url", F.col("status").cast("long").alias("status"), F.col("headers")["content-type"].alias("content_type"),
                    F.col("headers")["location"].alias("location"), F.md5("body").alias("body_md5"), "elapsed_ms", "error")


def q_response_routing(spark, sf_dir):
    """Which tier answers each admitted URL."""
    _, r = routed(spark, sf_dir)
    return r.select("url", "route", "tier", "reason")


def q_shell_pages(spark, sf_dir):
    """Shell tests on the static extractions."""
    _, r = routed(spark, sf_dir)
    return r.where(F.col("kind") == "extract").select(
        "url", "md_chars", "raw_chars", "js_stub", "sparse", "accepted")


def q_render_queue(spark, sf_dir):
    """Admitted URLs with neither a tier-1/2 result nor a refusal."""
    starts, r = routed(spark, sf_dir)
    return starts.join(r.where(F.col("route") == "render").select("url"), "url").select("page_id", "url")


QUERIES = {
    "response_scan": q_response_scan,
    "redirect_chain": q_redirect_chain,
    "response_routing": q_response_routing,
    "shell_pages": q_shell_pages,
    "render_queue": q_render_queue,
}

_pad = "repeat(" + O.q(derived.SHELL_PAD) + ", 200)"
RESPONSES_SQL = f"""
rp AS (SELECT page_id, url, html FROM pages),
rj AS (
  SELECT p.page_id, p.url, p.html, t.url AS t_url FROM rp p LEFT JOIN rp t
  ON t.page_id = CASE WHEN p.page_id % 50 = 49 THEN p.page_id - 2 ELSE p.page_id + 1 END AND p.page_id % 9 <> 8),
rk AS (SELECT *, t_url IS NOT NULL AND page_id % 41 <> 0 AS redirects, page_id % 43 = 0 AS err,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) AS origin FROM rj),
resp AS (
  SELECT page_id, url,
    CASE WHEN err THEN NULL WHEN redirects THEN [301, 302, 303, 307, 308][(page_id % 5 + 1)::INT]
         WHEN page_id % 41 = 0 AND t_url IS NOT NULL THEN 302
         WHEN page_id % 20 = 0 THEN 404 WHEN page_id % 20 = 1 THEN 500 ELSE 200 END AS status,
    CASE WHEN err THEN NULL WHEN NOT redirects AND page_id % 7 = 0 THEN 'text/markdown; charset=utf-8'
         ELSE 'text/html' END AS ctype,
    CASE WHEN err OR NOT redirects THEN NULL
         WHEN page_id % 3 = 0 THEN t_url
         WHEN page_id % 3 = 1 THEN substring(t_url, instr(t_url, ':') + 1)
         ELSE '/moved/' || page_id END AS location,
    CASE WHEN err OR redirects THEN ''
         WHEN page_id % 7 = 0 THEN CASE WHEN page_id % 14 = 0 THEN ''
              ELSE '# Page ' || page_id || chr(10) || chr(10) || 'Served as Markdown.' END
         WHEN page_id % 22 = 0 THEN {_pad} || {O.q(derived.SHELL_STUB)}
         WHEN page_id % 11 = 0 THEN {O.q(derived.SHELL_STUB)}
         ELSE html END AS body,
    (page_id * 37) % 11000 AS elapsed_ms,
    CASE WHEN err THEN 'connect error' END AS error
  FROM rk
  UNION ALL
  SELECT page_id, origin || '/moved/' || page_id, 308, 'text/html', t_url, '', (page_id * 37 + 1) % 11000, NULL
  FROM rk WHERE redirects AND page_id % 3 = 2),
e0 AS (
  SELECT url, status AS http_status, elapsed_ms, error,
    lower(trim(split_part(coalesce(ctype, ''), ';', 1))) AS media_type,
    coalesce(status IN (301, 302, 303, 307, 308) AND location IS NOT NULL, false) AS is_redirect,
    location FROM resp),
e1 AS (SELECT *, CASE WHEN is_redirect THEN {O.resolve_sql('url', 'location')} END AS next_url FROM e0)"""


def _chain_sql() -> str:
    return f"""WITH RECURSIVE res AS ({OA.resolutions_sql()}),
src0 AS ({OA.URL_LIST}),
{OA.admission_sql('src0', 'url', 'url', p='u_').strip()},
{RESPONSES_SQL.strip()},
{OA.admission_sql('e1', 'next_url', 'url', p='e_').strip()},
edges AS (SELECT url, http_status, elapsed_ms, error, media_type, is_redirect, next_url,
            status AS next_status, message AS next_message FROM e_adm),
starts AS (SELECT min(page_id) AS page_id, url FROM u_adm WHERE status = 'admitted' GROUP BY url),
walk AS (
  SELECT url AS start_url, url AS cur, 0 AS hop, url AS path FROM starts
  UNION ALL
  SELECT w.start_url, e.next_url, w.hop + 1, w.path || ' -> ' || e.next_url
  FROM walk w JOIN edges e ON e.url = w.cur
  WHERE w.hop < 5 AND e.http_status IS NOT NULL AND e.error IS NULL AND e.elapsed_ms <= 10000
    AND e.is_redirect AND e.next_status = 'admitted'),
lastw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start_url ORDER BY hop DESC) AS k FROM walk) WHERE k = 1),
walked AS (
  SELECT w.start_url, w.hop AS hops, w.cur AS final_url, w.path,
    CASE WHEN e.http_status IS NULL OR e.error IS NOT NULL OR e.elapsed_ms > 10000 THEN 'fetch_failed'
         WHEN NOT e.is_redirect THEN 'response'
         WHEN w.hop = 5 THEN 'refused'
         WHEN e.next_status = 'refused' THEN 'refused'
         ELSE 'fetch_failed' END AS outcome,
    e.http_status, e.next_status, e.next_message
  FROM lastw w LEFT JOIN edges e ON e.url = w.cur),
walked2 AS (
  SELECT start_url, hops, final_url, path, outcome,
    CASE WHEN outcome = 'response' THEN http_status END AS http_status,
    CASE WHEN outcome <> 'refused' THEN NULL WHEN hops = 5 THEN 'too many redirects following ' || start_url
         ELSE next_message END AS message
  FROM walked),
finals AS (
  SELECT s.page_id, s.url, w.*, r.body, lower(trim(split_part(coalesce(r.ctype, ''), ';', 1))) AS fmedia,
    CASE WHEN w.outcome = 'refused' THEN 'refused'
         WHEN w.outcome = 'response' AND w.http_status BETWEEN 200 AND 299
              AND lower(trim(split_part(coalesce(r.ctype, ''), ';', 1))) = 'text/markdown' THEN 'native'
         WHEN w.outcome = 'response' AND w.http_status BETWEEN 200 AND 299 THEN 'extract'
         ELSE 'render' END AS kind
  FROM starts s JOIN walked2 w ON w.start_url = s.url LEFT JOIN resp r ON r.url = w.final_url),
{O.chain("SELECT page_id, url, body AS html FROM finals WHERE kind = 'extract'").strip()},
shell AS (
  SELECT f.*, m.markdown AS extracted, length(m.markdown)::BIGINT AS md_chars, length(f.body)::BIGINT AS raw_chars,
    coalesce(length(m.markdown) < 200 AND contains(lower(m.markdown), 'javascript'), false) AS js_stub,
    coalesce(length(m.markdown) < 200 AND length(f.body) > 5000, false) AS sparse
  FROM finals f LEFT JOIN page_markdown m ON m.page_id = f.page_id),
routed AS (
  SELECT *, CASE WHEN kind = 'refused' THEN 'refused' WHEN kind = 'native' THEN 'native'
                 WHEN accepted THEN 'extract' ELSE 'render' END AS route
  FROM (SELECT *, kind = 'extract' AND coalesce(extracted <> '', false) AND NOT js_stub AND NOT sparse AS accepted
        FROM shell))"""


CHAIN = _chain_sql()
ORACLE = {
    "response_scan": "WITH " + RESPONSES_SQL.strip() + """
SELECT url, status::BIGINT AS status, ctype AS content_type, location, md5(body) AS body_md5, elapsed_ms::BIGINT AS elapsed_ms, error FROM resp""",
    "redirect_chain": CHAIN + """
SELECT start_url AS url, hops::BIGINT AS hops, final_url, path, outcome, http_status::BIGINT AS http_status, message
FROM walked2""",
    "response_routing": CHAIN + """
SELECT url, route, CASE route WHEN 'native' THEN 1 WHEN 'extract' THEN 2 END::BIGINT AS tier,
  CASE WHEN kind = 'refused' THEN message
       WHEN outcome = 'fetch_failed' THEN 'fetch failed'
       WHEN kind = 'render' THEN 'status ' || http_status
       WHEN kind = 'extract' THEN CASE WHEN coalesce(extracted, '') = '' THEN 'no content'
            WHEN js_stub THEN 'javascript stub' WHEN sparse THEN 'sparse extraction' END END AS reason
FROM routed""",
    "shell_pages": CHAIN + """
SELECT url, md_chars, raw_chars, js_stub, sparse, accepted FROM routed WHERE kind = 'extract'""",
    "render_queue": CHAIN + """
SELECT page_id, url FROM u_adm WHERE status = 'admitted' AND url IN (SELECT url FROM routed WHERE route = 'render')""",
}
