"""DuckDB twins for admission (J1, J2): URL parts, literals, class table as a
range join, resolution table, verdicts."""
from __future__ import annotations

from pagemark.functions import addresses as A
from pagemark.plans import oracle_blocks as O
from pagemark.plans.oracle_blocks import clean_sql, host_sql, hostinfo_sql, q, resolve_sql, scheme_sql, trimmed_sql
from pagemark.sources.derived import REFERENCES

QUAD = "^(0|[1-9][0-9]{0,2})\\.(0|[1-9][0-9]{0,2})\\.(0|[1-9][0-9]{0,2})\\.(0|[1-9][0-9]{0,2})$"


def quad_sql(v: str) -> str:
    return (f"concat_ws('.', (({v}) // 16777216) % 256, (({v}) // 65536) % 256,"
            f" (({v}) // 256) % 256, ({v}) % 256)")


def v4_sql(s: str) -> str:
    parts = [f"try_cast(nullif(regexp_extract({s}, {q(QUAD)}, {i}), '') AS BIGINT)" for i in range(1, 5)]
    ok = " AND ".join(f"{p} <= 255" for p in parts)
    return (f"(CASE WHEN regexp_matches({s}, {q(QUAD)}) AND {ok} THEN "
            f"{parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]} END)")


def hex8_sql(v: str) -> str:
    return f"lpad(lower(to_hex({v})), 8, '0')"


def v6_sql(s: str) -> str:
    t = f"split_part({s}, '%', 1)"
    has_v4 = f"regexp_matches({t}, ':[0-9]*\\.[0-9.]*$')"
    v4 = v4_sql(f"regexp_extract({t}, ':([0-9.]+)$', 1)")
    body = (f"(CASE WHEN {has_v4} THEN regexp_replace({t}, '[0-9.]+$', '') || "
            f"substring({hex8_sql(v4)}, 1, 4) || ':' || substring({hex8_sql(v4)}, 5, 4) ELSE {t} END)")
    return f"""(SELECT CASE WHEN contains(t, ':') AND len(halves) <= 2
        AND CASE WHEN len(halves) = 2 THEN n <= 7 ELSE n = 8 END
        AND list_bool_and(list_transform(allg, lambda g: regexp_full_match(g, '[0-9a-fA-F]{{1,4}}')))
        AND (NOT has_v4 OR v4 IS NOT NULL)
      THEN array_to_string(list_transform(allg, lambda g: lpad(lower(g), 4, '0')), '') END
    FROM (SELECT *, list_concat(lft, CASE WHEN len(halves) = 2 THEN list_transform(range(8 - n), lambda x: '0000')
                                        ELSE [] END, rgt) AS allg
      FROM (SELECT *, len(lft) + len(rgt) AS n
        FROM (SELECT *,
            CASE WHEN halves[1] = '' THEN []::VARCHAR[] ELSE string_split(halves[1], ':') END AS lft,
            CASE WHEN len(halves) = 2 AND halves[2] <> '' THEN string_split(halves[2], ':') ELSE []::VARCHAR[] END AS rgt
          FROM (SELECT {t} AS t, {has_v4} AS has_v4, {v4} AS v4, string_split({body}, '::') AS halves)))))"""


def int_sql(h: str):
    """(v4, hex32) of an all-digit or 0x host, via UHUGEINT."""
    hx = f"coalesce(nullif(ltrim(substring({h}, 3), '0'), ''), '0')"
    dec = f"try_cast({h} AS UHUGEINT)"
    v4 = (f"(CASE WHEN regexp_full_match({h}, '0x[0-9a-f]+') AND length({hx}) <= 8 THEN ('0x' || {hx})::BIGINT"
          f" WHEN regexp_full_match({h}, '[0-9]+') AND {dec} <= {A.MAX_V4} THEN {dec}::BIGINT END)")
    v6 = (f"(CASE WHEN regexp_full_match({h}, '0x[0-9a-f]+') AND length({hx}) > 8 AND length({hx}) <= 32"
          f" THEN lpad({hx}, 32, '0')"
          f" WHEN regexp_full_match({h}, '[0-9]+') AND {dec} > {A.MAX_V4}"
          f" THEN lpad(lower(to_hex({dec})), 32, '0') END)")
    return v4, v6


def class_table_sql() -> str:
    rows = []
    for ver, prio, name, lo, hi, exc in A.class_rows():
        if ver == 4:
            rows.append(f"({ver}, {prio}, {q(name)}, {lo}, {hi}, NULL, NULL, {str(exc).lower()})")
        else:
            rows.append(f"({ver}, {prio}, {q(name)}, NULL, NULL, {q(lo)}, {q(hi)}, {str(exc).lower()})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) +
            ") t(ver, prio, cls, lo4, hi4, lo6, hi6, is_exc)")


def classify_sql(rel: str, key: str) -> str:
    """Class per ``key`` of a relation with columns (key, v4, h6): embedded
    IPv4 unwrapped, then a range join to the class table, exceptions
    removing `private`, first class by priority."""
    emb = ("CASE WHEN starts_with(h6, '00000000000000000000ffff') THEN ('0x' || substring(h6, 25, 8))::BIGINT"
           " WHEN starts_with(h6, '2002') THEN ('0x' || substring(h6, 5, 8))::BIGINT"
           f" WHEN starts_with(h6, '20010000') THEN {A.MAX_V4} - ('0x' || substring(h6, 25, 8))::BIGINT END")
    return f"""(SELECT {key}, arg_min(cls, prio) FILTER (WHERE cls IS NOT NULL) AS cls FROM (
  SELECT a.{key}, r.cls, r.prio, bool_or(NOT r.is_exc) AS hit, bool_or(r.is_exc) AS exc
  FROM (SELECT {key}, coalesce(v4, {emb}) AS k4, CASE WHEN coalesce(v4, {emb}) IS NULL THEN h6 END AS k6
        FROM {rel}) a
  LEFT JOIN ({class_table_sql()}) r
    ON (a.k4 IS NOT NULL AND r.ver = 4 AND a.k4 BETWEEN r.lo4 AND r.hi4)
    OR (a.k6 IS NOT NULL AND r.ver = 6 AND a.k6 BETWEEN r.lo6 AND r.hi6)
  GROUP BY a.{key}, r.cls, r.prio)
WHERE cls IS NULL OR (hit AND NOT (cls = 'private' AND exc))
GROUP BY {key})"""


def literal_cols(h: str) -> str:
    i4, i6 = int_sql(h)
    q4, q6 = v4_sql(h), v6_sql(h)
    return (f"CASE WHEN {q4} IS NOT NULL OR {q6} IS NOT NULL THEN {q4} ELSE {i4} END AS v4, "
            f"CASE WHEN {q4} IS NOT NULL OR {q6} IS NOT NULL THEN {q6} ELSE {i6} END AS h6")


URL_LIST = """
WITH listed AS (SELECT page_id,
  CASE WHEN page_id % 10 = 5 THEN
    CASE (page_id // 10) % 10
      WHEN 0 THEN 'http://127.0.0.' || (page_id % 256) || '/'
      WHEN 1 THEN 'http://10.' || (page_id % 256) || '.0.1/admin'
      WHEN 2 THEN ' http://8.8.' || (page_id % 256) || chr(9) || '.8/'
      WHEN 3 THEN 'ftp://files' || page_id || '.example/'
      WHEN 4 THEN 'http://' || (2130706433 + page_id % 256) || '/'
      WHEN 5 THEN 'http://0x' || lower(to_hex(167772160 + page_id)) || '/'
      WHEN 6 THEN 'http://[::ffff:192.168.0.' || (page_id % 256) || ']/'
      WHEN 7 THEN 'http:///nohost' || page_id
      WHEN 8 THEN 'https://user@169.254.169.' || (page_id % 256) || ':000' || (8443 + page_id % 3) || '/'
      ELSE 'http://[2606:4700:4700::' || (page_id % 1000) || ']:' || (page_id * 37) || '/' END
  ELSE url END AS url
FROM pages)
SELECT * FROM listed UNION ALL SELECT page_id + 100000000, url FROM listed WHERE page_id % 25 IN (3, 5)"""


def resolutions_sql() -> str:
    d = "md5(host)"

    def ip_from(tag):
        return quad_sql(f"('0x' || substring(md5(host || '{tag}'), 1, 8))::BIGINT")

    return f"""
SELECT host, 0 AS pos, CASE WHEN substring({d}, 1, 1) = 'e' THEN NULL ELSE {ip_from(':0')} END AS ip
FROM (SELECT DISTINCT {host_sql('url')} AS host FROM pages) WHERE substring({d}, 1, 1) <> 'f'
UNION ALL
SELECT host, 1 AS pos,
  CASE WHEN substring({d}, 1, 1) IN ('0', '1', '2', '3')
       THEN '10.' || ('0x' || substring({d}, 2, 2))::BIGINT || '.0.7'
       WHEN substring({d}, 1, 1) = '4' THEN 'fe80::' || substring({d}, 5, 4)
       ELSE {ip_from(':1')} END
FROM (SELECT DISTINCT {host_sql('url')} AS host FROM pages) WHERE substring({d}, 1, 1) NOT IN ('e', 'f')"""


def parts_cols(u: str) -> str:
    u = clean_sql(u)
    hi = hostinfo_sql(u)
    auth = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    port_t = (f"CASE WHEN starts_with({hi}, '[') THEN regexp_extract({hi}, '^\\[[^\\]]*\\][^:]*:(.*)$', 1)"
              f" ELSE regexp_extract({hi}, '^[^:]*:(.*)$', 1) END")
    return f"""{scheme_sql(u)} AS scheme, {host_sql(u)} AS host,
  coalesce(nullif(CASE WHEN regexp_full_match({port_t}, '[0-9]+') THEN try_cast({port_t} AS BIGINT) END, 0),
           CASE WHEN {scheme_sql(u)} = 'https' THEN 443 ELSE 80 END)::BIGINT AS port0,
  starts_with({hi}, '[') AS bracketed,
  (contains({auth}, '[') <> contains({auth}, ']')) AS bad_brackets,
  ({port_t} <> '' AND (NOT regexp_full_match({port_t}, '[0-9]+') OR coalesce(try_cast({port_t} AS BIGINT) > 65535, true))) AS bad_port"""


def admission_sql(src: str, col: str, key: str, res: str = "res", p: str = "") -> str:
    """CTE list producing ``{p}adm`` from ``src`` (must hold ``key`` and ``col``);
    ``p`` prefixes every CTE name so the list can appear twice in a query."""
    return f"""
{p}a_parts AS (SELECT * EXCLUDE (port0), CASE WHEN port0 > 99999 THEN CASE scheme WHEN 'https' THEN 443 ELSE 80 END ELSE port0 END::BIGINT AS port
  FROM (SELECT *, {parts_cols(col)} FROM {src})),
{p}a_lit AS (SELECT *, {literal_cols('host')} FROM {p}a_parts),
{p}a_lit2 AS (SELECT *, (bad_brackets OR (bracketed AND h6 IS NULL)) AS malformed,
                  (v4 IS NOT NULL OR h6 IS NOT NULL) AS is_lit FROM {p}a_lit),
{p}a_lit_cls AS {classify_sql("(SELECT " + key + ", v4, h6 FROM " + p + "a_lit2 WHERE is_lit)", key)},
{p}ip_cls AS {classify_sql("(SELECT DISTINCT ip, " + v4_sql('ip') + " AS v4, " + v6_sql('ip') + " AS h6 FROM " + res + " WHERE ip IS NOT NULL)", "ip")},
{p}res_cls AS (SELECT r.host, r.pos, r.ip, c.cls AS reason FROM {res} r LEFT JOIN {p}ip_cls c ON r.ip = c.ip),
{p}res_agg AS (
  SELECT host, count(ip) AS n_addresses, arg_min(reason, pos) FILTER (WHERE reason IS NOT NULL) AS first_reason
  FROM {p}res_cls GROUP BY host),
{p}a_join AS (
  SELECT l.*, c.cls AS lit_reason, r.n_addresses, r.first_reason
  FROM {p}a_lit2 l LEFT JOIN {p}a_lit_cls c ON l.{key} = c.{key} AND l.is_lit
  LEFT JOIN {p}res_agg r ON l.host = r.host AND NOT l.is_lit),
{p}a_stat AS (
  SELECT *,
    CASE WHEN is_lit THEN lit_reason WHEN n_addresses = 0 THEN 'unresolvable' ELSE first_reason END AS why,
    scheme IN ('http', 'https') AS web FROM {p}a_join),
{p}adm AS (
  SELECT *,
    CASE WHEN malformed THEN 'invalid_url' WHEN NOT web THEN 'refused' WHEN host = '' THEN 'refused'
         WHEN bad_port THEN 'invalid_url' WHEN NOT is_lit AND n_addresses IS NULL THEN 'refused'
         WHEN why IS NOT NULL THEN 'refused' ELSE 'admitted' END AS status,
    CASE WHEN malformed THEN 'invalid URL ' || {col}
         WHEN NOT web THEN 'scheme ''' || scheme || ''' not allowed (http/https only)'
         WHEN host = '' THEN 'no host in URL'
         WHEN bad_port THEN 'invalid port in URL ' || {col}
         WHEN NOT is_lit AND n_addresses IS NULL THEN 'cannot resolve ' || host
         WHEN why IS NOT NULL THEN host || ' maps to a ' || why || ' address' END AS message
  FROM {p}a_stat)"""


PIECES = "(?is)" + "|".join([O.NOTE, *(f"<{t}{O.REST}.*?(?:</{t}[{O.SP}/>]|\\z)" for t in (
    "script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")), f"<[a-z]{O.BODY}>", "<[a-z][^>]*>"])
CANDIDATE = f"([^{O.SP},](?:[^{O.SP}]*[^{O.SP},])?)(?:,|[{O.SP}][^,]*|\\z)"


def requested_sql(base: str, ref: str, rel: str, keep: str, out: str) -> str:
    """Rows of ``rel`` with ``out``, the URL that a browser asks for: blanks and backslashes,
    missing or surplus slashes after a scheme as it reads them."""
    special = "('http', 'https', 'ws', 'wss', 'ftp')"
    return f"""(SELECT {keep}, CASE
    WHEN sch IN {special} AND sch = {scheme_sql(base)} AND NOT starts_with(aft, '//') THEN {resolve_sql(base, "(aft || tail)")}
    WHEN sch IN {special} THEN sch || '://' || ltrim(aft, '/') || tail
    WHEN sch = '' AND starts_with(front, '//') THEN {scheme_sql(base)} || '://' || ltrim(front, '/') || tail
    ELSE {resolve_sql(base, "(front || tail)")} END AS {out}
  FROM (SELECT *, substring(front, length(sch) + 2) AS aft FROM (
    SELECT *, CASE WHEN sch = '' OR sch IN {special} THEN replace(lead_in, '\\', '/') ELSE lead_in END AS front,
      substring(r, length(lead_in) + 1) AS tail FROM (
      SELECT *, {scheme_sql('r')} AS sch, regexp_extract(r, '^[^?#]*', 0) AS lead_in FROM (
        SELECT *, {trimmed_sql(ref)} AS r FROM {rel})))))"""


_REFERENCES_SQL = f"replace(replace({q(REFERENCES)}, '{{p}}', page_id::VARCHAR), '{{o}}', (page_id % 256)::VARCHAR)"
_REFRESH = f"(?i)url[{O.SP}]*=[{O.SP}]*[\"']?([^\"']*)"
RESOURCES = f"""
rp_html AS (
  SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN '<BASE target=_top><base href=''/base/' || page_id || '/?q''><base href=//later.test/>' ELSE '' END
    || {_REFERENCES_SQL} || coalesce(html, '') AS html FROM pages),
rp_lists AS (
  SELECT page_id, url, list_transform(list_filter(regexp_extract_all(html, {q(PIECES)}, 0), lambda t: NOT starts_with(t, '<!--')),
    lambda t: regexp_extract(t, {q(O.TAG_TEXT)}, 0)) AS tags FROM rp_html),
rp_tags AS (SELECT page_id, url, unnest(tags) AS head, generate_subscripts(tags, 1) - 1 AS pos FROM rp_lists),
rp_open AS (SELECT * FROM rp_tags WHERE contains(head, '=')),
rp_attrs AS (SELECT *, lower(regexp_extract(head, {q(O.NAME)}, 1)) AS tag FROM {O.attr_rows_sql('rp_open', 'page_id, url, pos, head')}),
rp_first AS (SELECT page_id, url, arg_min(v, pos) AS v FROM rp_attrs WHERE tag = 'base' AND n = 'href' GROUP BY ALL),
rp_base AS {requested_sql('url', 'v', 'rp_first', 'page_id', 'b')},
rp_refs AS (
  SELECT page_id, url, pos, n AS attr, v AS ref FROM rp_attrs
  WHERE n IN ('href', 'src', 'poster', 'data', 'action', 'formaction', 'background', 'manifest', 'xlink:href')
  UNION ALL SELECT page_id, url, pos, n, unnest(regexp_extract_all(v, {q(CANDIDATE)}, 1)) FROM rp_attrs WHERE n IN ('srcset', 'imagesrcset')
  UNION ALL SELECT page_id, url, pos, n, unnest(regexp_extract_all(v, {q(f"(?i)url[(][{O.SP}]*[{chr(34)}']?([^{chr(34)}')]*)")}, 1)) FROM rp_attrs WHERE n = 'style'
  UNION ALL SELECT a.page_id, a.url, a.pos, 'content', regexp_extract(a.v, {q(_REFRESH)}, 1)
    FROM rp_attrs a JOIN rp_attrs e ON e.page_id = a.page_id AND e.pos = a.pos AND e.n = 'http-equiv' AND lower(trim(e.v)) = 'refresh'
    WHERE a.tag = 'meta' AND a.n = 'content' AND regexp_extract(a.v, {q(_REFRESH)}, 1) <> ''),
rp_based AS (SELECT r.*, coalesce(b.b, r.url) AS base FROM rp_refs r LEFT JOIN rp_base b USING (page_id)),
r AS {requested_sql('base', 'ref', 'rp_based', 'page_id, pos, attr, ref', 'target')}"""
