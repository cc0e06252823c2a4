"""Registered queries of J9 (request-log policy), J10 (lookup reuse) and
J11 (log redaction)."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagemark.operators import folds
from pagemark.operators import policy as P
from pagemark.plans.oracle_blocks import q
from pagemark.sources import derived

# Bucket on the driver's event rate: 5 tokens, one refilled every 6 hours.
EVENTS_BUCKET = folds.Bucket(capacity=5, period_us=6 * 3600 * 1_000_000)
# Decision reuse on the driver's lookups: 6-hour TTL so reuse happens.
EVENTS_TTL_US = 6 * 3600 * 1_000_000


def _keys(spark):
    return P.key_set(derived.key_lines(spark))


def decisions(spark, sf_dir):
    return P.policy(derived.requests(spark, sf_dir), _keys(spark), EVENTS_BUCKET)


def q_client_activity(spark, sf_dir):
    """A5, L1: client identity and Host of every request."""
    r = P.client_identity(derived.requests(spark, sf_dir))
    return r.select("id", "scope_type", "identity", "host_header")


def q_token_bucket(spark, sf_dir):
    """L2, L3: per-identity token bucket over the http requests."""
    r = P.client_identity(derived.requests(spark, sf_dir)).where(F.col("scope_type") == "http")
    r = r.select("id", "identity", F.unix_micros("ts").alias("ts_us"))
    return folds.token_bucket(r, "identity", "ts_us", "id", EVENTS_BUCKET).select(
        "id", "identity", "allowed", "tokens_after")


def q_key_check(spark, sf_dir):
    """Presented key and whether the key set in force holds it."""
    k = P.key_check(derived.requests(spark, sf_dir), _keys(spark))
    return k.select("id", "presented", "key_ok")


def q_key_asof(spark, sf_dir):
    """Key-file version in force per request (as-of join)."""
    k = P.key_asof(derived.requests(spark, sf_dir).select("id", "ts"), _keys(spark))
    return k.select("id", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("key_version"))


def q_key_asof_dense(spark, sf_dir):
    """L7 with thousands of key-file versions."""
    k = P.key_asof(derived.requests(spark, sf_dir).select("id", "ts"), derived.dense_key_versions(spark, sf_dir))
    return k.select("id", F.unix_micros("loaded_at").alias("version_us"))


def q_policy_replay(spark, sf_dir):
    """Gate decision per request."""
    return decisions(spark, sf_dir).select("id", "identity", F.col("status").cast("long").alias("status"),
                                           "reason")


def q_host_allow(spark, sf_dir):
    """Host allow-list on the requests the gate let through."""
    hosts = P.allowed_hosts(derived.ALLOWED_HOSTS_OPTION, spark)
    return P.host_allow(decisions(spark, sf_dir), hosts).select("id", "host_header", "host_ok")


def q_policy_report(spark, sf_dir):
    """Requests by identity, hour and decision."""
    rep = P.policy_report(decisions(spark, sf_dir))
    return rep.select("identity", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "reason",
                      F.col("n").cast("long").alias("n"))


def q_redacted_log(spark, sf_dir):
    """Access-log records with key values redacted."""
    r = P.redacted_log(derived.log_lines(spark, sf_dir))
    return r.select("id", "msg", F.array_join("args", "|").alias("args"))


def q_lookup_reuse(spark, sf_dir):
    """Hit or miss of each host+port lookup under the verdict TTL."""
    lk = derived.lookups(spark, sf_dir).withColumn("ts_us", F.unix_micros("ts"))
    hits = folds.decision_reuse(lk, ["host", "port"], "ts_us", "id", EVENTS_TTL_US)
    return hits.select("id", "host", F.col("port").cast("long").alias("port"), "hit")


QUERIES = {
    "client_activity": q_client_activity,
    "token_bucket": q_token_bucket,
    "key_check": q_key_check,
    "key_asof": q_key_asof,
    "key_asof_dense": q_key_asof_dense,
    "policy_replay": q_policy_replay,
    "host_allow": q_host_allow,
    "policy_report": q_policy_report,
    "redacted_log": q_redacted_log,
    "lookup_reuse": q_lookup_reuse,
}

_WS = "'^[ \t\r\n]+|[ \t\r\n]+$'"
_lines = ", ".join(f"(TIMESTAMP {q(ts)}, {q(line)})" for ts, lines in derived.KEY_FILE_VERSIONS for line in lines)

REQUESTS_SQL = f"""
reqs0 AS (
  SELECT event_id AS id, ts, user_id AS uid, event_type,
    CASE WHEN event_id % 97 = 0 THEN 'websocket' ELSE 'http' END AS scope_type,
    CASE WHEN event_type = 'signup' THEN '/.well-known/x' WHEN event_id % 31 = 0 THEN '/.well-known'
         WHEN event_id % 37 = 0 THEN '/.well-knownx' ELSE '/mcp' END AS path,
    CASE WHEN event_id % 13 = 0 THEN 'key=&key=k' || (user_id % 9) || '&v=' || event_id
         WHEN event_id % 17 = 0 THEN 'v=' || event_id
         WHEN event_id % 19 = 0 THEN 'key=a+b%20c&v=' || event_id
         WHEN event_id % 23 = 0 THEN 'k%65y=k' || (user_id % 9) || '&v=' || event_id
         WHEN event_id % 29 = 0 THEN 'key=a+b%zz&v=' || event_id
         ELSE 'key=k' || (user_id % 9) || '&v=' || event_id END AS query_string,
    {{'name': 'Host', 'value': CASE WHEN user_id % 10 = 3 THEN 'evil.example' WHEN user_id % 10 = 4 THEN '[::1]:8787' ELSE 'localhost:8787' END}} AS hh,
    CASE WHEN user_id % 50 = 7 THEN NULL
         ELSE '10.1.' || (user_id % 256) || '.' || ((user_id // 256) % 256) END AS client_ip
  FROM events),
reqs AS (
  SELECT *,
    CASE uid % 5
      WHEN 0 THEN [hh, {{'name': 'CF-Connecting-IP', 'value': '203.0.113.' || (uid % 256)}}]
      WHEN 1 THEN [hh, {{'name': 'X-Forwarded-For', 'value': '198.51.100.' || (uid % 256) || ', 10.0.0.1'}}]
      WHEN 2 THEN [hh, {{'name': 'x-forwarded-for', 'value': ''}},
                   {{'name': 'X-Forwarded-For', 'value': ' 192.0.2.' || (uid % 256)}}]
      ELSE [hh] END AS headers
  FROM reqs0),
hdr AS (
  SELECT *,
    list_filter(headers, lambda h: lower(h.name) = 'cf-connecting-ip')[-1].value AS cf,
    list_filter(headers, lambda h: lower(h.name) = 'x-forwarded-for')[-1].value AS xff,
    list_filter(headers, lambda h: lower(h.name) = 'host')[-1].value AS hostv
  FROM reqs),
ident AS (
  SELECT *,
    coalesce(nullif(cf, ''), nullif(regexp_replace(split_part(coalesce(xff, ''), ',', 1), {_WS}, '', 'g'), ''),
             client_ip, 'unknown') AS identity,
    regexp_extract(coalesce(hostv, ''), '^(\\[[^\\]]*\\]|[^:]*)', 1) AS host_header,
    coalesce(url_decode(replace(list_extract(list_transform(list_filter(string_split(query_string, '&'),
      lambda x: url_decode(replace(split_part(x, '=', 1), '+', ' ')) = 'key' AND contains(x, '=') AND length(x) > instr(x, '=')),
      lambda x: substring(x, instr(x, '=') + 1)), 1), '+', ' ')), '') AS presented
  FROM hdr),
klines AS (SELECT * FROM (VALUES {_lines}) t(loaded_at, line)),
keyset AS (
  SELECT DISTINCT loaded_at, regexp_replace(line, {_WS}, '', 'g') AS key FROM klines
  WHERE regexp_replace(line, {_WS}, '', 'g') <> '' AND NOT starts_with(regexp_replace(line, {_WS}, '', 'g'), '#')),
versions AS (SELECT DISTINCT loaded_at FROM keyset),
as_of AS (
  SELECT i.*, v.loaded_at FROM ident i ASOF LEFT JOIN versions v ON i.ts >= v.loaded_at),
checked AS (
  SELECT a.*, presented <> '' AND k.key IS NOT NULL AS key_ok
  FROM as_of a LEFT JOIN keyset k ON k.loaded_at = a.loaded_at AND k.key = a.presented),
ordr AS (
  SELECT id, identity, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY identity ORDER BY epoch_us(ts), id) AS rn
  FROM ident WHERE scope_type = 'http'),
bucket AS (
  SELECT identity, rn, id, ts_us, {EVENTS_BUCKET.cap_units} - {EVENTS_BUCKET.period_us} AS tokens, true AS allowed
  FROM ordr WHERE rn = 1
  UNION ALL
  SELECT o.identity, o.rn, o.id, o.ts_us,
    CASE WHEN least({EVENTS_BUCKET.cap_units}, b.tokens + (o.ts_us - b.ts_us)) < {EVENTS_BUCKET.period_us}
         THEN least({EVENTS_BUCKET.cap_units}, b.tokens + (o.ts_us - b.ts_us))
         ELSE least({EVENTS_BUCKET.cap_units}, b.tokens + (o.ts_us - b.ts_us)) - {EVENTS_BUCKET.period_us} END,
    least({EVENTS_BUCKET.cap_units}, b.tokens + (o.ts_us - b.ts_us)) >= {EVENTS_BUCKET.period_us}
  FROM bucket b JOIN ordr o ON o.identity = b.identity AND o.rn = b.rn + 1),
decided AS (
  SELECT c.*, b.allowed, b.tokens AS tokens_after,
    CASE WHEN scope_type <> 'http' THEN NULL WHEN NOT b.allowed THEN 429
         WHEN path = '/.well-known' OR starts_with(path, '/.well-known/') THEN 404
         WHEN NOT key_ok THEN 401 END AS status,
    CASE WHEN scope_type <> 'http' THEN 'passed (not http)' WHEN NOT b.allowed THEN 'rate limited'
         WHEN path = '/.well-known' OR starts_with(path, '/.well-known/') THEN 'not found'
         WHEN NOT key_ok THEN 'unauthorized' ELSE 'passed' END AS reason
  FROM checked c LEFT JOIN bucket b ON b.id = c.id)"""

_W = "WITH RECURSIVE " + REQUESTS_SQL.strip()
_hosts = ", ".join(f"({q(h.strip())})" for h in derived.ALLOWED_HOSTS_OPTION.split(",") if h.strip())

LOOKUPS_SQL = f"""WITH RECURSIVE lk AS (
  SELECT event_id AS id, 'h' || (user_id % 58) || '.example' AS host,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 443 ELSE 80 END AS port, epoch_us(ts) AS ts_us,
    row_number() OVER (PARTITION BY 'h' || (user_id % 58) || '.example',
      CASE WHEN event_type IN ('purchase', 'signup') THEN 443 ELSE 80 END ORDER BY epoch_us(ts), event_id) AS rn
  FROM events),
reuse AS (
  SELECT host, port, rn, id, ts_us, ts_us + {EVENTS_TTL_US} AS expiry, false AS hit FROM lk WHERE rn = 1
  UNION ALL
  SELECT l.host, l.port, l.rn, l.id, l.ts_us,
    CASE WHEN r.expiry > l.ts_us THEN r.expiry ELSE l.ts_us + {EVENTS_TTL_US} END,
    r.expiry > l.ts_us
  FROM reuse r JOIN lk l ON l.host = r.host AND l.port = r.port AND l.rn = r.rn + 1)
SELECT id, host, port::BIGINT AS port, hit FROM reuse"""

_KEY_RE = "([?&]key=)[^&\\s]+"
LOG_SQL = f"""
SELECT id, CASE WHEN contains(msg, 'key=') THEN regexp_replace(msg, {q(_KEY_RE)}, '\\1REDACTED', 'g') ELSE msg END AS msg,
  array_to_string(list_transform(args, lambda a: regexp_replace(a, {q(_KEY_RE)}, '\\1REDACTED', 'g')), '|') AS args
FROM (
  SELECT event_id AS id,
    CASE WHEN event_id % 5 = 0 THEN 'key=' || user_id || ' at line start'
         ELSE 'GET /mcp?key=' || user_id || '&v=' || event_id END AS msg,
    ['/mcp?v=1&key=s' || user_id, event_type, 'x?key=' || event_id || ' y'] AS args
  FROM events)"""

ORACLE = {
    "client_activity": _W + "\nSELECT id, scope_type, identity, host_header FROM ident",
    "token_bucket": _W + "\nSELECT id, identity, allowed, tokens AS tokens_after FROM bucket",
    "key_check": _W + "\nSELECT id, presented, key_ok FROM checked",
    "key_asof": _W + "\nSELECT id, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS key_version FROM as_of",
    "key_asof_dense": """SELECT e.event_id AS id, epoch_us(v.loaded_at) AS version_us FROM events e ASOF LEFT JOIN
  (SELECT DISTINCT ts AS loaded_at FROM events WHERE event_type = 'purchase') v ON e.ts >= v.loaded_at""",
    "policy_replay": _W + "\nSELECT id, identity, status::BIGINT AS status, reason FROM decided",
    "host_allow": _W + f""",
allowed AS (SELECT DISTINCT h FROM (VALUES {_hosts}) t(h))
SELECT id, host_header, host_header IN (SELECT h FROM allowed) AS host_ok FROM decided WHERE reason = 'passed'""",
    "policy_report": _W + """
SELECT identity, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, reason, count(*)::BIGINT AS n
FROM decided GROUP BY ALL""",
    "redacted_log": LOG_SQL,
    "lookup_reuse": LOOKUPS_SQL,
}
