"""Registered queries of J1 (URL admission) and J2 (page resource audit)."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagemark.functions import addresses as A
from pagemark.operators import admission as ADM
from pagemark.operators import ranges as R
from pagemark.plans import oracle_admission as OA
from pagemark.sources import derived


def q_url_admission(spark, sf_dir):
    """One verdict per URL of the work list."""
    urls = derived.url_list(spark, sf_dir)
    adm = ADM.admission(urls, derived.resolutions(spark, sf_dir))
    return adm.select("page_id", "url", "scheme", "host", "port", "status", "reason", "message")


def q_address_classes(spark, sf_dir):
    """Literal parsing and class of sampled address texts."""
    s = derived.address_samples(spark, sf_dir)
    s = A.with_class(A.with_literal(s, "text", "v4", "h6"), "v4", "h6", "class")
    return s.select("event_id", "form", "text", F.col("v4").cast("long").alias("v4"), "h6", "class")


def q_address_ranges(spark, sf_dir):
    """B9 against a range table of any size: the longest block of each sampled address."""
    s = derived.address_samples(spark, sf_dir).where("form <> 'v6'")
    s = A.with_literal(s, "text", "v4", "h6").select("event_id", "form", "text", R.address_hex(F.col("v4"), F.col("h6")).alias("hex"))
    found = R.longest_prefix(s, R.range_table(derived.address_ranges(spark, sf_dir)), "hex")
    return found.select("event_id", "form", "text", (F.col("length") - 96).cast("long").alias("bits"), "label")


def q_host_resolution(spark, sf_dir):
    """Verdict per distinct page host from the resolution table."""
    # Conditions on the parsed-literal columns stay columns, not filters: a
    # filter would be pushed below the parsing projection and inline it.
    names = ADM.url_parts(derived.url_list(spark, sf_dir)).groupBy("host").agg(
        F.max(F.col("lit_v4").isNotNull() | F.col("lit_v6").isNotNull()).alias("is_literal"))
    v = ADM.host_verdicts(names.select("host"), derived.resolutions(spark, sf_dir))
    return names.join(v, "host").select("host", "is_literal", "resolved", "n_addresses", "reason")


def q_unique_lookups(spark, sf_dir):
    """Each host+port is vetted once per job."""
    parts = ADM.url_parts(derived.url_list(spark, sf_dir))
    vetted = (F.col("scheme").isin("http", "https") & (F.col("host") != "")
              & ~F.col("malformed") & ~F.col("bad_port"))
    return parts.groupBy("host", "port", vetted.alias("vetted")).agg(
        F.count(F.lit(1)).alias("n_urls"))


def q_resource_admission(spark, sf_dir):
    """Every resource a page would request, with its verdict, on pages that
    also refer to private hosts in many spellings."""
    r = ADM.resource_admission(derived.resource_pages(spark, sf_dir), derived.resolutions(spark, sf_dir))
    return r.select("page_id", F.col("pos").cast("long").alias("pos"), "attr", "target", "action", "message")


QUERIES = {
    "url_admission": q_url_admission,
    "address_classes": q_address_classes,
    "address_ranges": q_address_ranges,
    "host_resolution": q_host_resolution,
    "unique_lookups": q_unique_lookups,
    "resource_admission": q_resource_admission,
}

_RES = f"res AS ({OA.resolutions_sql()})"

ADDRESS_SAMPLES = """
SELECT event_id, form, text FROM (
  SELECT event_id, v4n, d,
    'v4' AS f1, {quad} AS t1,
    'v6' AS f2,
    CASE event_id % 8
      WHEN 0 THEN '::ffff:' || {quad}
      WHEN 1 THEN '2002:' || g1 || ':' || g2 || '::' || g3
      WHEN 2 THEN '2001:0:' || g1 || ':' || g2 || '::' || g3 || ':' || g4
      WHEN 3 THEN 'fe80::' || g1 || ':' || g2
      WHEN 4 THEN 'fc00:' || g1 || '::' || g2
      WHEN 5 THEN 'ff02::' || g1
      WHEN 6 THEN '::' || g1 || ':' || g2
      ELSE concat_ws(':', g1, g2, g3, g4, g5, g6, g7, g8) END AS t2,
    'int' AS f3,
    CASE event_id % 4
      WHEN 0 THEN v4n::VARCHAR
      WHEN 1 THEN '0x' || lower(to_hex(v4n))
      WHEN 2 THEN ('0x' || substring(d, 1, 15))::BIGINT::VARCHAR
                  || lpad(('0x' || substring(d, 16, 10))::BIGINT::VARCHAR, (event_id % 23)::INT, '0')
      ELSE '0x' || substring(d, 1, 8 + (event_id % 25)::INT) END AS t3
  FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS v4n, md5(event_id::VARCHAR) AS d,
          substring(md5(event_id::VARCHAR), 1, 4) AS g1, substring(md5(event_id::VARCHAR), 5, 4) AS g2,
          substring(md5(event_id::VARCHAR), 9, 4) AS g3, substring(md5(event_id::VARCHAR), 13, 4) AS g4,
          substring(md5(event_id::VARCHAR), 17, 4) AS g5, substring(md5(event_id::VARCHAR), 21, 4) AS g6,
          substring(md5(event_id::VARCHAR), 25, 4) AS g7, substring(md5(event_id::VARCHAR), 29, 4) AS g8
        FROM events))
UNPIVOT ((form, text) FOR k IN ((f1, t1), (f2, t2), (f3, t3)))""".format(quad=OA.quad_sql("v4n"))

ORACLE = {
    "url_admission": f"""WITH {_RES}, src AS ({OA.URL_LIST}), {OA.admission_sql('src', 'url', 'url').strip()}
SELECT page_id, url, scheme, host, port, status, CASE WHEN status = 'refused' THEN why END AS reason, message
FROM adm""",
    "address_classes": f"""WITH s AS ({ADDRESS_SAMPLES}),
lit AS (SELECT event_id, form, text, {OA.literal_cols('text')} FROM s),
keyed AS (SELECT event_id || ':' || form AS k, * FROM lit),
cls AS {OA.classify_sql('(SELECT k, v4, h6 FROM keyed)', 'k')}
SELECT event_id, form, text, v4::BIGINT AS v4, h6, c.cls AS class
FROM keyed LEFT JOIN cls c USING (k)""",
    "address_ranges": f"""WITH s AS ({ADDRESS_SAMPLES}),
lit AS (SELECT event_id, form, text, {OA.literal_cols('text')} FROM s WHERE form <> 'v6'),
blocks AS (
  SELECT (l_orderkey * 7 + l_linenumber) * 2654435761 % 4294967296 AS base, 12 + (l_orderkey + l_linenumber) % 21 AS bits,
    'o' || l_orderkey || '.' || l_linenumber AS label FROM lineitem
  UNION ALL SELECT (event_id * 2654435761) % 4294967296, unnest([16, 20, 25, 31]), 'e' || event_id FROM events),
ranges AS (
  SELECT low, low + size - 1 AS high, bits, min(label) AS label
  FROM (SELECT base // size * size AS low, size, bits, label FROM (SELECT *, (2 ** (32 - bits))::BIGINT AS size FROM blocks)) GROUP BY ALL),
best AS (SELECT a.v4, max({{'bits': r.bits, 'label': r.label}}) AS b FROM (SELECT DISTINCT v4 FROM lit WHERE v4 IS NOT NULL) a
  JOIN ranges r ON a.v4 >= r.low AND a.v4 <= r.high GROUP BY a.v4)
SELECT event_id, form, text, b.bits::BIGINT AS bits, b.label AS label FROM lit LEFT JOIN best USING (v4)""",
    "host_resolution": f"""WITH {_RES}, src AS ({OA.URL_LIST}), {OA.admission_sql('src', 'url', 'url').strip()}
SELECT host, is_literal, n_addresses IS NOT NULL AS resolved, coalesce(n_addresses, 0)::BIGINT AS n_addresses,
  CASE WHEN n_addresses = 0 THEN 'unresolvable' ELSE first_reason END AS reason
FROM (SELECT host, bool_or(is_lit) AS is_literal FROM a_lit2 GROUP BY host) h LEFT JOIN res_agg USING (host)""",
    "unique_lookups": f"""WITH {_RES}, src AS ({OA.URL_LIST}), {OA.admission_sql('src', 'url', 'url').strip()}
SELECT host, port, (scheme IN ('http', 'https') AND host <> '' AND NOT malformed AND NOT bad_port) AS vetted,
  count(*)::BIGINT AS n_urls FROM a_lit2
GROUP BY ALL""",
    "resource_admission": f"""WITH {_RES}, {OA.RESOURCES.strip()},
web AS (SELECT row_number() OVER () AS rk, * FROM r WHERE {OA.scheme_sql('target')} IN ('http', 'https')),
{OA.admission_sql('web', 'target', 'rk').strip()}
SELECT page_id, pos::BIGINT AS pos, attr, target, CASE WHEN status = 'admitted' THEN 'continue' ELSE 'abort' END AS action,
  message FROM adm
UNION ALL
SELECT page_id, pos::BIGINT, attr, target, 'continue', NULL FROM r
WHERE {OA.scheme_sql('target')} NOT IN ('http', 'https')""",
}
