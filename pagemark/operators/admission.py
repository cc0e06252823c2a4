"""URL admission (B1-B15): literal addresses are classified in place; names
are vetted once per job against the resolution table and joined back.

Plan shape: literal classification is a projection (one CASE, codegen). The
lookup side is deduplicated to one row per host (B15) before it meets the
resolution table, so the join back to the URL list is many-to-one against a
table with one row per host. AQE broadcasts that table when its measured
size is under the broadcast threshold; otherwise the join is sort-merge and
AQE's skew-join rule splits a host that carries a third of all URLs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemark.functions import addresses as A
from pagemark.functions import html as H
from pagemark.functions import urls as U
from pagemark.session import cut_lineage

# What a page requests: attributes with one reference, and elements whose content is text, not tags.
REFERENCE_ATTRIBUTES = ("href", "src", "poster", "data", "action", "formaction", "background", "manifest", "xlink:href")
CANDIDATE_ATTRIBUTES = ("srcset", "imagesrcset")
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
# Comments and raw texts are matched whole, so that tags inside them are none.
PIECE_RE = ("(?is)" + H.COMMENT + "".join(f"|<{t}{H.NAME_END}{H.IN_TAG}.*?(?:</{t}{H.NAME_END}|\\z)" for t in RAW_TEXT)
            + f"|<[a-z]{H.IN_TAG}|<[a-z][^>]*>")
CANDIDATE_RE = f"([^{H.WS},](?:[^{H.WS}]*[^{H.WS},])?)(?:,|[{H.WS}][^,]*|\\z)"
CSS_URL_RE = f"(?i)url\\([{H.WS}]*[\"']?([^\"')]*)"
REFRESH_RE = f"(?i)url[{H.WS}]*=[{H.WS}]*[\"']?([^\"']*)"


def url_parts(df: DataFrame, col: str = "url") -> DataFrame:
    """B1-B4 plus the literal form of the host."""
    out = A.with_literal(U.with_url_parts(df, col), "host")
    return out.withColumn(
        "malformed", F.col("bad_brackets") | (F.col("bracketed") & F.col("lit_v6").isNull()))


def with_ip_reason(df: DataFrame, ip: str, out: str) -> DataFrame:
    """Class of a resolved address given as text (IPv4 or IPv6)."""
    d = A.with_v6_hex(df.withColumn("_r4", A.v4_from_quad(F.col(ip))), ip, "_r6")
    return A.with_class(d, "_r4", "_r6", out).drop("_r4", "_r6")


def resolution_summary(resolutions: DataFrame) -> DataFrame:
    """Per host: number of addresses and the first blocked reason in list order."""
    return (with_ip_reason(resolutions, "ip", "reason")
            .groupBy("host").agg(
                F.count("ip").alias("n_addresses"),
                F.expr("min_by(reason, pos) FILTER (WHERE reason IS NOT NULL)").alias("first_reason")))


def _verdict_cols(j: DataFrame) -> DataFrame:
    return j.withColumns({
        "resolved": F.col("n_addresses").isNotNull(),
        "dns_reason": F.when(F.col("n_addresses") == 0, F.lit("unresolvable")).otherwise(F.col("first_reason"))})


def host_verdicts(hosts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """B10 + B11 for distinct hosts: refused if any address is blocked, the
    reason being the first blocked one in list order; an empty answer is
    `unresolvable`; a host with no resolution row failed to resolve."""
    j = _verdict_cols(hosts.join(resolution_summary(resolutions), "host", "left"))
    return j.select("host", "resolved",
                    F.coalesce(F.col("n_addresses"), F.lit(0)).cast("long").alias("n_addresses"),
                    F.col("dns_reason").alias("reason"))


def host_table(hosts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Everything admission needs to know about a host, computed once per
    distinct host (B5-B11, B15): literal form, its class, and the DNS verdict."""
    h = A.with_class(A.with_literal(hosts, "host"), "lit_v4", "lit_v6", "lit_reason")
    return _verdict_cols(h.join(resolution_summary(resolutions), "host", "left")).select(
        "host", "lit_v4", "lit_v6", "lit_reason", "resolved", "dns_reason")


def admission(df: DataFrame, resolutions: DataFrame, col: str = "url") -> DataFrame:
    """One verdict per row of ``df``.

    Adds scheme, host, port, status (`admitted`, `refused`, `invalid_url`),
    reason (address class) and message (the refusal text).

    Only the cheap URL split runs per row; literal parsing, classification
    and the resolution lookup run once per distinct host (B15) and join back
    on the host. That join is many-to-one against one row per host: AQE
    broadcasts the host table when its measured size allows, otherwise it
    is a sort-merge join whose hot hosts the skew-join rule splits.
    """
    p = U.with_url_parts(df, col)
    hosts = host_table(p.select("host").distinct(), resolutions)
    return verdicts(p.join(hosts, "host", "left"), col)


def with_hosts(df: DataFrame, resolutions: DataFrame, col: str = "url") -> DataFrame:
    """URL parts and what is known of the host, row by row: the literal form and its class
    as expressions, names by a join with the resolution table's verdicts. For streams,
    which cannot be reduced to distinct hosts first."""
    p = A.with_class(A.with_literal(U.with_url_parts(df, col), "host"), "lit_v4", "lit_v6", "lit_reason")
    known = _verdict_cols(resolution_summary(resolutions)).select("host", "resolved", "dns_reason")
    return p.join(known, "host", "left")


def verdicts(j: DataFrame, col: str = "url") -> DataFrame:
    """The verdict columns from URL parts and host facts."""
    is_lit = F.col("lit_v4").isNotNull() | F.col("lit_v6").isNotNull()
    j = j.withColumns({
        "malformed": F.col("bad_brackets") | (F.col("bracketed") & F.col("lit_v6").isNull()),
        "why": F.when(is_lit, F.col("lit_reason")).otherwise(F.col("dns_reason"))})
    reason = F.col("why")
    web = F.col("scheme").isin("http", "https")
    resolved = F.coalesce(F.col("resolved"), F.lit(False))
    status = (F.when(F.col("malformed"), "invalid_url")
              .when(~web, "refused")
              .when(F.col("host") == "", "refused")
              .when(F.col("bad_port"), "invalid_url")
              .when(~is_lit & ~resolved, "refused")
              .when(reason.isNotNull(), "refused")
              .otherwise("admitted"))
    message = (F.when(F.col("malformed"), F.concat(F.lit("invalid URL "), F.col(col)))
               .when(~web, F.format_string("scheme '%s' not allowed (http/https only)", F.col("scheme")))
               .when(F.col("host") == "", F.lit("no host in URL"))
               .when(F.col("bad_port"), F.concat(F.lit("invalid port in URL "), F.col(col)))
               .when(~is_lit & ~resolved, F.concat(F.lit("cannot resolve "), F.col("host")))
               .when(reason.isNotNull(), F.format_string("%s maps to a %s address", F.col("host"), reason)))
    j = j.withColumn("status", status)
    return j.withColumns({"reason": F.when(F.col("status") == "refused", reason), "message": message})


def resources(pages: DataFrame) -> DataFrame:
    """B13 input: every reference of every page that a browser would request, resolved
    as it would (C2) against the page's base: ``page_id, pos`` (of the tag among the
    page's tags) ``, attr, ref, target``.

    References stand in the attributes above, in candidate lists, in ``url(...)`` of a
    style attribute and in a refresh. Attributes may be unquoted, with blanks round
    ``=``, with references decoded. The first ``base`` with a ``href`` sets the base.
    """
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(PIECE_RE), 0)
    tags = F.transform(F.filter(found, lambda t: ~t.startswith("<!--")), lambda t: F.regexp_extract(t, H.TAG_TEXT_RE, 0))
    bases = F.filter("tags", lambda t: t.rlike(f"(?i)^<base{H.NAME_END}") & H.attribute(t, "href").isNotNull())
    p = pages.select("page_id", "url", tags.alias("tags")).select("*", F.try_element_at(bases, F.lit(1)).alias("base"))
    t = p.select("page_id", F.when(F.col("base").isNotNull(), U.requested(F.col("url"), H.attribute(F.col("base"), "href")))
                 .otherwise(F.col("url")).alias("base"), F.posexplode("tags").alias("pos", "head"))
    t = t.where(F.col("head").contains("=") & F.col("head").rlike("(?i)href|src|poster|data|action|background|manifest|url"))
    t = t.withColumn("attrs", H.attributes(F.col("head")))
    own = lambda name: F.try_element_at("attrs", F.lit(name))
    ref = lambda name, value: F.struct(F.lit(name).alias("attr"), value.alias("ref"))
    many = lambda name, pattern: F.transform(
        F.coalesce(F.regexp_extract_all(own(name), F.lit(pattern), 1), F.expr("cast(array() as array<string>)")), lambda v: ref(name, v))
    next_page = F.when(F.col("head").rlike(f"(?i)^<meta{H.NAME_END}") & (F.lower(F.trim(own("http-equiv"))) == "refresh"),
                       F.nullif(F.regexp_extract(own("content"), REFRESH_RE, 1), F.lit("")))
    refs = F.concat(F.array(*[ref(n, own(n)) for n in REFERENCE_ATTRIBUTES], ref("content", next_page)),
                    *[many(n, CANDIDATE_RE) for n in CANDIDATE_ATTRIBUTES], many("style", CSS_URL_RE))
    r = t.select("page_id", "pos", "base", F.inline(F.filter(refs, lambda x: x["ref"].isNotNull())))
    return r.select("page_id", "pos", "attr", "ref", U.requested(F.col("base"), F.col("ref")).alias("target"))


def resource_admission(pages: DataFrame, resolutions: DataFrame) -> DataFrame:
    """http(s) resources are vetted like URLs (blocked -> abort); other
    schemes (data:, blob:, about:, ...) continue unvetted."""
    # Found once: the vetting reads the narrow table twice (rows, distinct hosts).
    res = cut_lineage(resources(pages))
    vetted = admission(res, resolutions, "target")
    web = F.col("scheme").isin("http", "https")
    return vetted.select(
        "page_id", "pos", "attr", "target",
        F.when(~web | (F.col("status") == "admitted"), "continue").otherwise("abort").alias("action"),
        F.when(web, F.col("message")).alias("message"))
