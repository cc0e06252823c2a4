"""Inputs the engine needs that the driver tables lack, derived from them by
fixed rules (the DuckDB twins apply the same rules). All lazy DataFrames;
their size grows with the tables they come from.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemark.sources import tables


def supplier_table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML page per nation with a table of its suppliers: cells that span rows and
    columns, empty ones, bars and blocks inside cells, rows that close nothing."""
    s = tables.table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    key = F.col("s_suppkey").cast("string")
    row = F.concat(F.lit('<tr><td rowspan="'), (F.col("s_suppkey") % 3).cast("string"), F.lit('">'), key, F.lit("</td><td colspan="),
                   (F.col("s_suppkey") % 4).cast("string"), F.lit("><p>"), F.col("s_name"), F.lit("</p><ul><li>a|b</li></ul></td><td></td><td rowspan=2>r"), key,
                   F.when(F.col("s_suppkey") % 2 == 0, F.lit("</td></tr>")).otherwise(F.lit("<td>")))
    rows = s.select("s_nationkey", "s_suppkey", row.alias("tr")).groupBy("s_nationkey").agg(
        F.expr("listagg(tr, '') WITHIN GROUP (ORDER BY s_suppkey)").alias("trs"))
    return rows.select(
        (F.col("s_nationkey") + 100).cast("long").alias("page_id"), F.concat(F.lit("https://tables.example/nation/"), F.col("s_nationkey").cast("string")).alias("url"),
        F.concat(F.lit("<article><table><tr><td></td></tr><tr><th rowspan=2>key<th colspan=2>name|alias<th>&nbsp;</tr>"), F.col("trs"),
                 F.lit("</table><p>below</p></article>")).alias("html"))


def region_table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML page per region holding a table of its nations (D9 input)."""
    r = tables.table(spark, sf_dir, "region")
    n = tables.table(spark, sf_dir, "nation")
    rows = (n.groupBy("n_regionkey").agg(F.expr(
        "listagg(concat('<tr><td>', cast(n_nationkey AS STRING), '</td><td>', n_name, '</td></tr>'), '')"
        " WITHIN GROUP (ORDER BY n_nationkey)").alias("trs")))
    return r.join(rows, r.r_regionkey == rows.n_regionkey).select(
        F.col("r_regionkey").cast("long").alias("page_id"),
        F.concat(F.lit("https://tables.example/region/"), F.lower("r_name")).alias("url"),
        F.concat(F.lit("<html><body><article><h2>"), F.col("r_name"),
                 F.lit("</h2><table><tr><th>key</th><th>name</th></tr>"), F.col("trs"),
                 F.lit("</table></article></body></html>")).alias("html"))


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a fixed set of awkward forms put before its own HTML: text
    before the first tag, character references, marks and links with markup
    inside, loose and empty marks, nested lists, and for page_id % 3 = 0 a
    script that never ends."""
    p = tables.pages(spark, sf_dir)
    pid = F.col("page_id").cast("string")
    head = F.concat(
        F.lit("Lead it&#8217;s &mdash; caf&eacute; &#xE9;&unknown;&#0; "), pid,
        F.lit("<p><a href=\"../n/./"), pid, F.lit("/../m?x=1\"><b>bold</b> link "), pid, F.lit("</a> and <b>a <i> b </i></b>, <i>open "), pid,
        F.lit("</p><ol><li>one<ul><li>in</li><li>out</li></ul></li><li>two <code>x < y</code></li></ol>"
              "<p><a href=\"/e\"><img src=\"i.png\"></a>x<b> </b><b><i></i></b> y <em></p>"))
    tail = F.when(F.col("page_id") % 3 == 0, F.lit("<p>end</p><script>var x = '<p>no</p>';")).otherwise(F.lit(""))
    return p.select("page_id", "url", F.concat(head, F.coalesce("html", F.lit("")), tail).alias("html"))


def _fill(text: str):
    """A fixed text in which ``{p}`` stands for the page_id and ``{o}`` for page_id % 256."""
    pid = F.col("page_id")
    return F.replace(F.replace(F.lit(text), F.lit("{p}"), pid.cast("string")), F.lit("{o}"), (pid % 256).cast("string"))


# Sloppy but common HTML: no `head`, closers without opener, attributes without quotes or with blanks,
# a quoted `>`, references in many spellings, custom elements, an advertising section.
SLOPPY = (
    "<title>Title {p}</title><meta charset=utf-8><body class=x></nav><nav><p>menu {p}</p></nav></a></div></ol>"
    "<section class=\"wide Promo\"><p>bought {p}</p><section>inner</section><div>box</div></section></section>"
    "<p title=\"a>b\" data-x='q' hidden ID=p{p}>see <a href=/unq/{p}>u</a> and <a href = \"/sp/{p}\">s</a>, <a HREF='?a=1&amp;b={p}'>q</a>, "
    "<a class=k href=\" \t/blank/{p} \">t</a>, <a name=x>none</a>, <a href=\"\">empty</a>, <a href=x href=y>twice</a></p>"
    "<p>zero &#00008217; &#x0002019; &#8217 &rarr; &#150; &#1114112; &#x110000; &nope; {p}</p>"
    "<main-nav><p>side {p}</p></main-nav><article-card>card {p}</article-card>"
    "<ul></ol><li>a<ol><li>one<li>two</ol></ul><br/><p>plain text that stays {p}</p>")
SLOPPY_ARTICLE = "</article></main><article><p>in {p}</article><p>out {p}</p>"


def sloppy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with sloppy forms put before its own HTML. Even pages lose their
    `article` (it becomes a `div`), odd ones have a second one before a stray closer."""
    p = tables.pages(spark, sf_dir)
    own = F.coalesce("html", F.lit(""))
    even = F.col("page_id") % 2 == 0
    return p.select("page_id", "url", F.concat(
        _fill(SLOPPY), F.when(even, F.regexp_replace(own, "<(/?)article", "<$1div")).otherwise(F.concat(_fill(SLOPPY_ARTICLE), own))).alias("html"))


# Ways to write a reference to a private host, and what only looks like one.
REFERENCES = (
    "<img src=\" http://10.0.0.{o}/a\"><img src=\"ht\ttp://10.0.0.{o}/d\"><img src=\"http&#58;//10.0.0.{o}/c\"><img src='http&colon;//10.0.1.{o}/c'>"
    "<img src=http://127.0.0.{o}/u><img src = \"http://192.168.0.{o}/s\"><img/src=//169.254.169.{o}/x><img alt=\"a>b\" src=\"http://10.6.0.{o}/q\">"
    "<source srcset=\"http://10.1.0.{o}/1.png, /ok/{p}.png 2x,data:image/png;base64,AA 3x\"><img srcset=/only/{p}.png>"
    "<script src=https:10.2.0.{o}/s.js>var a = '<img src=\"http://no.test/\">';</script><!--><img src='\\\\10.3.0.{o}\\b'><!-- <img src=\"http://10.9.0.1/\"> -->"
    "<p style=\"background:url('http://10.4.0.{o}/bg.png')\"><meta http-equiv=Refresh content=\"5; URL='http://10.5.0.{o}/next'\">"
    "<a href=\"http:/same/{p}\">s</a><a href=\"http:///10.7.0.{o}/\">t</a><a href='mailto:a@b'>m</a><video poster=p.png src></video>"
    "<a href=\"http://n.test\\@10.8.0.{o}/\">h</a><textarea><img src=http://no.test/></textarea><A HREF=http://8.8.8.{o}/z\f>z</A>")


def resource_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with references in many spellings put before its own HTML, and for
    page_id % 5 = 0 a base of its own before them."""
    p = tables.pages(spark, sf_dir)
    base = F.when(F.col("page_id") % 5 == 0, _fill("<BASE target=_top><base href='/base/{p}/?q'><base href=//later.test/>")).otherwise(F.lit(""))
    return p.select("page_id", "url", F.concat(base, _fill(REFERENCES), F.coalesce("html", F.lit(""))).alias("html"))


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 work list: the page URLs, with every tenth page (page_id % 10 = 5)
    replaced by a literal-address, bad-scheme, no-host or odd-port URL built
    from its page_id, and some URLs listed twice (page_id + 100,000,000 for
    page_id % 25 in 3 and 5). Options default to the reference's tool defaults."""
    p = tables.pages(spark, sf_dir).select("page_id", "url")
    pid = F.col("page_id")
    k = (pid / 10).cast("long") % 10
    octet = (pid % 256).cast("string")
    synthetic = (
        F.when(k == 0, F.concat(F.lit("http://127.0.0."), octet, F.lit("/")))
        .when(k == 1, F.concat(F.lit("http://10."), octet, F.lit(".0.1/admin")))
        .when(k == 2, F.concat(F.lit(" http://8.8."), octet, F.lit("\t.8/")))
        .when(k == 3, F.concat(F.lit("ftp://files"), pid.cast("string"), F.lit(".example/")))
        .when(k == 4, F.concat(F.lit("http://"), (F.lit(2130706433) + pid % 256).cast("string"), F.lit("/")))
        .when(k == 5, F.concat(F.lit("http://0x"), F.lower(F.hex(F.lit(167772160) + pid)), F.lit("/")))
        .when(k == 6, F.concat(F.lit("http://[::ffff:192.168.0."), octet, F.lit("]/")))
        .when(k == 7, F.concat(F.lit("http:///nohost"), pid.cast("string")))
        .when(k == 8, F.concat(F.lit("https://user@169.254.169."), octet, F.lit(":000"), (F.lit(8443) + pid % 3).cast("string"), F.lit("/")))
        .otherwise(F.concat(F.lit("http://[2606:4700:4700::"), (pid % 1000).cast("string"),
                            F.lit("]:"), (pid * 37).cast("string"), F.lit("/"))))
    listed = p.select("page_id", F.when(pid % 10 == 5, synthetic).otherwise(F.col("url")).alias("url"))
    again = listed.where((pid % 25).isin(3, 5)).select((pid + 100_000_000).alias("page_id"), "url")
    return listed.unionByName(again).select(
        "page_id", "url",
        F.lit("domcontentloaded").alias("wait_until"),
        F.lit(60000).alias("timeout_ms"),
        F.lit(True).alias("headless"),
        F.lit(5000).alias("poll_budget_ms"),
        F.lit(250).alias("poll_interval_ms"))


def _quad(v: "F.Column") -> "F.Column":
    return F.concat_ws(".", *[(F.shiftright(v, n) % 256).cast("string") for n in (24, 16, 8, 0)])


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name resolution captured as data: (host, pos, ip) per page host.

    Rule on d = md5(host): 'f...' no row (lookup fails); 'e...' one row with
    null ip (empty answer); otherwise pos 0 from md5(host || ':0') and pos 1
    a 10.x address for '0'-'3', a link-local IPv6 for '4', else from
    md5(host || ':1').
    """
    from pagemark.functions.urls import host as url_host
    hosts = tables.pages(spark, sf_dir).select(url_host(F.col("url")).alias("host")).distinct()
    d = F.md5("host")
    first = F.substring(d, 1, 1)

    def ip_from(tag):
        return _quad(F.conv(F.substring(F.md5(F.concat("host", F.lit(tag))), 1, 8), 16, 10).cast("long"))

    pos0 = F.struct(F.lit(0).alias("pos"), F.when(first == "e", F.lit(None).cast("string"))
                    .otherwise(ip_from(":0")).alias("ip"))
    pos1 = F.struct(F.lit(1).alias("pos"),
                    F.when(first.isin("0", "1", "2", "3"),
                           F.concat(F.lit("10."), (F.conv(F.substring(d, 2, 2), 16, 10)).cast("string"),
                                    F.lit(".0.7")))
                    .when(first == "4", F.concat(F.lit("fe80::"), F.substring(d, 5, 4)))
                    .otherwise(ip_from(":1")).alias("ip"))
    rows = F.when(first == "e", F.array(pos0)).otherwise(F.array(pos0, pos1))
    return (hosts.where(first != "f")
            .select("host", F.inline(rows)))


def address_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5-B9 inputs from events: per event one IPv4 text, one IPv6 text
    (prefix chosen by event_id % 8) and one integer/hex form."""
    ev = tables.table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id")
    v4n = (eid * F.lit(2654435761)) % F.lit(4294967296)
    d = F.md5(eid.cast("string"))
    g = [F.substring(d, 1 + 4 * i, 4) for i in range(8)]
    k = eid % 8
    v6 = (F.when(k == 0, F.concat(F.lit("::ffff:"), _quad(v4n)))
          .when(k == 1, F.concat(F.lit("2002:"), g[0], F.lit(":"), g[1], F.lit("::"), g[2]))
          .when(k == 2, F.concat(F.lit("2001:0:"), g[0], F.lit(":"), g[1], F.lit("::"), g[2], F.lit(":"), g[3]))
          .when(k == 3, F.concat(F.lit("fe80::"), g[0], F.lit(":"), g[1]))
          .when(k == 4, F.concat(F.lit("fc00:"), g[0], F.lit("::"), g[1]))
          .when(k == 5, F.concat(F.lit("ff02::"), g[0]))
          .when(k == 6, F.concat(F.lit("::"), g[0], F.lit(":"), g[1]))
          .otherwise(F.concat_ws(":", *g)))
    j = eid % 4
    num = (F.when(j == 0, v4n.cast("string"))
           .when(j == 1, F.concat(F.lit("0x"), F.lower(F.hex(v4n))))
           .when(j == 2, F.concat(F.conv(F.substring(d, 1, 15), 16, 10),
                                  F.lpad(F.conv(F.substring(d, 16, 10), 16, 10), (eid % 23).cast("int"), "0")))
           .otherwise(F.concat(F.lit("0x"), d.substr(F.lit(1), F.lit(8) + (eid % 25).cast("int")))))
    # One select a form: a filter on the form leaves out the others before their texts are made.
    forms = [ev.select("event_id", F.lit(form).alias("form"), text.alias("text")) for form, text in (("v4", _quad(v4n)), ("v6", v6), ("int", num))]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range table of more blocks than a CASE could hold: per order line a block of 12
    to 32 bits at a place given by its key, and around every event's address four
    nested ones: (cidr, label)."""
    li = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    base = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) * F.lit(2654435761) % F.lit(4294967296)
    own = li.select(F.concat(_quad(base), F.lit("/"), (F.lit(12) + (F.col("l_orderkey") + F.col("l_linenumber")) % 21).cast("string")).alias("cidr"),
                    F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("label"))
    ev = tables.table(spark, sf_dir, "events").select("event_id", _quad((F.col("event_id") * F.lit(2654435761)) % F.lit(4294967296)).alias("base"))
    around = ev.select("event_id", "base", F.explode(F.array(*[F.lit(x) for x in (16, 20, 25, 31)])).alias("bits"))
    near = around.select(F.concat(F.col("base"), F.lit("/"), F.col("bits").cast("string")).alias("cidr"),
                         F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("label"))
    return own.unionByName(near)


WAIT_UNTIL = ("load", "domcontentloaded", "networkidle", "commit")


def _captures(pages: DataFrame, flicker, headed: str) -> DataFrame:
    """Render captures of (page_id, url, body): polls 0-7 every 250 ms; nothing
    while poll < page_id % 3, then the body grows by equal parts a poll until it
    is whole at poll page_id % 6. Odd pages also have a finer capture 120 ms
    after each poll; pages with page_id % 4 = 0 also have headed captures."""
    pid = F.col("page_id")
    polls = pages.select("page_id", "url", "body", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("poll"))
    shown = F.when(F.col("poll") < pid % 3, F.lit(None).cast("string")).otherwise(
        F.col("body").substr(F.lit(1), F.ceil(
            F.length("body") * F.least(F.col("poll") + 1, pid % 6 + 1) / (pid % 6 + 1)).cast("int")))
    base = polls.select("page_id", "url", "poll", (F.col("poll") * 250).cast("long").alias("elapsed_ms"),
                        F.lit("headless").alias("capture_mode"), shown.alias("shown"))
    fine = base.where(pid % 2 == 1).select(
        "page_id", "url", "poll", (F.col("elapsed_ms") + 120).alias("elapsed_ms"), "capture_mode",
        flicker(F.col("poll").cast("string")).alias("shown"))
    other = base.where(pid % 4 == 0).select(
        "page_id", "url", "poll", "elapsed_ms", F.lit("headed").alias("capture_mode"),
        F.concat(F.col("shown"), F.lit(headed)).alias("shown"))
    return base.unionByName(fine).unionByName(other).select("page_id", "url", "elapsed_ms", "capture_mode", "shown")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 render captures whose content is extracted already: (url, elapsed_ms,
    capture_mode, md), the growing body text of each page."""
    p = tables.pages(spark, sf_dir).select(
        "page_id", "url", F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "").alias("body"))
    return _captures(p, lambda k: F.concat(F.lit("flicker "), k), " (headed)").withColumnRenamed("shown", "md")


def snapshot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 render captures as HTML: (url, elapsed_ms, capture_mode, html, error). The
    headless render of page_id % 13 = 4 breaks off after 500 ms with an error."""
    p = tables.pages(spark, sf_dir).select("page_id", "url", F.coalesce("html", F.lit("")).alias("body"))
    shown = _captures(p, lambda k: F.concat(F.lit("<p>flicker "), k, F.lit("</p>")), "<p>headed</p>").withColumnRenamed("shown", "html")
    broken = p.where(F.col("page_id") % 13 == 4).select(
        "page_id", "url", F.lit(500).cast("long").alias("elapsed_ms"), F.lit("headless").alias("capture_mode"), F.lit(None).cast("string").alias("html"),
        F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" closed")).alias("error"))
    return shown.withColumn("error", F.lit(None).cast("string")).unionByName(broken)


def render_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render-tier options and navigation timings per page URL: wait_until by
    page_id % 4, timeout 30000 ms, budget 250 * (2 + page_id % 7) ms, and the
    captured ready time per wait_until (n, 2n, 4n, 8n; n = page_id*131 % 20000)."""
    p = tables.pages(spark, sf_dir).select("page_id", "url")
    pid = F.col("page_id")
    n = (pid * 131) % 20000
    return p.select(
        "page_id", "url",
        F.element_at(F.array(*[F.lit(w) for w in WAIT_UNTIL]), (pid % 4 + 1).cast("int")).alias("wait_until"),
        F.lit(30000).cast("long").alias("timeout_ms"),
        F.lit(True).alias("headless"),
        (F.lit(250) * (pid % 7 + 2)).cast("long").alias("poll_budget_ms"),
        F.lit(250).cast("long").alias("poll_interval_ms"),
        F.create_map(F.lit("commit"), n, F.lit("domcontentloaded"), n * 2,
                     F.lit("load"), n * 4, F.lit("networkidle"), n * 8).alias("nav_ms"))


def some_render_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``render_requests`` in which pages with page_id % 17 = 6 have none: the cascade
    gives those URLs the default options."""
    return render_requests(spark, sf_dir).where(F.col("page_id") % 17 != 6)


SHELL_STUB = ("<html><head><title>Board</title></head><body><main id=\"mount\">"
              "<p>This board draws itself with javascript; switch it on.</p></main></body></html>")
SHELL_PAD = "<script src=\"/static/chunk.js\"></script>"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 captured HTTP responses keyed by request URL.

    Page p redirects to page p+1 (p % 50 = 49: back to p-2) unless p % 9 = 8;
    the Location is absolute (p % 3 = 0), scheme-relative (1) or a same-host
    `/moved/<p>` path (2) whose own response redirects on to the target.
    p % 41 = 0 answers 302 without a Location. Final pages: 404 for p % 20 = 0,
    500 for 1, else 200; native Markdown when p % 7 = 0 (empty when p % 14 = 0);
    a JavaScript shell body when p % 11 = 0 (padded past 5,000 characters when
    p % 22 = 0); connect error when p % 43 = 0; elapsed_ms = p * 37 % 11000.
    """
    p = tables.pages(spark, sf_dir).select("page_id", "url", "html")
    pid = F.col("page_id")
    tgt = p.select(F.col("page_id").alias("t_id"), F.col("url").alias("t_url"))
    nxt = F.when(pid % 50 == 49, pid - 2).otherwise(pid + 1)
    j = p.join(tgt, (nxt == F.col("t_id")) & (pid % 9 != 8), "left")
    redirects = F.col("t_url").isNotNull() & (pid % 41 != 0)
    origin = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    moved = F.concat(F.lit("/moved/"), pid.cast("string"))
    location = (F.when(pid % 3 == 0, F.col("t_url"))
                .when(pid % 3 == 1, F.expr("substring(t_url, instr(t_url, ':') + 1)"))
                .otherwise(moved))
    md_body = F.when(pid % 14 == 0, F.lit("")).otherwise(
        F.concat(F.lit("# Page "), pid.cast("string"), F.lit("\n\nServed as Markdown.")))
    pad = F.expr(f"repeat('{SHELL_PAD}', 200)")
    body = (F.when(pid % 7 == 0, md_body)
            .when(pid % 22 == 0, F.concat(pad, F.lit(SHELL_STUB)))
            .when(pid % 11 == 0, F.lit(SHELL_STUB))
            .otherwise(F.col("html")))
    status = (F.when(redirects, F.element_at(F.array(*[F.lit(s) for s in (301, 302, 303, 307, 308)]),
                                             (pid % 5 + 1).cast("int")))
              .when((pid % 41 == 0) & F.col("t_url").isNotNull(), F.lit(302))
              .when(pid % 20 == 0, F.lit(404)).when(pid % 20 == 1, F.lit(500)).otherwise(F.lit(200)))
    ctype = F.when(~redirects & (pid % 7 == 0), F.lit("text/markdown; charset=utf-8")).otherwise(F.lit("text/html"))
    err = pid % 43 == 0
    main = j.select(
        "page_id", "url",
        F.when(err, F.lit(None).cast("int")).otherwise(status).alias("status"),
        F.when(err, F.lit(None).cast("map<string,string>")).otherwise(
            F.when(pid % 2 == 0, F.create_map(F.lit("content-type"), ctype, F.lit("location"), F.when(redirects, location)))
            .otherwise(F.create_map(F.lit("Content-Type"), ctype, F.lit("LOCATION"), F.when(redirects, location))))
        .alias("headers"),
        F.when(err | redirects, F.lit("")).otherwise(body).alias("body"),
        ((pid * 37) % 11000).cast("long").alias("elapsed_ms"),
        F.when(err, F.lit("connect error")).alias("error"))
    second = j.where(redirects & (pid % 3 == 2)).select(
        "page_id", F.concat(origin, moved).alias("url"), F.lit(308).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("location"), F.col("t_url")).alias("headers"),
        F.lit("").alias("body"), ((pid * 37 + 1) % 11000).cast("long").alias("elapsed_ms"),
        F.lit(None).cast("string").alias("error"))
    return main.unionByName(second)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 request log from events: (id, ts, scope_type, path, query_string,
    headers ARRAY<STRUCT<name, value>>, client_ip).

    Rules: websocket scope when event_id % 97 = 0; path `/.well-known/x` for
    signups, `/.well-known` when event_id % 31 = 0, `/.well-knownx` when
    event_id % 37 = 0, else `/mcp`; query `key=k<user_id % 9>&v=<event_id>`
    (blank key first when event_id % 13 = 0, no key when % 17 = 0, an
    encoded non-key when % 19 = 0); identity headers by user_id % 5; a Host
    header (`evil.example` for user_id % 10 = 3); no peer when user_id % 50 = 7.
    """
    ev = events(spark, sf_dir)
    eid, uid = F.col("event_id"), F.col("user_id")
    key = F.concat(F.lit("key=k"), (uid % 9).cast("string"))
    v = F.concat(F.lit("v="), eid.cast("string"))
    query = (F.when(eid % 13 == 0, F.concat(F.lit("key=&"), key, F.lit("&"), v))
             .when(eid % 17 == 0, v)
             .when(eid % 19 == 0, F.concat(F.lit("key=a+b%20c&"), v))
             .when(eid % 23 == 0, F.concat(F.lit("k%65y=k"), (uid % 9).cast("string"), F.lit("&"), v))
             .when(eid % 29 == 0, F.concat(F.lit("key=a+b%zz&"), v))
             .otherwise(F.concat(key, F.lit("&"), v)))
    path = (F.when(F.col("event_type") == "signup", "/.well-known/x")
            .when(eid % 31 == 0, "/.well-known").when(eid % 37 == 0, "/.well-knownx").otherwise("/mcp"))
    octet = (uid % 256).cast("string")

    def h(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    host = h("Host", F.when(uid % 10 == 3, F.lit("evil.example")).when(uid % 10 == 4, F.lit("[::1]:8787")).otherwise(F.lit("localhost:8787")))
    ident = (F.when(uid % 5 == 0, F.array(host, h("CF-Connecting-IP", F.concat(F.lit("203.0.113."), octet))))
             .when(uid % 5 == 1, F.array(host, h("X-Forwarded-For",
                                                 F.concat(F.lit("198.51.100."), octet, F.lit(", 10.0.0.1")))))
             .when(uid % 5 == 2, F.array(host, h("x-forwarded-for", F.lit("")),
                                         h("X-Forwarded-For", F.concat(F.lit(" 192.0.2."), octet))))
             .otherwise(F.array(host)))
    peer = F.when(uid % 50 == 7, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("10.1."), octet, F.lit("."), ((uid / 256).cast("long") % 256).cast("string")))
    return ev.select(
        eid.alias("id"), "ts",
        F.when(eid % 97 == 0, F.lit("websocket")).otherwise(F.lit("http")).alias("scope_type"),
        path.alias("path"), query.alias("query_string"), ident.alias("headers"), peer.alias("client_ip"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir)


# --- fixed values: key file versions (A4 lines, L7 load times) ---------------
KEY_FILE_VERSIONS = (
    ("2024-01-01 00:00:00", ["k0", " k1 ", "", "# retired", "k2", "  # k9", "k3", "k4", "k0"]),
    ("2024-01-15 00:00:00", ["# rotated", "k3", "k4", "k5 ", "", "k6", "k7"]),
)
ALLOWED_HOSTS_OPTION = "127.0.0.1, localhost,,[::1]"


def key_lines(spark: SparkSession) -> DataFrame:
    """Raw key-file lines per version: (loaded_at TIMESTAMP, line_no, line)."""
    rows = [(ts, i, line) for ts, lines in KEY_FILE_VERSIONS for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "loaded_at string, line_no int, line string")
    return df.withColumn("loaded_at", F.to_timestamp("loaded_at"))


def dense_key_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key file reloaded at every purchase: (loaded_at, key), thousands of versions."""
    ev = events(spark, sf_dir).where("event_type = 'purchase'")
    return ev.select(F.col("ts").alias("loaded_at"), F.concat(F.lit("k"), (F.col("event_id") % 9).cast("string")).alias("key"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L11 input: one access-log record per event, message plus arguments."""
    ev = tables.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    eid, uid = F.col("event_id"), F.col("user_id")
    msg = (F.when(eid % 5 == 0, F.concat(F.lit("key="), uid.cast("string"), F.lit(" at line start")))
           .otherwise(F.concat(F.lit("GET /mcp?key="), uid.cast("string"), F.lit("&v="), eid.cast("string"))))
    args = F.array(F.concat(F.lit("/mcp?v=1&key=s"), uid.cast("string")), F.col("event_type"),
                   F.concat(F.lit("x?key="), eid.cast("string"), F.lit(" y")))
    return ev.select(eid.alias("id"), msg.alias("msg"), args.alias("args"))


def sparse_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of many hosts, each rare, at four times eight days apart: (id, host, port, ts)."""
    ev = events(spark, sf_dir)
    slot = F.least(F.floor((F.unix_seconds("ts") - 1704067200) / 691200), F.lit(3))
    return ev.select(
        F.col("event_id").alias("id"), F.concat(F.lit("h"), (F.col("event_id") * 7919 % 3571).cast("string"), F.lit(".example")).alias("host"),
        F.when(F.col("event_type").isin("purchase", "signup"), 443).otherwise(80).alias("port"),
        F.timestamp_seconds(slot * 691200 + 1704067200).alias("ts"))


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B14 input: host+port lookups from events (host by user_id % 58, port
    443 for purchases and signups, else 80)."""
    ev = events(spark, sf_dir)
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("h"), (F.col("user_id") % 58).cast("string"), F.lit(".example")).alias("host"),
        F.when(F.col("event_type").isin("purchase", "signup"), 443).otherwise(80).alias("port"),
        "ts")
