"""Registered queries of J5 (page to Markdown) and J6 (size report)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemark.operators import blocks as B
from pagemark.operators import markdown as M
from pagemark.functions.urls import resolve
from pagemark.plans import oracle_blocks as O
from pagemark.session import cut_lineage
from pagemark.sources import tables
from pagemark.sources.derived import SLOPPY, SLOPPY_ARTICLE, nested_pages, region_table_pages, sloppy_pages, supplier_table_pages

PAGES_SQL = "SELECT page_id, url, html FROM pages"


def _tokens(spark, sf_dir):
    return B.page_tokens(tables.pages(spark, sf_dir))


def q_page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of pages with sloppy forms; attributes as sorted lines."""
    t = B.page_tokens(sloppy_pages(spark, sf_dir)).where(F.col("pos").isNotNull())
    lines = F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), "tag", F.array_join(lines, "\n").alias("attrs"), "text")


def q_region_depth(spark, sf_dir):
    """D3 on pages with sloppy forms."""
    t = B.region_depth(B.page_tokens(sloppy_pages(spark, sf_dir))).where(F.col("pos").isNotNull())
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), "tag",
                    *[F.col(f"{n}_depth").cast("long").alias(f"{n}_depth") for n in
                      ("chrome", "main", "pre", "tbl", "quote", "link")])


def q_tag_intervals(spark, sf_dir):
    """D4 on pages with sloppy forms: every opener that may have a closer."""
    t = B.tag_intervals(B.page_tokens(sloppy_pages(spark, sf_dir)))
    return t.where(F.col("level").isNotNull() & ~F.col("tag").startswith("/")).select(
        "page_id", F.col("pos").cast("long").alias("open_pos"), "tag",
        F.col("close_pos").cast("long").alias("close_pos"),
        F.col("level").cast("long").alias("level"), "is_ad")


def q_page_blocks(spark, sf_dir):
    b = B.page_blocks(_tokens(spark, sf_dir))
    return b.select("page_id", F.col("block_no").cast("long").alias("block_no"), "tag", "text",
                    F.col("link_chars").cast("long").alias("link_chars"))


def q_page_links(spark, sf_dir):
    """Every link of every page, resolved against the requested URL."""
    t = B.page_tokens(sloppy_pages(spark, sf_dir)).withColumn("href", B.link_ref(F.col("tag"), F.col("head")))
    links = t.where((F.col("tag") == "a") & (F.col("href") != ""))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"),
                        "href", resolve(F.col("url"), F.col("href")).alias("target"),
                        F.trim(B.H.collapse_ws(B.H.decode_entities(F.col("text")))).alias("link_text"))


def _md_blocks(spark, sf_dir):
    return B.block_markdown(B.page_blocks(_tokens(spark, sf_dir)))


def q_block_markdown(spark, sf_dir):
    return _md_blocks(spark, sf_dir).where(F.col("md") != "").select(
        "page_id", F.col("block_no").cast("long").alias("block_no"), "tag", "md")


def q_table_markdown(spark, sf_dir):
    """D9 on pages built from the region, nation and supplier tables (one table each)."""
    pages = region_table_pages(spark, sf_dir).unionByName(supplier_table_pages(spark, sf_dir))
    return M.page_markdown(pages, scope="none").select("page_id", "url", "markdown")


def q_nested_markdown(spark, sf_dir):
    """D1, D2, D6-D8, D10 on pages with nested, loose and empty forms."""
    blocks = B.block_markdown(B.page_blocks(B.page_tokens(nested_pages(spark, sf_dir))))
    return blocks.where(F.col("md") != "").select("page_id", F.col("block_no").cast("long").alias("block_no"), "tag", "md")


def q_sloppy_markdown(spark, sf_dir):
    """D1-D14 on pages with sloppy forms."""
    return M.page_markdown(sloppy_pages(spark, sf_dir)).select("page_id", "url", "markdown")


def q_block_features(spark, sf_dir):
    f = B.block_features(_md_blocks(spark, sf_dir))
    return f.select("page_id", F.col("block_no").cast("long").alias("block_no"), "tag",
                    F.col("chars").cast("long").alias("chars"),
                    F.col("link_chars").cast("long").alias("link_chars"),
                    "in_main", "in_chrome", "in_ad", "is_heading", "block_hash")


def q_boilerplate_blocks(spark, sf_dir):
    f = B.block_features(_md_blocks(spark, sf_dir))
    return B.boilerplate_blocks(f).select("block_hash", F.col("n_pages").cast("long").alias("n_pages"))


def q_host_boilerplate(spark, sf_dir):
    """D12 by host: normalised texts on at least two pages of a host."""
    f = B.block_features(_md_blocks(spark, sf_dir))
    return B.host_boilerplate(f, 2).select("host", "text_hash", F.col("n_pages").cast("long").alias("n_pages"))


def q_kept_by_host(spark, sf_dir):
    """D13 without what a host repeats."""
    k = B.kept_blocks(cut_lineage(_md_blocks(spark, sf_dir)), scope="host", min_pages=2)
    return k.select("page_id", F.col("block_no").cast("long").alias("block_no"), "md")


def q_kept_blocks(spark, sf_dir):
    # The block table feeds the boilerplate count and the keep rule: written once.
    k = B.kept_blocks(cut_lineage(_md_blocks(spark, sf_dir)), scope="all")
    return k.select("page_id", F.col("block_no").cast("long").alias("block_no"), "md")


def q_page_markdown(spark, sf_dir):
    return M.page_markdown(tables.pages(spark, sf_dir)).select("page_id", "url", "markdown")


def per_page_saving(spark, sf_dir):
    return M.size_saving(M.page_markdown(tables.pages(spark, sf_dir)))


def q_size_saving(spark, sf_dir):
    return M.saving_by_host(per_page_saving(spark, sf_dir))


def flagship(spark, sf_dir):
    """entry(): Markdown and size saving per page."""
    return M.size_saving(M.page_markdown(tables.pages(spark, sf_dir))).select(
        "page_id", "url", "markdown", "html_chars", "md_chars", "saving_pm")


QUERIES = {
    "page_tokens": q_page_tokens,
    "region_depth": q_region_depth,
    "tag_intervals": q_tag_intervals,
    "page_blocks": q_page_blocks,
    "page_links": q_page_links,
    "block_markdown": q_block_markdown,
    "table_markdown": q_table_markdown,
    "nested_markdown": q_nested_markdown,
    "sloppy_markdown": q_sloppy_markdown,
    "block_features": q_block_features,
    "boilerplate_blocks": q_boilerplate_blocks,
    "host_boilerplate": q_host_boilerplate,
    "kept_by_host": q_kept_by_host,
    "kept_blocks": q_kept_blocks,
    "page_markdown": q_page_markdown,
    "size_saving": q_size_saving,
}


def _w(body: str, scope: str = "outside_main", src: str = PAGES_SQL) -> str:
    return "WITH " + O.chain(src, scope).lstrip() + ("," if body.startswith("\nhost_texts") else "") + "\n" + body


REGION_PAGES_SQL = """
SELECT r.r_regionkey::BIGINT AS page_id,
  'https://tables.example/region/' || lower(r.r_name) AS url,
  '<html><body><article><h2>' || r.r_name || '</h2><table><tr><th>key</th><th>name</th></tr>'
  || string_agg('<tr><td>' || n.n_nationkey::VARCHAR || '</td><td>' || n.n_name || '</td></tr>', ''
                ORDER BY n.n_nationkey)
  || '</table></article></body></html>' AS html
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_regionkey, r.r_name
UNION ALL
SELECT s_nationkey::BIGINT + 100, 'https://tables.example/nation/' || s_nationkey,
  '<article><table><tr><td></td></tr><tr><th rowspan=2>key<th colspan=2>name|alias<th>&nbsp;</tr>' || string_agg(
    '<tr><td rowspan="' || (s_suppkey % 3) || '">' || s_suppkey || '</td><td colspan=' || (s_suppkey % 4) || '><p>' || s_name
    || '</p><ul><li>a|b</li></ul></td><td></td><td rowspan=2>r' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '</td></tr>' ELSE '<td>' END,
    '' ORDER BY s_suppkey) || '</table><p>below</p></article>'
FROM supplier GROUP BY s_nationkey"""

NESTED_PAGES_SQL = """
SELECT page_id, url, 'Lead it&#8217;s &mdash; caf&eacute; &#xE9;&unknown;&#0; ' || page_id
  || '<p><a href="../n/./' || page_id || '/../m?x=1"><b>bold</b> link ' || page_id
  || '</a> and <b>a <i> b </i></b>, <i>open ' || page_id
  || '</p><ol><li>one<ul><li>in</li><li>out</li></ul></li><li>two <code>x < y</code></li></ol>'
  || '<p><a href="/e"><img src="i.png"></a>x<b> </b><b><i></i></b> y <em></p>' || coalesce(html, '')
  || CASE WHEN page_id % 3 = 0 THEN '<p>end</p><script>var x = ''<p>no</p>'';' ELSE '' END AS html
FROM pages"""

def _sql_text(text: str) -> str:
    return "replace(replace(" + O.q(text) + ", '{p}', page_id::VARCHAR), '{o}', (page_id % 256)::VARCHAR)"


SLOPPY_PAGES_SQL = f"""
SELECT page_id, url, {_sql_text(SLOPPY)} || CASE WHEN page_id % 2 = 0 THEN regexp_replace(coalesce(html, ''), '<(/?)article', '<\\1div', 'g')
  ELSE {_sql_text(SLOPPY_ARTICLE)} || coalesce(html, '') END AS html FROM pages"""

ORACLE = {
    "page_tokens": _w(f"""SELECT page_id, pos::BIGINT AS pos, tag, coalesce(attrs, '') AS attrs, text FROM page_tokens LEFT JOIN
  (SELECT page_id, pos, string_agg(n || '=' || v, chr(10) ORDER BY n || '=' || v) AS attrs
   FROM {O.attr_rows_sql('page_tokens', 'page_id, pos')} GROUP BY page_id, pos) USING (page_id, pos)""", src=SLOPPY_PAGES_SQL),
    "region_depth": _w("SELECT page_id, pos::BIGINT AS pos, tag, chrome_depth::BIGINT AS chrome_depth,"
                       " main_depth::BIGINT AS main_depth, pre_depth::BIGINT AS pre_depth,"
                       " tbl_depth::BIGINT AS tbl_depth, quote_depth::BIGINT AS quote_depth,"
                       " link_depth::BIGINT AS link_depth FROM region_depth", src=SLOPPY_PAGES_SQL),
    "tag_intervals": "WITH " + O.chain(SLOPPY_PAGES_SQL).lstrip() + "," + O.INTERVALS + """
SELECT page_id, pos::BIGINT AS open_pos, tag, close_pos::BIGINT AS close_pos, level::BIGINT AS level, is_ad FROM intervals""",
    "sloppy_markdown": _w("SELECT page_id, url, markdown FROM page_markdown", src=SLOPPY_PAGES_SQL),
    "page_blocks": _w("SELECT page_id, block_no::BIGINT AS block_no, tag, text,"
                      " link_chars::BIGINT AS link_chars FROM page_blocks"),
    "page_links": _w("SELECT page_id, pos::BIGINT AS pos, href, " + O.resolve_sql("url", "href")
                     + " AS target, trim(" + O.collapse_sql(O.decode_sql("text")) + ") AS link_text"
                     " FROM annotated WHERE tag = 'a' AND href <> ''", src=SLOPPY_PAGES_SQL),
    "block_markdown": _w("SELECT page_id, block_no::BIGINT AS block_no, tag, md FROM block_markdown"
                         " WHERE md <> ''"),
    "table_markdown": _w("SELECT page_id, url, markdown FROM page_markdown", scope="none",
                         src=REGION_PAGES_SQL),
    "nested_markdown": _w("SELECT page_id, block_no::BIGINT AS block_no, tag, md FROM block_markdown WHERE md <> ''", src=NESTED_PAGES_SQL),
    "block_features": _w("SELECT page_id, block_no::BIGINT AS block_no, tag, chars::BIGINT AS chars,"
                         " link_chars::BIGINT AS link_chars, in_main, in_chrome, in_ad, is_heading,"
                         " block_hash FROM block_features"),
    "boilerplate_blocks": _w("SELECT block_hash, n_pages::BIGINT AS n_pages FROM boilerplate_blocks"),
    "kept_blocks": _w("SELECT page_id, block_no::BIGINT AS block_no, md FROM kept_blocks", scope="all"),
    "host_boilerplate": _w(O.HOST_REPEATS + "SELECT host, text_hash, n_pages::BIGINT AS n_pages FROM host_repeats"),
    "kept_by_host": _w(O.HOST_REPEATS + """SELECT page_id, block_no::BIGINT AS block_no, md FROM candidates c
WHERE NOT EXISTS (SELECT 1 FROM host_repeats h JOIN host_texts t ON t.host = h.host AND t.text_hash = h.text_hash
                  WHERE t.page_id = c.page_id AND t.block_no = c.block_no)"""),
    "page_markdown": _w("SELECT page_id, url, markdown FROM page_markdown"),
    "size_saving": "WITH " + O.chain(PAGES_SQL).lstrip() + "," + O.saving_by_host_sql("size_saving"),
}
