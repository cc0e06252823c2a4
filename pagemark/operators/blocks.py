"""Page to block table to Markdown (D1-D14), as one relational job.

Plan shape: pages are cleaned (D1) and hash-partitioned by ``page_id`` once, into as
many partitions as their texts need, since a task holds some forty times its
HTML in sorted tokens; the token explode keeps that partitioning, so every window below (partition
keys all start with ``page_id``) and the block aggregation reuse it without
another exchange. The only other shuffle is the corpus-wide boilerplate
count (D12), keyed by block hash with map-side partial aggregation.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemark.functions import html as H
from pagemark.functions.urls import host, resolve, trimmed
from pagemark.session import partitions_for


# Tags of inline marks, links among them.
INLINE = tuple(name for name, _ in H.MARKS) + ("a",)


CELLS = ("td", "th")


def _span(head, name: str, most: int):
    """A span attribute, 1 when it has none or no number, at most ``most`` (HTML's bound);
    a rowspan of 0 reaches to the end of the table."""
    def number(text):
        n = F.regexp_extract(text, "^[ \t\r\n\f]*[+]?0*([0-9]+)", 1)
        return (F.when(n == "", 1).when(F.length(n) > 5, most).when(n == "0", most if name == "rowspan" else 1)
                .otherwise(F.least(n.try_cast("int"), F.lit(most))))

    value = F.transform(F.array(H.attribute(head, name, decoded=False)), number)[0]
    return F.when(F.lower(head).contains(name), F.coalesce(value, F.lit(1))).otherwise(1)


def _solid(text):
    """Text without white space: what decides whether a mark has content."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), H.WS_RE, "")


def _running(*keys):
    return (Window.partitionBy(*keys).orderBy("pos")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def page_tokens(pages: DataFrame) -> DataFrame:
    """D1 + D2: drop non-content regions, then one row per tag token.

    Output: page_id, url, html_chars, pos (0-based), tag (lower-case whole name, `/`
    for closers), head (the tag text), attrs (map of an opener's attributes), text
    (text after the tag up to the next `<`). Text before the first tag is a token
    without a tag. An empty page still yields one row (pos null) so it keeps a place.
    """
    cleaned = (pages.select("page_id", "url", F.length(F.coalesce("html", F.lit(""))).alias("html_chars"),
                            H.content(F.col("html")).alias("html"))
               .repartition(partitions_for(pages, "html"), "page_id"))
    toks = cleaned.select(
        "page_id", "url", "html_chars",
        F.posexplode_outer(F.regexp_extract_all("html", F.lit(H.TOKEN_RE), 0)).alias("pos", "tok"))
    head = F.regexp_extract("tok", H.TAG_TEXT_RE, 0)
    return toks.select(
        "page_id", "url", "html_chars", "pos",
        F.lower(F.regexp_extract("tok", H.TAG_RE, 1)).alias("tag"), head.alias("head"), H.attributes(head).alias("attrs"),
        F.substring("tok", F.length(head) + 1, 1 << 30).alias("text"))


def _sums(w):
    """Opens less closes up to here, for each region family."""
    return [F.sum(H.depth_delta(F.col("tag"), fam)).over(w).alias(f"{name}_sum") for name, fam in H.REGIONS.items()]


def _reflected(total: str, w):
    """Depth from a running sum: a closer without opener costs nothing, which is the sum
    less its least value so far (0 at most)."""
    return F.col(total) - F.least(F.min(total).over(w), F.lit(0))


def _depths(w):
    return [_reflected(f"{name}_sum", w).alias(f"{name}_depth") for name in H.REGIONS]


def region_depth(tokens: DataFrame) -> DataFrame:
    """D3: running depth of each region family; the opener is inside its region, the
    closer is not, a closer without opener changes nothing."""
    w = _running("page_id")
    return tokens.select("*", *_sums(w)).select(*tokens.columns, *_depths(w))


def tag_intervals(tokens: DataFrame) -> DataFrame:
    """Pair each opener with the closer of its tag at the same nesting level.

    Adds ``level`` (nesting among tags of that name; null for tags that have no closer,
    text and closers without opener), ``close_pos`` (paired closer of an opener;
    null when it never closes) and ``is_ad`` (a container with an advertising class).
    """
    tag = F.col("tag")
    name = F.regexp_replace("tag", "^/", "")
    own = _running("page_id", "_name")
    closer = tag.startswith("/")
    paired = (tag != "") & ~name.isin(*H.VOID_TAGS)
    t = tokens.select("*", name.alias("_name"), F.when(paired, F.when(closer, -1).otherwise(1)).otherwise(0).alias("_step"))
    t = t.withColumn("_sum", F.sum("_step").over(own)).withColumn("_depth", _reflected("_sum", own))
    # A closer without opener is where the sum reaches a new least value below 0.
    before = F.lag("_depth").over(Window.partitionBy("page_id", "_name").orderBy("pos"))
    level = F.when(paired, F.when(~closer, F.col("_depth")).when(F.coalesce(before, F.lit(0)) > 0, F.col("_depth") + 1))
    t = t.withColumn("level", level)
    mate = Window.partitionBy("page_id", "_name", "level").orderBy("pos")
    return t.select(
        *tokens.columns, "level",
        F.when(F.col("level").isNotNull() & ~closer & F.lead("tag").over(mate).startswith("/"), F.lead("pos").over(mate)).alias("close_pos"),
        H.is_ad(tag, F.col("head")).alias("is_ad"))


def annotate(tokens: DataFrame) -> DataFrame:
    """Token table with regions, ad intervals, block numbers, table counters and the
    nesting level of inline marks: running sums over (page, pos), their least values
    in the same order, the pairing of ad containers over (page, tag, level, pos),
    then the ad depth over (page, pos); all reuse the page partitioning."""
    w = _running("page_id")
    tag = F.col("tag")
    is_start = tag.isin(*H.BLOCK_TAGS) | tag.isin(*H.closers(H.BLOCK_TAGS))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(w)
    held = [c for c in tokens.columns if c != "attrs"]
    t = tokens.select(
        *held, *_sums(w), *[F.sum(H.depth_delta(tag, (name,))).over(w).alias(f"{name}_sum") for name in H.AD_TAGS],
        count(is_start).alias("block_no"),
        count(tag == "table").alias("table_no"),
        count(tag == "tr").alias("row_no"),
        # An opener and its closer share the level of their tag.
        F.coalesce(*[F.when(tag.isin(name, "/" + name), F.sum(
            F.when(tag == name, 1).when(tag == "/" + name, -1).otherwise(0)).over(w) + (tag == "/" + name).cast("int"))
            for name in INLINE]).alias("mark_level"),
        F.length(_solid(F.col("text"))).alias("solid_own"))
    at = lambda name: _reflected(f"{name}_sum", w) + (tag == "/" + name).cast("int")
    kept = [c for c in t.columns if not c.endswith("_sum")]
    t = t.select(*kept, *_depths(w), F.sum("solid_own").over(w).alias("solid"),
                 F.coalesce(*[F.when(tag.isin(name, "/" + name), F.concat_ws("#", F.lit(name), at(name))) for name in H.AD_TAGS]).alias("box"),
                 H.is_ad(tag, F.col("head")).alias("is_ad"))
    mate = Window.partitionBy("page_id", "box").orderBy("pos")
    ends = tag.startswith("/") & F.coalesce(F.lag("is_ad").over(mate), F.lit(False))
    t = t.withColumn("ad_delta", F.when(F.col("box").isNull(), 0).when(F.col("is_ad"), 1).when(ends, -1).otherwise(0))
    return t.withColumn("ad_depth", F.sum("ad_delta").over(w)).drop("ad_delta", "box", "is_ad")


def link_ref(tag, head):
    """What an `a` opener refers to, '' when nothing: references decoded, no blanks
    around it."""
    return F.coalesce(F.when(tag == "a", trimmed(H.attribute(head, "href"))), F.lit(""))


def render_tokens(t: DataFrame) -> DataFrame:
    """D6 + D7 + D10 at token level: decoded, collapsed text; an inline opener
    or closer puts its mark before the text that follows it. Pairs are found
    by tag and level inside a block; a pair without text is dropped, an
    opener without closer (``tail`` set) ends with its block. Text inside
    `pre` is kept raw."""
    tag = F.col("tag")
    raw = H.decode_entities(F.coalesce(F.col("text"), F.lit("")))
    t = t.select("*", raw.alias("raw"), link_ref(tag, F.col("head")).alias("href"),
                 F.regexp_replace("tag", "^/", "").alias("mark_tag"),
                 (F.col("solid") - F.col("solid_own")).alias("solid_before"))
    pair = Window.partitionBy("page_id", "block_no", "mark_tag", "mark_level").orderBy("pos")
    opens, closes = tag.isin(*INLINE), tag.isin(*H.closers(INLINE))
    t = t.select(
        "*", (opens & (F.lead("tag").over(pair) == F.concat(F.lit("/"), tag))).alias("paired"),
        F.lead("solid_before").over(pair).alias("solid_at_close"),
        (closes & (F.lag("tag").over(pair) == F.col("mark_tag")) & (F.lag("solid_before").over(pair) < F.col("solid_before"))).alias("ends"),
        F.lag("href").over(pair).alias("opened_href"))
    txt = H.collapse_ws(F.col("raw"))
    inner = F.trim(txt)
    mark = F.col("mark_tag")
    sign = F.coalesce(*[F.when(mark == name, sign) for name, sign in H.MARKS])
    link = lambda href: F.concat(F.lit("]("), resolve(F.col("url"), href), F.lit(")"))
    inline = (F.col("pre_depth") == 0) & ((mark != "a") | (F.coalesce(F.when(closes, F.col("opened_href")), F.col("href")) != ""))
    loose = inline & opens & ~F.coalesce("paired", F.lit(False))
    starts = inline & opens & F.coalesce(F.when(F.col("paired"), F.col("solid_at_close") > F.col("solid_before")), F.lit(True))
    ends = inline & F.coalesce("ends", F.lit(False))
    before = (F.when(starts, F.concat(F.when(mark == "a", "[").otherwise(sign), F.lit(H.OPEN)))
              .when(ends, F.concat(F.lit(H.CLOSE), F.when(mark == "a", link(F.col("opened_href"))).otherwise(sign)))
              .otherwise(F.lit("")))
    return t.select(
        "*", F.when(F.col("pre_depth") > 0, F.col("raw")).otherwise(F.concat(before, txt)).alias("piece"),
        F.when(loose, F.struct((-F.col("pos")).alias("order"), "solid_before", F.concat(
            F.lit(H.CLOSE), F.when(mark == "a", link(F.col("href"))).otherwise(sign)).alias("mark"))).alias("tail"),
        F.when(tag.isin(*CELLS), _span(F.col("head"), "colspan", 1000)).alias("span_cols"),
        F.when(tag.isin(*CELLS), _span(F.col("head"), "rowspan", 65534)).alias("span_rows"),
        F.when(F.col("link_depth") > 0, F.length(inner)).otherwise(0).alias("link_chars"),
        F.length(F.when(F.col("pre_depth") > 0, F.col("raw")).otherwise(txt)).alias("vis_chars"))


def _block_text(raw, tails, solid):
    """R4 at block level: loose marks closed (those without text removed), no
    white space inside marks, then white space collapsed and trimmed."""
    ws = H.WS_RE
    closed = F.concat(
        F.regexp_replace(raw, f"([*`\\[]+{H.OPEN}[ \t\r\n]*)+$", ""),
        F.array_join(F.transform(F.filter(F.array_sort(tails), lambda x: x["solid_before"] < solid), lambda x: x["mark"]), ""))
    marked = F.translate(F.regexp_replace(F.regexp_replace(closed, H.OPEN + ws, H.OPEN), ws + H.CLOSE, H.CLOSE), H.OPEN + H.CLOSE, "")
    return F.trim(H.collapse_ws(F.when(raw.contains(H.OPEN), marked).otherwise(raw)))


def page_blocks(tokens: DataFrame) -> DataFrame:
    """D5 (+D10): one row per (page, block) with its text and the state of its
    first token. Text is collapsed and trimmed outside `pre`."""
    r = render_tokens(annotate(tokens))
    first = lambda c: F.min_by(c, "pos")
    b = r.groupBy("page_id", "url", "block_no").agg(
        F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY pos)").alias("raw"),
        first("tag").alias("tag"),
        first("chrome_depth").alias("chrome_depth"),
        first("main_depth").alias("main_depth"),
        first("pre_depth").alias("pre_depth"),
        first("tbl_depth").alias("tbl_depth"),
        first("quote_depth").alias("quote_depth"),
        first("ad_depth").alias("ad_depth"),
        first("table_no").alias("table_no"),
        first("row_no").alias("row_no"),
        first("span_cols").alias("span_cols"),
        first("span_rows").alias("span_rows"),
        F.collect_list("tail").alias("tails"),
        F.max("html_chars").alias("html_chars"),
        F.max("solid").alias("solid"),
        F.sum("link_chars").alias("link_chars"),
        F.sum("vis_chars").alias("vis_chars"))
    raw = F.coalesce("raw", F.lit(""))
    text = F.when(F.col("pre_depth") > 0, raw).otherwise(_block_text(raw, F.col("tails"), F.col("solid")))
    return b.withColumn("text", text).drop("raw", "tails", "solid")


def list_state(blocks: DataFrame) -> DataFrame:
    """Innermost open list of each block: ``list_level``, ``list_kind`` (`ul` | `ol`)
    and ``list_no`` (its number at that level). List tags start blocks, so the
    block table holds them all."""
    tag = F.col("tag")
    order = Window.partitionBy("page_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.sum(H.depth_delta(tag, ("ul", "ol"))).over(order)
    at = (Window.partitionBy("page_id", "list_level").orderBy("block_no")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = blocks.withColumn("_list_sum", level).withColumn("list_level", _reflected("_list_sum", order)).drop("_list_sum")
    return b.withColumns({
        "list_kind": F.last(F.when(tag.isin("ul", "ol"), tag), True).over(at),
        "list_no": F.sum(F.when(tag.isin("ul", "ol"), 1).otherwise(0)).over(at)})


def _slots(cells):
    """A row's cells as grid places: text and rows of a cell, then empty ones for its
    other columns."""
    return F.flatten(F.transform(cells, lambda c: F.concat(
        F.array(F.struct(c["text"].alias("text"), c["rows"].alias("rows"))),
        F.array_repeat(F.struct(F.lit("").alias("text"), c["rows"].alias("rows")), c["cols"] - 1))))


def _let(value, use):
    """``use(value)`` with ``value`` computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _filled(slots, column):
    """The places that show something: ``col, text``; ``column(k)`` is where the k-th stands."""
    return F.filter(F.transform(slots, lambda s, k: F.struct(column(k).cast("int").alias("col"), s["text"].alias("text"))),
                    lambda c: c["text"] != "")


def table_lines(rows):
    """Array of rows (arrays of ``text, cols, rows``) to an array of lines: ``width``
    and ``cells`` (``col, text`` of the places that show something, by column). A cell
    stands in its first place; places that it spans are empty. What spans into the
    next rows is held as its column and the first row that is free of it; a row's own
    places fill the columns that are free. Work a row: its places and what is held."""
    def place(state, row):
        def at(x):
            held, slots, now = x["held"], x["slots"], F.size(state["lines"])
            places = F.size(held) + F.size(slots)
            free = F.slice(F.array_except(F.when(places > 0, F.sequence(F.lit(0), places - 1)).otherwise(F.expr("cast(array() as array<int>)")),
                                          F.transform(held, lambda h: h["col"])), 1, F.size(slots))
            return _let(free, lambda own: F.struct(
                F.concat(held, F.filter(
                    F.transform(slots, lambda s, k: F.struct(F.get(own, k).alias("col"), (now + s["rows"]).alias("until"))),
                    lambda h: h["until"] > now + 1)).alias("held"),
                F.greatest(state["width"], places).alias("width"),
                F.concat(state["lines"], F.array(F.struct(
                    F.greatest(state["width"], places).alias("width"), _filled(slots, lambda k: F.get(own, k)).alias("cells")))).alias("lines")))

        return _let(F.struct(F.filter(state["held"], lambda h: h["until"] > F.size(state["lines"])).alias("held"), _slots(row).alias("slots")), at)

    start = F.expr("named_struct('held', cast(array() as array<struct<col:int,until:int>>), 'width', 0,"
                   " 'lines', cast(array() as array<struct<width:int,cells:array<struct<col:int,text:string>>>>))")
    spanned = F.aggregate(rows, start, place, lambda s: s["lines"])
    plain = F.transform(rows, lambda r: _let(_slots(r), lambda slots: F.struct(
        F.size(slots).alias("width"), _filled(slots, lambda k: k).alias("cells"))))
    return F.when(F.exists(rows, lambda r: F.exists(r, lambda c: c["rows"] > 1)), spanned).otherwise(plain)


def _gap(cells, k):
    """Empty places between a line's k-th cell and the one before it."""
    return F.get(cells, k)["col"] - F.coalesce(F.get(cells, k - 1)["col"], F.lit(-1)) - 1


def _rest(line):
    """Empty places after a line's last cell."""
    return line["width"] - 1 - F.coalesce(F.try_element_at(line["cells"], F.lit(-1))["col"], F.lit(-1))


def table_grid(rows):
    """``table_lines`` with every place written out: an array of lines (arrays of texts)."""
    return F.transform(table_lines(rows), lambda line: F.concat(
        F.flatten(F.transform(line["cells"], lambda c, k: F.concat(F.array_repeat(F.lit(""), _gap(line["cells"], k)), F.array(c["text"])))),
        F.array_repeat(F.lit(""), _rest(line))))


def table_rows_markdown(rows):
    """Markdown of each row of a table, '' for those that show nothing; the header rule
    follows the first row that shows anything."""
    def row(line, is_header):
        cells = F.transform(line["cells"], lambda c, k: F.concat(F.repeat(F.lit("|  "), _gap(line["cells"], k)), F.lit("| "), c["text"], F.lit(" ")))
        text = F.concat(F.array_join(cells, ""), F.repeat(F.lit("|  "), _rest(line)), F.lit("|"))
        rule = F.when(is_header, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), line["width"]))).otherwise("")
        return F.when(F.size(line["cells"]) > 0, F.concat(text, rule)).otherwise("")

    headed = _let(table_lines(rows), lambda lines: F.struct(
        lines.alias("lines"), F.array_position(F.transform(lines, lambda x: F.size(x["cells"]) > 0), True).alias("header")))
    return _let(headed, lambda t: F.transform(t["lines"], lambda line, i: row(line, i + 1 == t["header"])))


def _cell_state(blocks: DataFrame) -> DataFrame:
    """``_cell`` (number of the table cell that a block lies in, null outside cells) and
    ``_opens`` (the block opens it). A cell reaches to its closer, the next cell or the
    end of its row."""
    tag = F.col("tag")
    order = Window.partitionBy("page_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = tag.isin(*CELLS) & (F.col("tbl_depth") > 0)
    turns = F.when(opens, True).when(tag.isin("tr", "table", *H.closers(("tr", "table", *CELLS))), False)
    inside = F.last(turns, True).over(order)
    return blocks.withColumns({
        "_opens": opens, "_cell": F.when(inside, F.sum(opens.cast("int")).over(order))})


def block_markdown(blocks: DataFrame) -> DataFrame:
    """D8 + D9: Markdown of each block. A table's cells, empty ones too, fold into one pipe
    row per `tr`, carried by the row's first cell (header rule after the first row
    that shows anything); other blocks of the row become empty. Cells hold the
    texts of all blocks inside them; `|` is escaped. All windows and groups are on the
    page partitioning, so this is one pass without a shuffle."""
    tag = F.col("tag")
    text = F.col("text")
    b = _cell_state(list_state(blocks))
    in_cell = F.col("_cell").isNotNull()
    # Blocks outside cells get a key of their own, so these windows only ever span the
    # blocks of one cell, the cells of one row, the rows of one table.
    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    cell_all = Window.partitionBy("page_id", F.when(in_cell, F.col("_cell")).otherwise(-F.col("block_no") - 1)).orderBy("block_no").rowsBetween(*everything)
    texts = F.array_join(F.filter(F.collect_list(F.when(in_cell, text)).over(cell_all), lambda t: t != ""), " ")
    b = b.withColumns({"_text": F.when(F.col("_opens"), F.replace(H.collapse_ws(texts), F.lit("|"), F.lit("\\|"))),
                       "_links": F.sum("link_chars").over(cell_all), "_vis": F.sum("vis_chars").over(cell_all)})
    b = b.withColumn("_row", F.when(F.col("_opens"), F.col("row_no")).otherwise(-F.col("block_no") - 1))
    row_w = Window.partitionBy("page_id", "table_no", "_row").orderBy("block_no")
    row_all = row_w.rowsBetween(*everything)
    cell = F.struct(F.col("_text").alias("text"), F.col("span_cols").alias("cols"), F.col("span_rows").alias("rows"))
    first_of_row = F.col("_opens") & (F.row_number().over(row_w) == 1)
    b = b.withColumns({
        "_first_cell": first_of_row, "_cells": F.when(first_of_row, F.collect_list(F.when(F.col("_opens"), cell)).over(row_all)),
        "_row_links": F.sum("_links").over(row_all), "_row_vis": F.sum("_vis").over(row_all)})
    level = F.when(tag.isin(*H.HEADINGS), F.substring(tag, 2, 1).cast("int"))
    li_ol = (tag == "li") & (F.col("list_kind") == "ol")
    num = F.row_number().over(Window.partitionBy("page_id", "list_level", "list_no", li_ol).orderBy("block_no"))
    md = (F.when(in_cell | (text == ""), F.lit(""))
          .when(level.isNotNull(), F.concat(F.expr("repeat('#', int(substring(tag, 2, 1)))"), F.lit(" "), text))
          .when(li_ol, F.concat(num.cast("string"), F.lit(". "), text))
          .when(tag == "li", F.concat(F.lit("- "), text))
          .when(F.col("pre_depth") > 0, F.concat(F.lit("```\n"), text, F.lit("\n```")))
          .otherwise(text))
    b = b.withColumn("md", F.when((F.col("quote_depth") > 0) & (md != ""), F.concat(F.lit("> "), md)).otherwise(md))
    # The rows of a table meet in one group, each other block is a group of its own: a
    # table is placed once and its rows go on with their own line only.
    held = ["block_no", "url", "html_chars", "tag", "md", "chrome_depth", "main_depth", "ad_depth", "link_chars", "vis_chars",
            "_row_links", "_row_vis", "_cells"]
    t = (b.groupBy("page_id", "table_no", F.when(F.col("_first_cell"), -1).otherwise(F.col("block_no")).alias("_group"))
         .agg(F.array_sort(F.collect_list(F.struct(*held))).alias("_rows")))
    lines = (F.when(F.col("_group") == -1, table_rows_markdown(F.transform("_rows", lambda r: r["_cells"])))
             .otherwise(F.transform("_rows", lambda r: F.lit(""))))
    t = t.select("page_id", F.explode(F.zip_with("_rows", lines, lambda r, line: F.struct(r.alias("r"), line.alias("line")))).alias("x"))
    t = t.select("page_id", *[F.col(f"x.r.{c}").alias(c) for c in held[:-1]], F.col("x.line").alias("_line"))
    shown = F.col("_line") != ""
    return t.select(
        "page_id", "url", "html_chars", "block_no", F.when(shown, F.lit("tr")).otherwise(tag).alias("tag"),
        F.when(shown, F.col("_line")).otherwise(F.col("md")).alias("md"), "chrome_depth", "main_depth", "ad_depth",
        F.when(shown, F.col("_row_links")).otherwise(F.col("link_chars")).alias("link_chars"),
        F.when(shown, F.col("_row_vis")).otherwise(F.col("vis_chars")).alias("chars"))


def block_features(md_blocks: DataFrame) -> DataFrame:
    """Per-block features used by the keep rule (narrow projection)."""
    return md_blocks.select(
        "page_id", "url", "html_chars", "block_no", "tag", "md", "chars", "link_chars",
        (F.col("main_depth") > 0).alias("in_main"),
        (F.col("chrome_depth") > 0).alias("in_chrome"),
        (F.col("ad_depth") > 0).alias("in_ad"),
        F.col("tag").isin(*H.HEADINGS).alias("is_heading"),
        F.md5(F.col("md")).alias("block_hash"))


def boilerplate_blocks(features: DataFrame, min_pages: int = H.BOILERPLATE_MIN_PAGES) -> DataFrame:
    """Block texts repeated on at least ``min_pages`` distinct pages.

    Distinct pages per hash is a two-level aggregate: (hash, page) first with
    map-side dedup, then a partial count per hash, so a hash that sits on a
    third of all pages still ships one row per task to its reducer.
    """
    nonempty = features.where(F.col("md") != "")
    return (nonempty.groupBy("block_hash").agg(F.countDistinct("page_id").alias("n_pages"))
            .where(F.col("n_pages") >= min_pages))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalized(md):
    """Block text in which case, numbers and white space do not count."""
    return F.trim(H.collapse_ws(F.regexp_replace(F.translate(md, _AZ, _AZ.lower()), "[0-9]+", "#")))


def host_boilerplate(features: DataFrame, min_pages: int = H.BOILERPLATE_MIN_PAGES) -> DataFrame:
    """D12 by host: normalised block texts seen on at least ``min_pages`` distinct pages of
    one host: ``host, text_hash, n_pages``. Counted like the corpus-wide ones: pages
    are made distinct before a hash's tasks send one partial count each, so a host
    with a third of all pages is no hot key."""
    texts = features.where(F.col("md") != "").select(host(F.col("url")).alias("host"), F.md5(normalized(F.col("md"))).alias("text_hash"), "page_id")
    return (texts.groupBy("host", "text_hash").agg(F.countDistinct("page_id").alias("n_pages"))
            .where(F.col("n_pages") >= min_pages))


def keep_flags(md_blocks: DataFrame) -> DataFrame:
    """D13 but for boilerplate: every block with a ``keep`` flag. Inside
    article/main when the page has one, else outside chrome regions with link
    density <= 0.5 (or a heading); never inside an ad-like div; never empty."""
    f = block_features(md_blocks).withColumn(
        "has_main", F.max(F.col("in_main").cast("int")).over(Window.partitionBy("page_id")) > 0)
    dense_ok = (2 * F.col("link_chars") <= F.col("chars")) | F.col("is_heading")
    keep = ((F.col("md") != "") & ~F.col("in_ad")
            & F.when(F.col("has_main"), F.col("in_main")).otherwise(~F.col("in_chrome") & dense_ok))
    f = f.withColumn("keep", keep)
    return f


def kept_blocks(md_blocks: DataFrame, scope: str = "outside_main",
                min_pages: int = H.BOILERPLATE_MIN_PAGES) -> DataFrame:
    """The kept blocks. Repeated boilerplate drops per ``scope``: corpus-wide texts
    outside article/main (``outside_main``) or anywhere (``all``), normalised texts of
    the page's host anywhere (``host``), or nothing (``none``).

    Only blocks kept so far, none of them empty, meet the boilerplate set (one
    row per repeated hash). AQE broadcasts that set when its measured size is
    under the threshold, otherwise the join is sort-merge and the skew-join
    rule splits hot hashes.
    """
    if scope not in ("outside_main", "all", "host", "none"):
        raise ValueError(f"unknown boilerplate scope {scope}")
    flagged = keep_flags(md_blocks)
    kept = flagged.where(F.col("keep"))
    if scope == "host":
        bp = host_boilerplate(block_features(md_blocks), min_pages).select("host", "text_hash")
        keyed = kept.withColumns({"host": host(F.col("url")), "text_hash": F.md5(normalized(F.col("md")))})
        kept = keyed.join(bp, ["host", "text_hash"], "left_anti")
    elif scope != "none":
        bp = boilerplate_blocks(block_features(md_blocks), min_pages).select("block_hash", F.lit(True).alias("is_bp"))
        hit = F.col("is_bp").isNotNull()
        drop = hit & ~F.col("in_main") if scope == "outside_main" else hit
        kept = kept.join(bp, "block_hash", "left").where(~drop)
    return kept.select("page_id", "url", "block_no", "md")
