"""DuckDB twin of the page-to-Markdown job (D1-D15), as SQL text.

``chain(src)`` returns the CTE list over a relation ``src`` with columns
(page_id, url, html); later CTEs are named after the Spark operators.
"""
from __future__ import annotations

from html import entities


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def inlist(tags) -> str:
    return "(" + ", ".join(q(t) for t in tags) + ")"


# --- the block contract, written for RE2 (no look-around, no possessive loops) ---
SP = " \t\r\n\f"
BODY = f"(?:[^>=]|=[{SP}]*(?:\"[^\"]*\"|'[^']*'|[^\"'>{SP}][^>{SP}]*)|=)*"
REST = f"(?:[{SP}/]{BODY})?>"          # of an opener, after its name
SHUT = f"(?:[{SP}/][^>]*)?>"           # of a closer, after its name
NOTE = "<!--(?:>|->|.*?(?:-->|--!>|\\z))"
SILENT = "(?is)" + "|".join([NOTE, *(f"<{t}{REST}.*?(?:</{t}{SHUT}|\\z)" for t in ("script", "style", "noscript", "template", "title"))])
TOP = f"(?is)<head{REST}(?:[{SP}]*<(?:meta|link|base|basefont|bgsound){REST})*(?:[^<]*</head{SHUT})?"
TOKENS = f"^[^<]+|<{BODY}>[^<]*|<[^>]*>[^<]*"
TAG_TEXT = f"^(?:<{BODY}>|<[^>]*>)"
NAME = f"^<(/?[A-Za-z][^{SP}/>]*)"
INNER = f"(?s)^<[A-Za-z][^{SP}/>]*(.*)>\\z"
ATTR = f"[^{SP}/>][^{SP}/>=]*(?:[{SP}]*=[{SP}]*(?:\"[^\"]*\"|'[^']*'|[^\"'>{SP}][^>{SP}]*)?)?"
ATTR_NAME = f"^[^{SP}/>][^{SP}/>=]*"
ATTR_VALUE = f"(?s)^[^{SP}/>][^{SP}/>=]*[{SP}]*=[{SP}]*(.*)\\z"
BLANK = "[ \t\r\n]+"
STARTS = ("p h1 h2 h3 h4 h5 h6 li ul ol div article section main header footer nav aside blockquote pre table tr td th"
          " dl dt dd figure figcaption form hr br").split()
NEVER_CLOSED = "area base basefont bgsound br col embed hr img input link meta param source track wbr".split()
FAMILIES = {"chrome": ["nav", "footer", "aside", "header", "form"], "main": ["article", "main"], "pre": ["pre"], "tbl": ["table"],
            "quote": ["blockquote"], "link": ["a"]}
BOXES = ["div", "section", "aside", "ins"]
ADVERTS = ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored"]
SIGNS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
TITLES = ["h1", "h2", "h3", "h4", "h5", "h6"]
COMMON_PAGES = 5


def _references() -> str:
    names = {k.rstrip(";"): v for k, v in entities.html5.items() if k[-1] == ";"}
    names["nbsp"] = " "
    return "MAP([" + ", ".join(map(q, names)) + "], [" + ", ".join(q(v) for v in names.values()) + "])"


def decode_sql(x: str) -> str:
    """Character references decoded once: each piece after an `&` is looked at on its own."""
    low = ", ".join(q(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(128, 160))
    code = ("CASE WHEN m[:2] IN ('#x', '#X') THEN CASE WHEN length(ltrim(m[3:], '0')) BETWEEN 1 AND 6 THEN ('0x' || ltrim(m[3:], '0'))::BIGINT END"
            " WHEN m <> '' AND length(ltrim(m[2:], '0')) BETWEEN 1 AND 7 THEN ltrim(m[2:], '0')::BIGINT END")
    char = f"CASE WHEN c BETWEEN 128 AND 159 THEN [{low}][c - 127] WHEN c < 55296 OR c BETWEEN 57344 AND 1114111 THEN chr(c::INT) END"
    return (f"(CASE WHEN contains({x}, '&') THEN (SELECT string_agg(CASE WHEN i = 1 THEN p"
            f" WHEN n <> '' THEN coalesce({_references()}[n] || substring(p, length(n) + 2), '&' || p)"
            f" WHEN m <> '' THEN coalesce({char} || substring(p, length(m) + 1 + (substring(p, length(m) + 1, 1) = ';')::INT), '&' || p)"
            f" ELSE '&' || p END, '' ORDER BY i)"
            f" FROM (SELECT *, {code} AS c FROM (SELECT i, p, regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1) AS n,"
            f" regexp_extract(p, '^(#[0-9]+|#[xX][0-9A-Fa-f]+)', 1) AS m"
            f" FROM (SELECT unnest(string_split({x}, '&')) AS p, generate_subscripts(string_split({x}, '&'), 1) AS i)))) ELSE {x} END)")


def attrs_sql(head: str) -> str:
    """Attributes of an opener as a list of (n, v), v as written but for its quotes."""
    return (f"list_transform(list_transform(regexp_extract_all(regexp_extract({head}, {q(INNER)}, 1), {q(ATTR)}, 0), lambda a:"
            f" {{'n': lower(regexp_extract(a, {q(ATTR_NAME)}, 0)), 'v': regexp_extract(a, {q(ATTR_VALUE)}, 1)}}), lambda a:"
            f" {{'n': a.n, 'v': CASE WHEN starts_with(a.v, '\"') OR starts_with(a.v, '''') THEN a.v[2:-2] ELSE a.v END}})")


def attr_sql(head: str, name: str) -> str:
    return f"(list_filter({attrs_sql(head)}, lambda a: a.n = {q(name)})[1]).v"


def attr_rows_sql(rel: str, keys: str) -> str:
    """Per attribute of ``rel`` ({keys}, head): keys, k, n, v decoded; of a repeated name the first."""
    return (f"(SELECT {keys}, k, n, {decode_sql('v')} AS v FROM (SELECT {keys}, a.n AS n, a.v AS v, k FROM (SELECT {keys},"
            f" unnest({attrs_sql('head')}) AS a, generate_subscripts({attrs_sql('head')}, 1) AS k FROM {rel}))"
            f" QUALIFY row_number() OVER (PARTITION BY {keys}, n ORDER BY k) = 1)")


def span_sql(name: str, most: int, zero: int) -> str:
    """A span attribute's number, 1 when it has none."""
    n = f"regexp_extract(coalesce({attr_sql('head', name)}, ''), {q(f'^[{SP}]*[+]?0*([0-9]+)')}, 1)"
    return (f"CASE WHEN {n} = '' THEN 1 WHEN length({n}) > 5 THEN {most} WHEN {n}::INT = 0 THEN {zero} ELSE least({n}::INT, {most}) END")


def collapse_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(BLANK)}, ' ', 'g')"


def trimmed_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\t\r\n]', '', 'g')"


def scheme_sql(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def hostinfo_sql(u: str) -> str:
    return (f"regexp_extract(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1),"
            f" '([^@]*)$', 1)")


def host_sql(u: str) -> str:
    hi = hostinfo_sql(u)
    return (f"lower(CASE WHEN starts_with({hi}, '[') THEN regexp_extract({hi}, '^\\[([^\\]]*)\\]', 1)"
            f" ELSE regexp_extract({hi}, '^([^:]*)', 1) END)")


def clean_sql(u: str) -> str:
    return f"regexp_replace(regexp_replace({u}, '^[\\x00-\\x20]+', ''), '[\t\r\n]', '', 'g')"


def resolve_sql(base: str, ref: str) -> str:
    """RFC 3986, 5.2.2 to 5.2.4: merge, then remove dot segments by appending
    segment after segment to an output string."""
    base, ref = clean_sql(base), clean_sql(ref)
    auth = f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0)"
    tail = f"substring({base}, length({auth}) + 1)"
    path, query = f"regexp_extract({tail}, '^([^?#]*)', 1)", f"regexp_extract({tail}, '^[^?#]*([?][^#]*)', 1)"
    r_path = f"regexp_extract({ref}, '^([^?#]*)', 1)"
    r_rest = f"substring({ref}, length({r_path}) + 1)"
    merged = (f"CASE WHEN starts_with({r_path}, '/') THEN {r_path} WHEN {path} = '' THEN '/' || {r_path}"
              f" ELSE regexp_replace({path}, '[^/]*$', '') || {r_path} END")
    out = (f"(SELECT CASE WHEN o = '' THEN '/' WHEN regexp_matches(m, '/[.][.]?$') AND o <> '/' THEN o || '/' ELSE o END FROM ("
           f"SELECT m, list_reduce(list_prepend('', string_split(substring(m, 2), '/')), lambda acc, s:"
           f" CASE s WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || s END) AS o"
           f" FROM (SELECT {merged} AS m)))")
    return (f"(CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref}"
            f" WHEN starts_with({ref}, '//') THEN {scheme_sql(base)} || ':' || {ref}"
            f" WHEN {r_path} = '' THEN {auth} || {path} ||"
            f" CASE WHEN starts_with({r_rest}, '?') THEN {r_rest} ELSE coalesce({query}, '') || {r_rest} END"
            f" ELSE {auth} || {out} || {r_rest} END)")


def _delta(fam) -> str:
    return (f"CASE WHEN tag IN {inlist(fam)} THEN 1 "
            f"WHEN tag IN {inlist('/' + t for t in fam)} THEN -1 ELSE 0 END")


# Nesting of every tag among tags of its name, and the closer of each opener.
INTERVALS = f"""
own_run AS (
  SELECT *, ltrim(tag, '/') AS name, tag <> '' AND ltrim(tag, '/') NOT IN {inlist(NEVER_CLOSED)} AS pairs,
    sum(CASE WHEN tag = '' OR ltrim(tag, '/') IN {inlist(NEVER_CLOSED)} THEN 0 WHEN starts_with(tag, '/') THEN -1 ELSE 1 END)
      OVER (PARTITION BY page_id, ltrim(tag, '/') ORDER BY pos) AS s FROM page_tokens),
own_depth AS (
  SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id, name ORDER BY pos)) AS d FROM own_run),
leveled AS (
  SELECT *, CASE WHEN NOT pairs THEN NULL WHEN NOT starts_with(tag, '/') THEN d
                 WHEN lag(d, 1, 0) OVER (PARTITION BY page_id, name ORDER BY pos) > 0 THEN d + 1 END AS level FROM own_depth),
mated AS (
  SELECT *, lead(tag) OVER m AS next_tag, lead(pos) OVER m AS next_pos, {attr_sql('head', 'class')} AS class
  FROM leveled WINDOW m AS (PARTITION BY page_id, name, level ORDER BY pos)),
intervals AS (
  SELECT page_id, pos, tag, level, CASE WHEN starts_with(next_tag, '/') THEN next_pos END AS close_pos,
    tag IN {inlist(BOXES)} AND coalesce(list_has_any(string_split_regex(lower({decode_sql('class')}), '[{SP}]+'), [{', '.join(map(q, ADVERTS))}]), false) AS is_ad
  FROM mated WHERE level IS NOT NULL AND NOT starts_with(tag, '/'))"""


def chain(src: str, scope: str = "outside_main", min_pages: int = COMMON_PAGES) -> str:
    w = "(PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    sums = ",\n    ".join(f"sum({_delta(f)}) OVER {w} AS {n}_sum" for n, f in FAMILIES.items())
    depths = ",\n    ".join(f"{n}_sum - least(0, min({n}_sum) OVER {w}) AS {n}_depth" for n in FAMILIES)
    boxes = ", ".join(f"sum({_delta([n])}) OVER {w} AS {n}_run" for n in BOXES)
    box = " ".join(f"WHEN tag IN ({q(n)}, {q('/' + n)}) THEN {q(n + '#')} || ({n}_run - least(0, min({n}_run) OVER {w}) + (tag = {q('/' + n)})::INT)" for n in BOXES)
    starts = inlist([*STARTS, *("/" + t for t in STARTS)])
    raw = decode_sql("coalesce(text, '')")
    inline = [*SIGNS.items(), ("a", None)]
    names = inlist(n for n, _ in inline)
    level = " ".join(
        f"WHEN tag IN ({q(n)}, {q('/' + n)}) THEN sum(CASE tag WHEN {q(n)} THEN 1 WHEN {q('/' + n)} THEN -1 ELSE 0 END) OVER {w}"
        f" + (tag = {q('/' + n)})::INT" for n, _ in inline)
    sign = "CASE mtag " + " ".join(f"WHEN {q(n)} THEN {q(m)}" for n, m in SIGNS.items()) + " END"
    link = lambda href: f"'](' || {resolve_sql('url', href)} || ')'"
    drop_bp = {"all": "is_bp IS NOT NULL",
               "outside_main": "is_bp IS NOT NULL AND NOT in_main",
               "none": "false"}[scope]
    return f"""
src AS ({src}),
cleaned AS (
  SELECT page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), {q(SILENT)}, '', 'g'), {q(TOP)}, '', 'g') AS html FROM src),
tok_lists AS (
  SELECT page_id, url, regexp_extract_all(html, {q(TOKENS)}, 0) AS toks FROM cleaned),
tok_raw AS (
  SELECT page_id, url, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS tok FROM tok_lists),
page_tokens AS (
  SELECT page_id, url, pos,
    lower(regexp_extract(tok, {q(NAME)}, 1)) AS tag,
    regexp_extract(tok, {q(TAG_TEXT)}, 0) AS head,
    substring(tok, length(regexp_extract(tok, {q(TAG_TEXT)}, 0)) + 1) AS text
  FROM tok_raw),
region_sums AS (
  SELECT *,
    {sums}
  FROM page_tokens),
region_depth AS (
  SELECT *,
    {depths}
  FROM region_sums),
box_run AS (
  SELECT *, {boxes},
    CASE WHEN tag = 'a' THEN {attr_sql('head', 'href')} END AS href_raw,
    CASE WHEN tag IN {inlist(BOXES)} AND contains(lower(head), 'class') THEN {attr_sql('head', 'class')} END AS class_raw
  FROM region_depth),
boxed AS (
  SELECT *, CASE {box} END AS box,
    coalesce(list_has_any(string_split_regex(lower({decode_sql('class_raw')}), '[{SP}]+'), [{', '.join(map(q, ADVERTS))}]), false) AS is_ad
  FROM box_run),
ad_steps AS (
  SELECT *,
    CASE WHEN is_ad THEN 1
         WHEN box IS NOT NULL AND starts_with(tag, '/') AND coalesce(lag(is_ad) OVER wl, false) THEN -1
         ELSE 0 END AS ad_delta
  FROM boxed WINDOW wl AS (PARTITION BY page_id, box ORDER BY pos)),
annotated AS (
  SELECT *,
    sum(ad_delta) OVER {w} AS ad_depth,
    sum(CASE WHEN tag IN {starts} THEN 1 ELSE 0 END) OVER {w} AS block_no,
    sum(CASE WHEN tag = 'table' THEN 1 ELSE 0 END) OVER {w} AS table_no,
    sum(CASE WHEN tag = 'tr' THEN 1 ELSE 0 END) OVER {w} AS row_no,
    CASE {level} END AS mlevel,
    ltrim(tag, '/') AS mtag,
    length(regexp_replace(coalesce(text, ''), {q(BLANK)}, '', 'g')) AS own,
    {raw} AS raw_t,
    coalesce({trimmed_sql(decode_sql('href_raw'))}, '') AS href
  FROM ad_steps),
texts AS (
  SELECT *, {collapse_sql('raw_t')} AS txt FROM annotated),
counted AS (SELECT *, trim(txt) AS inner_t, coalesce(sum(own) OVER (PARTITION BY page_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb FROM texts),
paired AS (
  SELECT *, tag IN {names} AND lead(tag) OVER p = '/' || tag AS closed, lead(sb) OVER p AS sb_close,
    starts_with(tag, '/') AND mtag IN {names} AND lag(tag) OVER p = mtag AND lag(sb) OVER p < sb AS ends, lag(href) OVER p AS href0
  FROM counted WINDOW p AS (PARTITION BY page_id, block_no, mtag, mlevel ORDER BY pos)),
judged AS (
  SELECT *, tag IN {names} AND pre_depth = 0 AND (mtag <> 'a' OR href <> '') AS opener,
    coalesce(ends, false) AND pre_depth = 0 AND (mtag <> 'a' OR href0 <> '') AS closer FROM paired),
rendered AS (
  SELECT *,
    CASE WHEN pre_depth > 0 THEN raw_t
      WHEN opener AND NOT (coalesce(closed, false) AND sb_close <= sb) THEN CASE mtag WHEN 'a' THEN '[' ELSE {sign} END || chr(1) || txt
      WHEN closer THEN chr(2) || CASE mtag WHEN 'a' THEN {link('href0')} ELSE {sign} END || txt
      ELSE txt END AS piece,
    CASE WHEN opener AND NOT coalesce(closed, false) THEN chr(2) || CASE mtag WHEN 'a' THEN {link('href')} ELSE {sign} END END AS tail,
    CASE WHEN tag IN ('td', 'th') THEN {span_sql('colspan', 1000, 1)} END AS span_cols,
    CASE WHEN tag IN ('td', 'th') THEN {span_sql('rowspan', 65534, 65534)} END AS span_rows,
    CASE WHEN link_depth > 0 THEN length(inner_t) ELSE 0 END AS link_chars,
    length(CASE WHEN pre_depth > 0 THEN raw_t ELSE txt END) AS vis_chars
  FROM judged),
loose AS (
  SELECT r.page_id, r.block_no, string_agg(tail, '' ORDER BY pos DESC) AS tails
  FROM rendered r JOIN (SELECT page_id, block_no, max(sb + own) AS s FROM rendered GROUP BY ALL) b
    ON r.page_id = b.page_id AND r.block_no = b.block_no AND r.sb < b.s
  WHERE tail IS NOT NULL GROUP BY ALL),
blocks_raw AS (
  SELECT page_id, url, block_no,
    string_agg(piece, '' ORDER BY pos) AS raw,
    arg_min_null(tag, pos) AS tag,
    arg_min_null(chrome_depth, pos) AS chrome_depth,
    arg_min_null(main_depth, pos) AS main_depth,
    arg_min_null(pre_depth, pos) AS pre_depth,
    arg_min_null(tbl_depth, pos) AS tbl_depth,
    arg_min_null(quote_depth, pos) AS quote_depth,
    arg_min_null(ad_depth, pos) AS ad_depth,
    arg_min_null(table_no, pos) AS table_no,
    arg_min_null(row_no, pos) AS row_no,
    arg_min_null(span_cols, pos) AS span_cols,
    arg_min_null(span_rows, pos) AS span_rows,
    sum(link_chars) AS link_chars,
    sum(vis_chars) AS vis_chars
  FROM rendered GROUP BY page_id, url, block_no),
mark_texts AS (
  SELECT b.*, regexp_replace(regexp_replace(
    regexp_replace(coalesce(raw, ''), '([*`\\[]+\\x01[ \\t\\r\\n]*)+$', '') || coalesce(tails, ''),
    '\\x01[ \\t\\r\\n]+', chr(1), 'g'), '[ \\t\\r\\n]+\\x02', chr(2), 'g') AS m
  FROM blocks_raw b LEFT JOIN loose l ON l.page_id = b.page_id AND l.block_no = b.block_no),
block_texts AS (
  SELECT * EXCLUDE (raw, m),
    CASE WHEN pre_depth > 0 THEN coalesce(raw, '') ELSE trim({collapse_sql("replace(replace(m, chr(1), ''), chr(2), '')")}) END AS text
  FROM mark_texts),
list_sums AS (
  SELECT *, sum(CASE WHEN tag IN ('ul', 'ol') THEN 1 WHEN tag IN ('/ul', '/ol') THEN -1 ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY block_no) AS list_sum FROM block_texts),
list_levels AS (
  SELECT *, list_sum - least(0, min(list_sum) OVER (PARTITION BY page_id ORDER BY block_no)) AS list_level FROM list_sums),
page_blocks AS (
  SELECT *, last_value(CASE WHEN tag IN ('ul', 'ol') THEN tag END IGNORE NULLS) OVER l AS list_kind,
    sum(CASE WHEN tag IN ('ul', 'ol') THEN 1 ELSE 0 END) OVER l AS list_no
  FROM list_levels WINDOW l AS (PARTITION BY page_id, list_level ORDER BY block_no)),
celled AS (
  SELECT *, CASE WHEN last_value(turn IGNORE NULLS) OVER o THEN sum(opens::INT) OVER o END AS cell FROM (
    SELECT *, coalesce(tag IN ('td', 'th') AND tbl_depth > 0, false) AS opens,
      CASE WHEN tag IN ('td', 'th') AND tbl_depth > 0 THEN true WHEN tag IN ('tr', 'table', '/tr', '/table', '/td', '/th') THEN false END AS turn
    FROM page_blocks)
  WINDOW o AS (PARTITION BY page_id ORDER BY block_no)),
cells AS (
  SELECT o.*, c.cell_text, c.links, c.vis FROM (SELECT * FROM celled WHERE opens) o JOIN (
    SELECT page_id, cell, sum(link_chars) AS links, sum(vis_chars) AS vis,
      replace({collapse_sql("coalesce(string_agg(text, ' ' ORDER BY block_no) FILTER (text <> ''), '')")}, '|', '\\|') AS cell_text
    FROM celled WHERE cell IS NOT NULL GROUP BY ALL) c ON c.page_id = o.page_id AND c.cell = o.cell),
row_agg AS (
  SELECT page_id, url, table_no, row_no, min(block_no) AS block_no,
    list({{'t': cell_text, 'c': span_cols, 'n': span_rows}} ORDER BY block_no) AS cells,
    arg_min_null(chrome_depth, block_no) AS chrome_depth,
    arg_min_null(main_depth, block_no) AS main_depth,
    arg_min_null(ad_depth, block_no) AS ad_depth,
    sum(links) AS link_chars, sum(vis) AS vis_chars
  FROM cells GROUP BY page_id, url, table_no, row_no),
row_places AS (
  SELECT *, list(cells) OVER (PARTITION BY page_id, table_no ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS upto FROM row_agg),
row_lines AS (
  SELECT * EXCLUDE (upto, cells), list_reduce(
    list_prepend({{'carry': []::INT[], 'line': []::VARCHAR[], 'slots': []::STRUCT(t VARCHAR, n INT)[]}},
      list_transform(upto, lambda r: {{'carry': []::INT[], 'line': []::VARCHAR[], 'slots': flatten(list_transform(r, lambda c:
        list_prepend({{'t': c.t, 'n': c.n::INT}}, list_transform(range(c.c - 1), lambda x: {{'t': '', 'n': c.n::INT}}))))}})),
    lambda s, r: list_transform([list_concat(s.carry, list_transform(range(greatest(len(r.slots) - len(list_filter(s.carry, lambda x: x = 0)), 0)), lambda x: 0::INT))],
      lambda cols: {{
        'carry': list_transform(cols, lambda k, i: CASE WHEN k > 0 THEN k - 1
          ELSE coalesce(r.slots[len(list_filter(cols[:i], lambda x: x = 0))].n - 1, 0) END::INT),
        'line': list_transform(cols, lambda k, i: CASE WHEN k > 0 THEN '' ELSE coalesce(r.slots[len(list_filter(cols[:i], lambda x: x = 0))].t, '') END),
        'slots': r.slots}})[1]).line AS line
  FROM row_places),
shown_rows AS (SELECT *, min(block_no) OVER (PARTITION BY page_id, table_no) AS header FROM row_lines WHERE len(list_filter(line, lambda t: t <> '')) > 0),
table_rows AS (
  SELECT page_id, url, block_no, 'tr' AS tag,
    '| ' || array_to_string(line, ' | ') || ' |' || CASE WHEN block_no = header THEN chr(10) || '|' || repeat(' --- |', len(line)::INT) ELSE '' END AS md,
    chrome_depth, main_depth, ad_depth, link_chars, vis_chars AS chars
  FROM shown_rows),
other_blocks AS (
  SELECT *, (tag = 'li' AND list_kind = 'ol') AS li_ol
  FROM celled),
other_md AS (
  SELECT page_id, url, block_no, tag,
    CASE WHEN text = '' OR cell IS NOT NULL THEN ''
         WHEN tag IN {inlist(TITLES)} THEN repeat('#', substring(tag, 2, 1)::INT) || ' ' || text
         WHEN li_ol THEN (row_number() OVER (PARTITION BY page_id, list_level, list_no, li_ol ORDER BY block_no))::VARCHAR || '. ' || text
         WHEN tag = 'li' THEN '- ' || text
         WHEN pre_depth > 0 THEN '```' || chr(10) || text || chr(10) || '```'
         ELSE text END AS md0,
    quote_depth, chrome_depth, main_depth, ad_depth, link_chars, vis_chars AS chars
  FROM other_blocks),
block_markdown AS (
  SELECT page_id, url, block_no, tag,
    CASE WHEN quote_depth > 0 AND md0 <> '' THEN '> ' || md0 ELSE md0 END AS md,
    chrome_depth, main_depth, ad_depth, link_chars, chars
  FROM other_md WHERE NOT EXISTS (SELECT 1 FROM table_rows t WHERE t.page_id = other_md.page_id AND t.block_no = other_md.block_no)
  UNION ALL
  SELECT * FROM table_rows),
block_features AS (
  SELECT page_id, url, block_no, tag, md, chars, link_chars,
    main_depth > 0 AS in_main, chrome_depth > 0 AS in_chrome, ad_depth > 0 AS in_ad,
    coalesce(tag IN {inlist(TITLES)}, false) AS is_heading, md5(md) AS block_hash
  FROM block_markdown),
boilerplate_blocks AS (
  SELECT block_hash, count(DISTINCT page_id) AS n_pages
  FROM block_features WHERE md <> '' GROUP BY block_hash HAVING count(DISTINCT page_id) >= {min_pages}),
candidates AS (
  SELECT * FROM (
    SELECT *, max(in_main::INT) OVER (PARTITION BY page_id) > 0 AS has_main FROM block_features)
  WHERE md <> '' AND NOT in_ad
    AND CASE WHEN has_main THEN in_main
             ELSE NOT in_chrome AND (2 * link_chars <= chars OR is_heading) END),
kept_blocks AS (
  SELECT c.page_id, c.url, c.block_no, c.md
  FROM candidates c LEFT JOIN (SELECT block_hash, true AS is_bp FROM boilerplate_blocks) b
    ON c.block_hash = b.block_hash
  WHERE NOT ({drop_bp})),
page_md AS (
  SELECT page_id, string_agg(md, chr(10) || chr(10) ORDER BY block_no) AS markdown
  FROM kept_blocks GROUP BY page_id),
page_markdown AS (
  SELECT s.page_id, s.url, m.markdown FROM src s LEFT JOIN page_md m ON s.page_id = m.page_id),
size_saving AS (
  SELECT s.page_id, s.url, length(coalesce(s.html, ''))::BIGINT AS html_chars,
    coalesce(length(m.markdown), 0)::BIGINT AS md_chars,
    CASE WHEN length(coalesce(s.html, '')) > 0
         THEN (1000 - (coalesce(length(m.markdown), 0) * 1000) // length(s.html))::BIGINT END AS saving_pm
  FROM src s LEFT JOIN page_md m ON s.page_id = m.page_id)"""


# Two more CTEs after ``chain``: texts by host, and those on two pages of a host.
HOST_REPEATS = f"""
host_texts AS (
  SELECT {host_sql('url')} AS host, page_id, block_no,
    md5(trim({collapse_sql("regexp_replace(translate(md, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '#', 'g')")})) AS text_hash
  FROM block_features WHERE md <> ''),
host_repeats AS (SELECT host, text_hash, count(DISTINCT page_id) AS n_pages FROM host_texts GROUP BY ALL HAVING count(DISTINCT page_id) >= 2)
"""


def saving_by_host_sql(per_page: str) -> str:
    """D15 rollup from a per-page relation (url, saving_pm)."""
    return f"""
sv AS (SELECT {host_sql('url')} AS host, saving_pm FROM {per_page} WHERE saving_pm IS NOT NULL),
lv AS (SELECT 0 AS level, host, saving_pm FROM sv UNION ALL SELECT 1, NULL, saving_pm FROM sv),
ranked AS (
  SELECT level, host, saving_pm,
    row_number() OVER (PARTITION BY level, host ORDER BY saving_pm) AS rn,
    count(*) OVER (PARTITION BY level, host) AS n
  FROM lv)
SELECT level::BIGINT AS level, host, count(*)::BIGINT AS pages,
  (sum(saving_pm) // count(*))::BIGINT AS mean_pm,
  min(CASE WHEN rn * 100 >= n * 25 THEN saving_pm END)::BIGINT AS p25_pm,
  min(CASE WHEN rn * 100 >= n * 50 THEN saving_pm END)::BIGINT AS p50_pm,
  min(CASE WHEN rn * 100 >= n * 75 THEN saving_pm END)::BIGINT AS p75_pm,
  min(saving_pm)::BIGINT AS min_pm, max(saving_pm)::BIGINT AS max_pm
FROM ranked GROUP BY level, host"""
