"""Column expressions of the block contract (page to Markdown, D1-D10): clean-up,
tokens, tags with their attributes, character references.

Loops over alternatives are possessive (``*+``): Java runs those without a stack
frame per round, so tags of any length pass. The DuckDB twin has patterns of
its own.
"""
from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the block contract ------------------------------------
WS = " \t\r\n\f"
# Inside a tag, after `<`: quoted values may hold `>`; a quote only opens a value after `=`.
IN_TAG = (f"(?:[^>=]++|=[{WS}]*+(?:\"[^\"]*+\"|'[^']*+'|[^\"'>{WS}][^>{WS}]*+)|=)*+>")
NAME_END = f"(?=[{WS}/>])"
# A comment ends at once after `<!-->` and `<!--->`; one that never ends runs to the end of the page.
COMMENT = "<!--(?:-?>|.*?(?:--!?>|\\z))"
# Regions removed before tokenizing; one still open at the end of the page runs to the end.
DROPPED = ("script", "style", "noscript", "template", "title")
DROP_RE = "(?is)" + COMMENT + "".join(f"|<{t}{NAME_END}{IN_TAG}.*?(?:</{t}{NAME_END}[^>]*>|\\z)" for t in DROPPED)
# An open `head` holds white space and its own empty tags; other text counts as head only if `</head>` follows it.
HEAD_TAGS = "meta|link|base|basefont|bgsound"
HEAD_RE = f"(?is)<head{NAME_END}{IN_TAG}(?:[{WS}]*+<(?:{HEAD_TAGS}){NAME_END}{IN_TAG})*+(?:[^<]*+</head{NAME_END}[^>]*>)?+"
# One token = one tag plus the text that follows it up to the next `<`; text
# before the first tag is a token without a tag.
TOKEN_RE = f"^[^<]+|<{IN_TAG}[^<]*+|<[^>]*>[^<]*"
TAG_TEXT_RE = f"^<{IN_TAG}|^<[^>]*>"
TAG_RE = f"^<(/?[A-Za-z][^{WS}/>]*)"
ATTRIBUTE_RE = f"[^{WS}/>][^{WS}/>=]*+(?:[{WS}]*+=[{WS}]*+(?:\"[^\"]*+\"|'[^']*+'|[^\"'>{WS}][^>{WS}]*+)?+)?+"
WS_RE = "[ \t\r\n]+"
# Tags whose opener or closer starts a new block.
BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "div",
              "article", "section", "main", "header", "footer", "nav", "aside",
              "blockquote", "pre", "table", "tr", "td", "th", "dl", "dt", "dd",
              "figure", "figcaption", "form", "hr", "br")
# Tags that never have a closer.
VOID_TAGS = ("area", "base", "basefont", "bgsound", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr")
# R2: region families tracked as running depth.
REGIONS = {
    "chrome": ("nav", "footer", "aside", "header", "form"),
    "main": ("article", "main"),
    "pre": ("pre",),
    "tbl": ("table",),
    "quote": ("blockquote",),
    "link": ("a",),
}
# Containers that an advertising class marks off.
AD_TAGS = ("div", "section", "aside", "ins")
AD_WORDS = ("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored")
# Inline marks.
MARKS = (("b", "**"), ("strong", "**"), ("i", "*"), ("em", "*"), ("code", "`"))
# Inside an assembled block: follows an opening and precedes a closing mark.
OPEN, CLOSE = "\x01", "\x02"
# Character references by name (all of HTML's, ending with `;`) and by number.
ENTITIES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")} | {"nbsp": " "}
COMMON = ("amp", "lt", "gt", "quot", "apos", "nbsp", "middot", "copy", "mdash", "ndash", "hellip")
NAMED_RE = "^([A-Za-z][A-Za-z0-9]*);"
NUMBERED_RE = "^(#[0-9]+|#[xX][0-9A-Fa-f]+)"
# Numbers 128 to 159 mean the characters of Windows-1252, where it has one.
C1 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# R7 defaults: a block text seen on at least this many distinct pages is chrome.
BOILERPLATE_MIN_PAGES = 5


def closers(tags) -> list[str]:
    return ["/" + t for t in tags]


def _table(pairs: dict[str, str]) -> Column:
    """A constant map, written as two strings (thousands of literals are slow to plan)."""
    return F.map_from_arrays(F.split(F.lit("\x01".join(pairs)), "\x01"), F.split(F.lit("\x01".join(pairs.values())), "\x01"))


def decode_entities(c: Column) -> Column:
    """Character references decoded once, left to right; unknown ones stay. Numbers may
    have any number of leading zeros and need no `;`; their value decides."""
    common = _table({n: ENTITIES[n] for n in COMMON})

    def after(p: Column) -> Column:
        name = F.regexp_extract(p, NAMED_RE, 1)
        number = F.regexp_extract(p, NUMBERED_RE, 1)
        hexadecimal = F.lower(number).startswith("#x")
        digits = F.ltrim(F.when(hexadecimal, F.substring(number, 3, 1 << 30)).otherwise(F.substring(number, 2, 1 << 30)), F.lit("0"))
        code = (F.when(hexadecimal & (F.length(digits) <= 6), F.conv(digits, 16, 10))
                .when(~hexadecimal & (F.length(digits) <= 7), digits)).try_cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = (F.when(code.between(128, 159), F.element_at(F.split(F.lit("\x01".join(C1)), "\x01"), code - 127))
                .when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        end = F.when(F.substring(p, F.length(number) + 1, 1) == ";", 1).otherwise(0)
        return F.coalesce(
            F.when(name != "", F.concat(F.coalesce(F.try_element_at(common, name), F.try_element_at(_table(ENTITIES), name)),
                                        F.substring(p, F.length(name) + 2, 1 << 30))),
            F.when(number != "", F.concat(char, F.substring(p, F.length(number) + end + 1, 1 << 30))),
            F.concat(F.lit("&"), p))

    parts = F.split(c, "&")
    return F.when(c.contains("&"), F.concat(parts[0], F.array_join(
        F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), after), ""))).otherwise(c)


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, WS_RE, " ")


def content(html: Column) -> Column:
    """The page without regions that hold no content."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), DROP_RE, ""), HEAD_RE, "")


def _attribute_texts(head: Column) -> Column:
    """The attributes of an opener's text, as written; none for closers."""
    inner = F.regexp_extract(head, f"(?s)^<[A-Za-z][^{WS}/>]*(.*)>\\z", 1)
    return F.regexp_extract_all(inner, F.lit(ATTRIBUTE_RE), 0)


def _attribute_name(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, f"^[^{WS}/>][^{WS}/>=]*", 0))


def _attribute_value(text: Column) -> Column:
    value = F.regexp_extract(text, f"(?s)^[^{WS}/>][^{WS}/>=]*[{WS}]*=[{WS}]*(.*)\\z", 1)
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def attributes(head: Column) -> Column:
    """Map of an opener's attributes, names in lower case, references in values
    decoded; of a repeated name the first holds, a name without value has ''."""
    pairs = F.transform(_attribute_texts(head), lambda a: F.named_struct(F.lit("name"), _attribute_name(a), F.lit("value"), _attribute_value(a)))
    pairs = F.transform(pairs, lambda a: F.named_struct(F.lit("name"), a["name"], F.lit("value"), decode_entities(a["value"])))
    return F.map_from_entries(F.reverse(pairs))   # the last of a key wins in a map (session setting)


def attribute(head: Column, name: str, decoded: bool = True) -> Column:
    """One attribute of an opener, null when it has none of that name."""
    own = F.filter(_attribute_texts(head), lambda a: _attribute_name(a) == name)
    value = F.transform(F.slice(own, 1, 1), _attribute_value)
    value = F.transform(value, decode_entities) if decoded else value
    return F.when(F.lower(head).contains(name), F.try_element_at(value, F.lit(1)))


def is_ad(tag: Column, head: Column) -> Column:
    """An opener of a container whose class holds an advertising word."""
    words = F.split(F.lower(attribute(head, "class")), f"[{WS}]+")
    return tag.isin(*AD_TAGS) & F.coalesce(F.arrays_overlap(words, F.array(*[F.lit(w) for w in AD_WORDS])), F.lit(False))


def depth_delta(tag: Column, family) -> Column:
    return (F.when(tag.isin(*family), 1)
            .when(tag.isin(*closers(family)), -1)
            .otherwise(0))
