"""URL pieces as Column expressions.

Semantics follow Python's ``urlsplit``: the scheme is the text before the
first `:` when it is a valid scheme, the authority follows `//`, userinfo is
cut at the last `@`, a bracketed host is an IPv6 literal, and the host is
lower-cased.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME_RE = "^([A-Za-z][A-Za-z0-9+.-]*):"
AUTHORITY_RE = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
ORIGIN_RE = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
ABSOLUTE_RE = "^[A-Za-z][A-Za-z0-9+.-]*:"


def clean(url: Column) -> Column:
    """What is parsed: no leading blanks or control characters, no tab or line
    break anywhere."""
    return F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+", ""), "[\t\r\n]", "")


def trimmed(ref: Column) -> Column:
    """A reference as a page means it: blanks and control characters around it and
    tabs and line breaks inside it do not count."""
    return F.regexp_replace(F.regexp_replace(ref, "^[\\x00-\\x20]+|[\\x00-\\x20]+\\z", ""), "[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME_RE, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY_RE, 1)


def hostinfo(url: Column) -> Column:
    """Authority after the last `@`."""
    return F.regexp_extract(authority(url), "([^@]*)$", 1)


def host(url: Column) -> Column:
    """B1: lower-cased host, brackets and userinfo removed; '' when absent."""
    hi = hostinfo(url)
    return F.lower(F.when(hi.startswith("["), F.regexp_extract(hi, "^\\[([^\\]]*)\\]", 1))
                   .otherwise(F.regexp_extract(hi, "^([^:]*)", 1)))


def _fold_dots(path: Column) -> Column:
    """A path without its dot segments, however many: `..` drops the segment
    before it, above the root it drops nothing."""
    kept = F.aggregate(
        F.split(F.substring(path, 2, 1 << 30), "/"), F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"))
    closed = F.when(path.rlike("/\\.\\.?$") & (folded != "/"), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.contains("/."), closed).otherwise(path)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def resolve(base: Column, ref: Column) -> Column:
    """Resolve a link or `Location` against a base URL (RFC 3986, 5.2).
    References with a scheme or an authority of their own stay as they are;
    dot segments fold inside the merged path only. Both are cleaned first, as
    ``urljoin`` does."""
    both = F.named_struct(F.lit("base"), clean(base), F.lit("ref"), clean(ref))
    return _let(both, lambda x: _resolved(x["base"], x["ref"]))


def _resolved(base: Column, ref: Column) -> Column:
    origin = F.regexp_extract(base, ORIGIN_RE, 0)
    after = F.substring(base, F.length(origin) + 1, 1 << 30)
    base_path = F.regexp_extract(after, "^[^?#]*", 0)
    base_query = F.regexp_extract(after, "^[^?#]*([?][^#]*)?", 1)
    ref_path = F.regexp_extract(ref, "^[^?#]*", 0)
    rest = F.substring(ref, F.length(ref_path) + 1, 1 << 30)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_extract(base_path, "(?s)^(.*/)", 1))
    return (F.when(ref.rlike(ABSOLUTE_RE), ref)
            .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
            .when(ref_path == "", F.concat(origin, base_path, F.when(rest.startswith("?"), rest).otherwise(F.concat(base_query, rest))))
            .when(ref_path.startswith("/"), F.concat(origin, _fold_dots(ref_path), rest))
            .otherwise(F.concat(origin, _fold_dots(F.concat(folder, ref_path)), rest)))


def requested(base: Column, ref: Column) -> Column:
    """What a browser requests for a reference (B13): it trims the reference, reads
    backslashes as slashes up to the query, and after http, https, ws, wss or ftp takes
    any number of slashes (none too, unless the scheme is the page's) as the start of
    an authority."""
    def read(p: Column) -> Column:
        own, base_scheme = p["scheme"], scheme(base)
        special = own.isin("http", "https", "ws", "wss", "ftp")
        slashed = F.when(special | (own == ""), F.translate(p["head"], "\\", "/")).otherwise(p["head"])
        after = F.substring(slashed, F.length(own) + 2, 1 << 30)      # behind `scheme:`
        relative = (own == base_scheme) & ~after.startswith("//")
        return F.concat(F.when(special & relative, after)
                        .when(special, F.concat(own, F.lit("://"), F.ltrim(after, F.lit("/"))))
                        .when((own == "") & slashed.startswith("//"), F.concat(base_scheme, F.lit("://"), F.ltrim(slashed, F.lit("/"))))
                        .otherwise(slashed), p["rest"])

    def parts(r: Column) -> Column:
        return F.named_struct(F.lit("scheme"), scheme(r), F.lit("head"), F.regexp_extract(r, "^[^?#]*", 0),
                              F.lit("rest"), F.regexp_extract(r, "(?s)^[^?#]*(.*)", 1))

    return resolve(base, _let(_let(trimmed(ref), parts), read))


def _form_decode(text: Column) -> Column:
    """`+` and `%XX` decoded as UTF-8; a `%` without two hex digits stays."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_param(query: Column, name: str) -> Column:
    """First non-blank value of ``name`` in a query string; names and values
    are decoded alike, items without `=` count as blank; '' when there is none."""
    vals = F.filter(F.split(query, "&"), lambda x: x.contains("=") & (F.length(x) > F.instr(x, "="))
                    & (_form_decode(F.substring_index(x, "=", 1)) == name))
    first = F.try_element_at(vals, F.lit(1))
    return F.coalesce(_form_decode(first.substr(F.instr(first, "=") + 1, F.lit(1 << 30))), F.lit(""))


def with_url_parts(df, col: str = "url"):
    """B1-B4 as staged columns: scheme, host, port (effective), bracketed,
    bad_brackets, bad_port. Each regex runs once per row."""
    u = F.col("_url")
    d = df.withColumn("_url", clean(F.col(col))).withColumns({"scheme": scheme(u), "_auth": authority(u)})
    d = d.withColumn("_hi", F.regexp_extract("_auth", "([^@]*)$", 1))
    hi = F.col("_hi")
    d = d.withColumns({
        "bracketed": hi.startswith("["),
        "bad_brackets": F.col("_auth").contains("[") != F.col("_auth").contains("]"),
        "host": F.lower(F.when(hi.startswith("["), F.regexp_extract(hi, "^\\[([^\\]]*)\\]", 1))
                        .otherwise(F.regexp_extract(hi, "^([^:]*)", 1))),
        "_pt": F.when(hi.startswith("["), F.regexp_extract(hi, "^\\[[^\\]]*\\][^:]*:(.*)$", 1))
                .otherwise(F.regexp_extract(hi, "^[^:]*:(.*)$", 1))})
    # The value counts, not the number of digits.
    value = F.coalesce(F.nullif(F.ltrim(F.col("_pt"), F.lit("0")), F.lit("")), F.lit("0"))
    digits = F.col("_pt").rlike("^[0-9]+$")
    explicit = F.when(digits & (F.length(value) <= 5), value.cast("int"))
    d = d.withColumns({
        "bad_port": (F.col("_pt") != "") & F.coalesce(explicit > 65535, F.lit(True)),
        "port": F.coalesce(F.nullif(explicit, F.lit(0)),
                           F.when(F.col("scheme") == "https", F.lit(443)).otherwise(F.lit(80))).cast("long")})
    return d.drop("_url", "_auth", "_hi", "_pt")
