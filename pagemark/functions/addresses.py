"""IP literals and address classes as Column expressions.

IPv4 is a BIGINT; IPv6 is 32 lower-case hex digits (fixed width, so string
order is numeric order). Classification compiles the class table below into
one CASE expression: no join, no Python, stays in whole-stage codegen.
"""
from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: address classes, first match wins ----------------------
# Python 3.13.0 stdlib special ranges in the order the reference tests them
# (loopback, link-local, private, reserved, multicast, unspecified).
# "private" excludes the listed exceptions.
CLASS_ORDER = ("loopback", "link-local", "private", "reserved", "multicast", "unspecified")
V4_CLASSES = {
    "loopback": ["127.0.0.0/8"],
    "link-local": ["169.254.0.0/16"],
    "private": ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
                "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
                "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
                "255.255.255.255/32"],
    "reserved": ["240.0.0.0/4"],
    "multicast": ["224.0.0.0/4"],
    "unspecified": ["0.0.0.0/32"],
}
V4_PRIVATE_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
V6_CLASSES = {
    "loopback": ["::1/128"],
    "link-local": ["fe80::/10"],
    "private": ["::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64",
                "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"],
    "reserved": ["::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3",
                 "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5",
                 "f800::/6", "fe00::/9"],
    "multicast": ["ff00::/8"],
    "unspecified": ["::/128"],
}
V6_PRIVATE_EXCEPTIONS = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
                         "2001:20::/28", "2001:30::/28"]
# Prefixes whose embedded IPv4 is classified instead (mapped, 6to4, Teredo).
MAPPED_PREFIX = "00000000000000000000ffff"
SIXTOFOUR_PREFIX = "2002"
TEREDO_PREFIX = "20010000"
MAX_V4 = 4294967295
TWO_64 = 18446744073709551616
MAX_U64 = "18446744073709551615"


def cidr_range(cidr: str):
    """(lo, hi) of a CIDR: ints for IPv4, 32-digit hex for IPv6 (driver-side constant)."""
    net = ipaddress.ip_network(cidr)
    lo, hi = int(net.network_address), int(net.broadcast_address)
    if net.version == 4:
        return lo, hi
    return f"{lo:032x}", f"{hi:032x}"


def class_rows():
    """The class table as rows (version, priority, class, lo, hi, is_exception)."""
    rows = []
    for ver, classes, exc in ((4, V4_CLASSES, V4_PRIVATE_EXCEPTIONS),
                              (6, V6_CLASSES, V6_PRIVATE_EXCEPTIONS)):
        for prio, name in enumerate(CLASS_ORDER, start=1):
            for cidr in classes[name]:
                rows.append((ver, prio, name, *cidr_range(cidr), False))
        for cidr in exc:
            rows.append((ver, 3, "private", *cidr_range(cidr), True))
    return rows


def _classify_sql(key: str, classes, exceptions, quoted: bool) -> str:
    """The class table compiled to one SQL CASE over column ``key`` (built as
    text and parsed once: building it from Column objects costs hundreds of
    driver round trips)."""
    def lit(v):
        return f"'{v}'" if quoted else str(v)

    def in_any(cidrs):
        parts = [f"({key} >= {lit(lo)} AND {key} <= {lit(hi)})" for lo, hi in map(cidr_range, cidrs)]
        return "(" + " OR ".join(parts) + ")" if parts else "false"

    arms = []
    for name in CLASS_ORDER:
        cond = in_any(classes[name])
        if name == "private" and exceptions:
            cond = f"({cond} AND NOT {in_any(exceptions)})"
        arms.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(arms) + " END"


def v4_class(v4: str) -> Column:
    """Class of an IPv4 address held in BIGINT column ``v4``."""
    return F.expr(_classify_sql(f"`{v4}`", V4_CLASSES, V4_PRIVATE_EXCEPTIONS, quoted=False))


def v6_class(hex32: str) -> Column:
    """Class of an IPv6 address held as 32 hex digits in column ``hex32``."""
    return F.expr(_classify_sql(f"`{hex32}`", V6_CLASSES, V6_PRIVATE_EXCEPTIONS, quoted=True))


# --- literal parsing -------------------------------------------------------
OCTET = "(0|[1-9][0-9]{0,2})"
QUAD_RE = "^" + "\\.".join([OCTET] * 4) + "$"
BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
VALID_QUAD_RE = "^" + "\\.".join([BYTE] * 4) + "$"


def v4_from_quad(s: Column) -> Column:
    """Dotted quad without leading zeros, each part <= 255, else null: one match, then
    each part cut out once."""
    a, b = F.substring_index(s, ".", 2), F.substring_index(s, ".", -2)
    parts = [F.substring_index(a, ".", 1), F.substring_index(a, ".", -1), F.substring_index(b, ".", 1)]
    # The pattern's end allows a line end after the last part, which not every cast does.
    last = F.coalesce(F.substring_index(b, ".", -1).try_cast("long"), F.regexp_extract(s, QUAD_RE, 4).try_cast("long"))
    parts = [p.try_cast("long") for p in parts]
    return F.when(s.rlike(VALID_QUAD_RE), parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + last)


def _hex8(v4: Column) -> Column:
    return F.lpad(F.lower(F.hex(v4)), 8, "0")


def with_v6_hex(df: DataFrame, src: str, out: str) -> DataFrame:
    """IPv6 text (with `::`, an optional dotted-quad tail and an optional
    `%zone`) to 32 hex digits in ``out``; null when it is not valid IPv6."""
    empty = F.array().cast("array<string>")
    # Without a colon all that follows is null and costs nothing.
    d = df.withColumn("_t", F.when(F.col(src).contains(":"), F.split(F.col(src), "%").getItem(0)))
    d = d.withColumns({"_has_v4": F.col("_t").rlike(":[0-9]*\\.[0-9.]*$"),
                       "_tail": F.regexp_extract("_t", ":([0-9.]+)$", 1)})
    d = d.withColumn("_v4", v4_from_quad(F.col("_tail")))
    d = d.withColumn("_v4h", _hex8(F.col("_v4")))
    d = d.withColumn("_halves", F.split(F.when(
        F.col("_has_v4"), F.concat(F.regexp_replace("_t", "[0-9.]+$", ""), F.substring("_v4h", 1, 4),
                                   F.lit(":"), F.substring("_v4h", 5, 4))).otherwise(F.col("_t")), "::", -1))

    def groups(x):
        return F.when(x == "", empty).otherwise(F.split(x, ":", -1))

    d = d.withColumns({
        "_left": groups(F.col("_halves").getItem(0)),
        "_right": F.when(F.size("_halves") == 2, groups(F.col("_halves").getItem(1))).otherwise(empty)})
    d = d.withColumn("_n", F.size("_left") + F.size("_right"))
    d = d.withColumn("_allg", F.concat(
        "_left", F.when(F.size("_halves") == 2, F.array_repeat(F.lit("0000"), F.lit(8) - F.col("_n")))
        .otherwise(empty), "_right"))
    ok = (F.col("_t").contains(":") & (F.size("_halves") <= 2)
          & F.when(F.size("_halves") == 2, F.col("_n") <= 7).otherwise(F.col("_n") == 8)
          & F.forall("_allg", lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
          & (~F.col("_has_v4") | F.col("_v4").isNotNull()))
    d = d.withColumn(out, F.when(ok, F.array_join(F.transform("_allg", lambda g: F.lpad(F.lower(g), 4, "0")), "")))
    return d.drop("_t", "_has_v4", "_tail", "_v4", "_v4h", "_halves", "_left", "_right", "_n", "_allg")


def with_int_literal(df: DataFrame, host: str, v4_out: str, v6_out: str) -> DataFrame:
    """All-digit or `0x` host as an integer address: ``v4_out`` when
    below 2^32, ``v6_out`` (32 hex digits) when below 2^128, else nulls.

    Decimal hosts of up to 18 digits are longs; longer ones use DECIMAL(38,0):
    n = 10a + d, split at 2^64 into hi = 10 * (a div 2^64) + carry and lo, each
    converted with conv().
    """
    dec38 = "decimal(38,0)"
    two64 = F.lit(str(TWO_64)).cast(dec38)
    h = F.col(host)
    d = df.withColumns({
        "_is_hex": h.rlike("^0x[0-9a-f]+$"),
        "_is_dec": h.rlike("^[0-9]+$"),
        "_digits": F.ltrim(F.when(h.startswith("0x"), F.substring(h, 3, 1 << 30)).otherwise(h), F.lit("0"))})
    d = d.withColumn("_digits", F.when(F.col("_digits") == "", F.lit("0")).otherwise(F.col("_digits")))
    d = d.withColumns({
        "_hx": F.when(F.col("_is_hex"), F.col("_digits")),
        "_n": F.when(F.col("_is_dec") & (F.length("_digits") <= 18), F.col("_digits").try_cast("long")),
        "_dec": F.when(F.col("_is_dec") & (F.length("_digits") > 18) & (F.length("_digits") <= 39), F.col("_digits"))})
    d = d.withColumns({
        "_a": F.col("_dec").substr(F.lit(1), F.length("_dec") - 1).cast(dec38),
        "_d": F.col("_dec").substr(F.length("_dec"), F.lit(1)).cast(dec38)})
    # `div` is exact integral division (plain `/` on DECIMAL(38,0) rounds).
    t64 = f"CAST('{TWO_64}' AS DECIMAL(38,0))"
    d = d.withColumn("_a_hi", F.expr(f"_a div {t64}").cast(dec38))
    d = d.withColumn("_low", ((F.col("_a") - F.col("_a_hi") * two64) * 10 + F.col("_d")).cast(dec38))
    d = d.withColumn("_carry", F.expr(f"_low div {t64}").cast(dec38))
    d = d.withColumns({"_hi": (F.col("_a_hi") * 10 + F.col("_carry")).cast(dec38),
                       "_lo": (F.col("_low") - F.col("_carry") * two64).cast(dec38)})
    fits = F.col("_dec").isNotNull() & (F.col("_hi") <= F.lit(MAX_U64).cast(dec38))
    hex_v4 = F.when(F.length("_hx") <= 8, F.conv("_hx", 16, 10).cast("long"))
    hex_v6 = F.when((F.length("_hx") > 8) & (F.length("_hx") <= 32), F.lpad("_hx", 32, "0"))
    dec_hex = F.concat(F.lpad(F.lower(F.conv(F.col("_hi").cast("string"), 10, 16)), 16, "0"),
                       F.lpad(F.lower(F.conv(F.col("_lo").cast("string"), 10, 16)), 16, "0"))
    d = d.withColumns({
        v4_out: F.coalesce(hex_v4, F.when(F.col("_n") <= MAX_V4, F.col("_n"))),
        v6_out: F.coalesce(hex_v6, F.when(F.col("_n") > MAX_V4, F.lpad(F.lower(F.hex("_n")), 32, "0")), F.when(fits, dec_hex))})
    return d.drop("_is_hex", "_is_dec", "_digits", "_hx", "_n", "_dec", "_a", "_d", "_a_hi", "_low", "_carry", "_hi", "_lo")


def with_literal(df: DataFrame, host: str, v4_out: str = "lit_v4", v6_out: str = "lit_v6") -> DataFrame:
    """(v4, hex32) of a host that is an IP literal; both null if not.
    Text forms first (dotted quad, IPv6), then hex, then decimal."""
    d = df.withColumn("_q4", v4_from_quad(F.col(host)))
    d = with_v6_hex(d, host, "_q6")
    # Only what is no text form is looked at as a number.
    d = d.withColumn("_rest", F.when(F.col("_q4").isNull() & F.col("_q6").isNull(), F.col(host)))
    d = with_int_literal(d, "_rest", "_i4", "_i6")
    d = d.withColumns({v4_out: F.coalesce("_q4", "_i4"), v6_out: F.coalesce("_q6", "_i6")})
    return d.drop("_q4", "_q6", "_rest", "_i4", "_i6")


def embedded_v4(hex32: Column) -> Column:
    """IPv4 inside a mapped, 6to4 or Teredo address, else null."""
    low = F.conv(F.substring(hex32, 25, 8), 16, 10).cast("long")
    return (F.when(hex32.startswith(MAPPED_PREFIX), low)
            .when(hex32.startswith(SIXTOFOUR_PREFIX),
                  F.conv(F.substring(hex32, 5, 8), 16, 10).cast("long"))
            .when(hex32.startswith(TEREDO_PREFIX), F.lit(MAX_V4) - low))


def with_class(df: DataFrame, v4: str, h6: str, out: str) -> DataFrame:
    """Class of a literal (embedded IPv4 unwrapped first); null = public."""
    d = df.withColumn("_inner", F.coalesce(F.col(v4), embedded_v4(F.col(h6))))
    d = d.withColumn(out, F.when(F.col("_inner").isNotNull(), v4_class("_inner"))
                     .otherwise(v6_class(h6)))
    return d.drop("_inner")
