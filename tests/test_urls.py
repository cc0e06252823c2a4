"""URL pieces (B1-B4, C2, L5) against the standard library."""
import itertools
from urllib.parse import parse_qs, urljoin, urlsplit

from pyspark.sql import functions as F

from pagemark.functions import urls as U

BASES = ["http://h.example", "http://h.example/", "https://h.example/a", "http://h.example/a/b/c/d/p?q=1/../2#f",
         "http://u@h.example:81/x/?y", "http://h.example/..a/.b/c."]
REFS = ["x", "./x", "../x", "../../../../../../x", "..", ".", "../", "./", "a/./b/../../../c", "/../127.0.0.1/x", "/a/b/../../../../z",
        "/.w/../x", "/a/..", "/a/.", "/a/./", "?next=/a/../b", "../k?next=/a/../b#/../c", "#/../s", "//o.example/p/../q", "//o.example",
        "http://10.0.0.1/../8.8.4.4/x", "ftp://f/x/../y", "mailto:a@b", "..x/y..", "/...", "a;p/../b", "g?y/./x", "1/2/3/../../../../../4/", "é/../ü",
        "a%2e%2e/b", "x/y/..", "x/y/.", "../..", "../../", "....//x"[:4], "/x/y/z/../../..", "/x/../y/../z/..", "?", "z?", "/%2E%2E/x"]


def test_resolve_equals_urljoin(spark):
    pairs = [(b, r) for b, r in itertools.product(BASES, REFS) if r not in ("?", "z?")]
    assert len(pairs) > 220
    pairs += [(f"http://h.example/{'s/' * n}p", "../" * m + "t" + "/.." * k) for n in range(6) for m in range(8) for k in range(3)]
    assert len(pairs) > 300
    df = spark.createDataFrame(pairs, "base string, ref string").select(
        "base", "ref", U.resolve(F.col("base"), F.col("ref")).alias("out"))
    for r in df.collect():
        assert r["out"] == urljoin(r["base"], r["ref"]), (r["base"], r["ref"])


def test_empty_reference_drops_the_fragment(spark):
    df = spark.createDataFrame([("http://h.example/a/../b?c#d", "")], "base string, ref string")
    assert df.select(U.resolve(F.col("base"), F.col("ref"))).first()[0] == "http://h.example/a/../b?c"


def test_parts_equal_urlsplit(spark):
    texts = [" http://8.8.8.8/", "\x01\x1f https://A.example", "http://8.8\t.8.8/", "ht\ntp://h.example/", "http://h.example:000443/",
             "http://h.example:0/", "http://h.example:65535", "http://h.example:000000065536/", "http://h.example:99999999999999999999/",
             "http://h.example:/x", "http://u:p@h.example:8080/", "http://[::1]:81/x", "http://h.example:8x/", "HTTPS://h.example:"]
    got = {r["url"]: r for r in U.with_url_parts(spark.createDataFrame([(t,) for t in texts], "url string")).collect()}
    for t in texts:
        want, r = urlsplit(t), got[t]
        assert r["scheme"] == want.scheme and r["host"] == (want.hostname or ""), t
        try:
            port = want.port
            assert not r["bad_port"] and r["port"] == (port or (443 if want.scheme == "https" else 80)), t
        except ValueError:
            assert r["bad_port"], t


def test_query_param_equals_parse_qs(spark):
    texts = ["key=a", "k%65y=k3", "key=&key=b", "key", "key=a+b%zz", "key=%E9x", "key=%C3%A9", "x=1&key=2&key=3", "=key", "", "a=b=c&key=d=e",
             "key=%", "key=%4", "key=100%25", "KEY=x", "key+=1", "+key=1", "key=a;b", "key=%2B+%20"]
    df = spark.createDataFrame([(t,) for t in texts], "q string").select("q", U.query_param(F.col("q"), "key").alias("v"))
    for r in df.collect():
        assert r["v"] == parse_qs(r["q"]).get("key", [""])[0], r["q"]
