"""HTTP tiers (C1-C9, E1-E3) at their thresholds."""
import pytest

from pagemark import api
from pagemark.operators import responses as R

SCHEMA = "url string, status int, headers map<string,string>, body string, elapsed_ms long, error string"
NO_NAMES = "host string, pos int, ip string"


def page(md_chars, raw_chars, word=""):
    """HTML of ``raw_chars`` characters whose extraction has ``md_chars``."""
    text = word + "w" * (md_chars - len(word))
    body = f"<p>{text}</p>"
    return body + "<!--" + "-" * (raw_chars - len(body) - 7) + "-->"


# name: (status, headers, body, elapsed_ms, error), route, reason
CASES = {
    "md": ((200, {"Content-Type": "text/markdown"}, "*m*", 9, None), "native", None),
    "md-params": ((206, {"content-TYPE": " Text/Markdown ; v=1"}, "*m*", 9, None), "native", None),
    "md-empty": ((200, {"content-type": "text/markdown"}, "", 9, None), "native", None),
    "md-404": ((404, {"content-type": "text/markdown"}, "*m*", 9, None), "render", "status 404"),
    "no-type": ((200, {}, page(20, 40), 9, None), "extract", None),
    "stub-199": ((200, None, page(199, 400, "needs JavaScript "), 9, None), "render", "javascript stub"),
    "stub-200": ((200, None, page(200, 400, "needs JavaScript "), 9, None), "extract", None),
    "sparse-5001": ((200, None, page(199, 5001), 9, None), "render", "sparse extraction"),
    "sparse-5000": ((200, None, page(199, 5000), 9, None), "extract", None),
    "long-5001": ((200, None, page(200, 5001), 9, None), "extract", None),
    "nothing": ((200, None, "<script>f()</script>", 9, None), "render", "no content"),
    "late": ((200, None, page(20, 40), 10001, None), "render", "fetch failed"),
    "in-time": ((200, None, page(20, 40), 10000, None), "extract", None),
    "error": ((None, None, "", 9, "reset"), "render", "fetch failed"),
    "302-without-location": ((302, {}, "", 9, None), "render", "status 302"),
    "503": ((503, None, page(300, 400), 9, None), "render", "status 503"),
}


def test_tiers(spark):
    urls = {f"http://9.9.9.9/{name}": case for name, case in CASES.items()}
    resp = spark.createDataFrame([(u, *case[0]) for u, case in urls.items()], SCHEMA)
    starts = spark.createDataFrame([(u,) for u in urls], "url string")
    walked = R.follow(starts, resp, spark.createDataFrame([], NO_NAMES))
    got = {r["url"]: r for r in R.route(walked, resp).collect()}
    assert len(got) == len(urls)
    for u, (response, route, reason) in urls.items():
        assert (got[u]["route"], got[u]["reason"]) == (route, reason), u
        if route == "native":
            assert got[u]["markdown"] == response[2] and got[u]["tier"] == 1


@pytest.mark.parametrize("length, outcome, hops", [(0, "response", 0), (4, "response", 4), (5, "response", 5), (6, "refused", 5), (9, "refused", 5)])
def test_redirect_limit(spark, length, outcome, hops):
    url = lambda k: f"http://9.9.9.{length}/s{k}"
    rows = [(url(k), 307, {"LOCATION": f"../s{k + 1}"}, "", 1, None) for k in range(length)]
    resp = spark.createDataFrame(rows + [(url(length), 200, None, "<p>end</p>", 1, None)], SCHEMA)
    starts = spark.createDataFrame([(url(0),), (url(0),)], "url string")
    rows = R.follow(starts, resp, spark.createDataFrame([], NO_NAMES)).collect()
    assert [(r["outcome"], r["hops"]) for r in rows] == [(outcome, hops)]
    assert rows[0]["path"] == " -> ".join(url(k) for k in range(hops + 1))
    if outcome == "refused":
        assert rows[0]["message"] == f"too many redirects following {url(0)}"


def test_hops_are_vetted(spark):
    rows = [("http://9.9.9.9/in", 301, {"location": "http://172.20.1.1/"}, "", 1, None),
            ("http://9.9.9.9/up", 301, {"location": "/../172.20.1.1/"}, "", 1, None),
            ("http://9.9.9.9/172.20.1.1/", 200, None, "<p>x</p>", 1, None),
            ("http://9.9.9.9/bad", 301, {"location": "http://[1::2/"}, "", 1, None)]
    starts = spark.createDataFrame([(r[0],) for r in rows], "url string")
    resp = spark.createDataFrame(rows, SCHEMA)
    got = {r["start_url"]: r for r in R.follow(starts, resp, spark.createDataFrame([], NO_NAMES)).collect()}
    assert got["http://9.9.9.9/in"]["message"] == "172.20.1.1 maps to a private address"
    assert got["http://9.9.9.9/up"]["outcome"] == "response" and got["http://9.9.9.9/up"]["hops"] == 1
    assert got["http://9.9.9.9/bad"]["outcome"] == "fetch_failed"


def test_one_outcome_per_work_list_row(spark):
    urls = spark.createDataFrame([(1, "http://9.9.9.9/a"), (2, "http://9.9.9.9/a"), (3, "http://9.9.9.9/b"), (4, "http://10.1.1.1/"),
                                  (5, "http://10.1.1.1/"), (6, "http://9.9.9.9/r"), (7, "http://9.9.9.9/r")], "page_id long, url string")
    resp = spark.createDataFrame([("http://9.9.9.9/a", 200, None, "<p>text</p>", 1, None), ("http://9.9.9.9/b", 404, None, "", 1, None),
                                  ("http://9.9.9.9/r", 500, None, "", 1, None)], SCHEMA)
    caps = spark.createDataFrame([("http://9.9.9.9/r", 0, "headless", "<p>m</p>"), ("http://9.9.9.9/r", 250, "headless", "<div><p><b>m</b></p>"),
                                  ("http://9.9.9.9/r", 500, "headless", "<p><b>m</b></p>"), ("http://9.9.9.9/a", 0, "headless", "<p>unused</p>")],
                                 "url string, elapsed_ms long, capture_mode string, html string")
    req = spark.createDataFrame([(p, u, "load", 30000, True, 5000, 250, {"load": 1}) for p, u in
                                 ((3, "http://9.9.9.9/b"), (6, "http://9.9.9.9/r"), (7, "http://9.9.9.9/r"))],
                                "page_id long, url string, wait_until string, timeout_ms long, headless boolean, "
                                "poll_budget_ms long, poll_interval_ms long, nav_ms map<string,long>")
    got = api.convert(urls, resp, spark.createDataFrame([], NO_NAMES), caps, req).collect()
    assert sorted((r["page_id"], r["tier"], r["status"], r["markdown"]) for r in got) == [
        (1, 2, "ok", "text"), (2, 2, "ok", "text"), (3, 3, "failed", None), (4, 0, "refused", None), (5, 0, "refused", None),
        (6, 3, "ok", "**m**"), (7, 3, "ok", "**m**")]


def test_render_tier_defaults_and_errors(spark):
    """URLs left to rendering: without a request row (defaults), with an error, with none at all."""
    from pagemark import api
    names = ["plain", "broken", "none", "late"]
    urls = spark.createDataFrame([(i, f"http://{n}.test/") for i, n in enumerate(names)], "page_id long, url string")
    responses = spark.createDataFrame([], "url string, status int, headers map<string,string>, body string, elapsed_ms long, error string")
    resolutions = spark.createDataFrame([(f"{n}.test", 0, "9.9.9.9") for n in names], "host string, pos int, ip string")
    text = "<p>one settled text</p>"
    captures = spark.createDataFrame(
        [(f"http://{n}.test/", t, "headless", text, None) for n in ("plain", "late", "broken") for t in (0, 250)]
        + [("http://broken.test/", 400, "headless", None, "target closed"), ("http://broken.test/", 600, "headless", None, "later error"),
           ("http://plain.test/", 0, "headed", None, "headed only")],
        "url string, elapsed_ms long, capture_mode string, html string, error string")
    requests = spark.createDataFrame([(3, "http://late.test/", "load", 1000, None, None, None, {"load": 1001})],
                                     "page_id long, url string, wait_until string, timeout_ms long, headless boolean, poll_budget_ms long, poll_interval_ms long, nav_ms map<string,long>")
    got = {r["url"]: (r["status"], r["markdown"], r["message"]) for r in api.convert(urls, responses, resolutions, captures, requests).collect()}
    assert got == {"http://plain.test/": ("ok", "one settled text", None),
                   "http://broken.test/": ("failed", None, "failed to fetch http://broken.test/: target closed"),
                   "http://none.test/": ("failed", None, "failed to fetch http://none.test/: no render captures"),
                   "http://late.test/": ("nav_timeout", None, "navigation to http://late.test/ timed out after 1000ms")}
    plain = api.convert(urls, responses, resolutions, captures.drop("error").where("html is not null"), requests)
    assert {r["url"]: r["status"] for r in plain.collect()}["http://broken.test/"] == "ok"
