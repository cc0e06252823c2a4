"""Tags, attributes, references and nesting (D1-D4, D6, D10, B13, C2) against the standard library and stacks."""
import html
import random
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagemark.functions import html as H
from pagemark.functions import urls as U
from pagemark.operators import admission as ADM
from pagemark.operators import blocks as B
from pagemark.operators import markdown as M


class First(HTMLParser):
    """Name and attributes (of a repeated one the first) of the first tag."""

    def __init__(self):
        super().__init__()
        self.found = None

    def handle_starttag(self, tag, attrs):
        if self.found is None:
            self.found = (tag, {k: v or "" for k, v in reversed(attrs)})


def tags(rnd, n):
    names = ["a", "IMG", "div", "main-nav", "x:y", "h1", "Article-Card"]
    attrs = ["href", "SRC", "data-x", "class", "xlink:href", "on.click", "_a", "é"]
    values = ["", "/a?b=1&amp;c=2", "x y", "&#00008217;&#x0002019;", "&eacute;&rarr;", "it's" , "a>b", "a<b", "a=b=c", "&nope;", "http&#58;//h/", "\t/p ", "&lt;&#60;"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            name, value = rnd.choice(attrs), rnd.choice(values)
            gap = rnd.choice(["", "", " ", "\n", " \t"])
            quote = rnd.choice(['"', '"', "'", "", None])
            if quote is None:
                parts.append(name)
                continue
            if quote == "'":
                value = value.replace("'", "")
            if quote == "" and (not value or any(c in value for c in " \t\n>'\"")):
                value = "plain"
            parts.append(f"{name}{gap}={gap}{quote}{value}{quote}")
        body = "".join(rnd.choice([" ", "\n", "  ", "\t"]) + p for p in parts)
        out.append(f"<{rnd.choice(names)}{body}{rnd.choice(['', ' ', ' /'])}>")
    return out


def test_attributes_equal_the_parser(spark):
    texts = sorted(set(tags(random.Random(2), 500)))
    assert len(texts) > 300
    # All references are closed by `;`, which both sides read alike.
    got = {r["t"]: r for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.lower(F.regexp_extract("t", H.TAG_RE, 1)).alias("tag"), H.attributes(F.col("t")).alias("attrs"),
        H.attribute(F.col("t"), "href").alias("href")).collect()}
    for t in texts:
        parser = First()
        parser.feed(t + "x")
        parser.close()
        assert (got[t]["tag"], got[t]["attrs"]) == parser.found, t
        assert got[t]["href"] == parser.found[1].get("href"), t


def test_odd_tags(spark):
    want = {"<a href=x href=y>": {"href": "x"}, "<img/src=//h/x>": {"src": "//h/x"}, "<a href = '/s'>": {"href": "/s"}, "</a href=x>": {},
            "<p title='a>b' x>": {"title": "a>b", "x": ""}, "<a>": {}, "<a b=c/>": {"b": "c/"}, "<": {}, "": {}, "<p a=\"" + "é&" * 50_000 + "\">": {"a": "é&" * 50_000},
            "<p" + " a='>'" * 30_000 + " z>": {"a": ">", "z": ""}}
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", H.attributes(F.col("t"))).collect()}
    assert got == want


def test_long_tags_are_tokens(spark):
    page = "<p" + " a='<>'" * 30_000 + " href=\"x>y\">one<b>two"
    got = [(r["tag"], r["text"]) for r in B.page_tokens(spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")).orderBy("pos").collect()]
    assert got == [("p", "one"), ("b", "two")]


def test_references_equal_unescape(spark):
    texts = ["&#00008217;", "&#x0002019;", "&#0000000000000000000065;", "&#x00000000000000000041;", "&#8217 x", "&#146;", "&#x80;", "&#159;", "&rarr;&Rarr;&nexists;",
             "&amp;amp;", "&amp;#65;", "&#38;amp;", "a & b", "&&amp;&", "&CounterClockwiseContourIntegral;", "&fjlig;", "&bne;", "&#x1F600;", "&#65;&#66;", "&#65&#66", "&noname;", "&;", "&#;", "&#x;"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.decode_entities(F.col("t"))).collect()}
    for t in texts:
        assert got[t] == html.unescape(t), t
    # Values that are no characters stay as written.
    odd = ["&#0;", "&#55296;", "&#x110000;", "&#99999999999999999999;"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(H.decode_entities(F.col("t"))).collect()] == odd


def test_resolve_cleans_like_urljoin(spark):
    refs = [" http://10.0.0.1/a", "ht\ttp://10.0.0.1/d", "\n/x", " x/../y", "\x01\x02../z", "/a\tb\n/c", " //h.test/p", "x ", "\t", " ?q"]
    bases = ["http://n.test/d/p", " http://n.test/d/\tp?x", "http://n.test"]
    pairs = [(b, r) for b in bases for r in refs]
    for r in spark.createDataFrame(pairs, "b string, r string").select("b", "r", U.resolve(F.col("b"), F.col("r")).alias("out")).collect():
        if r["r"].strip("\t\n\r \x01\x02"):
            assert r["out"] == urljoin(r["b"], r["r"]), (r["b"], r["r"])


def pages(spark, *htmls, url="http://n.test/d/p"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_private_hosts_do_not_hide(spark):
    """Spellings of a reference, and where a browser would go."""
    spellings = {
        '<img src=" http://10.0.0.1/a">': "http://10.0.0.1/a", '<img src="ht\ttp://10.0.0.1/d">': "http://10.0.0.1/d",
        '<img src="http&#58;//10.0.0.1/c">': "http://10.0.0.1/c", "<img src=http&colon;//10.0.0.1/c>": "http://10.0.0.1/c",
        "<img src=http://10.0.0.1/u>": "http://10.0.0.1/u", '<img src = "http://10.0.0.1/s">': "http://10.0.0.1/s",
        "<img/src=http://10.0.0.1/x>": "http://10.0.0.1/x", '<img srcset="http://10.0.0.1/1.png 2x">': "http://10.0.0.1/1.png",
        '<img alt="a>b" src=http://10.0.0.1/>': "http://10.0.0.1/", "<!--><img src=//10.0.0.1/>": "http://10.0.0.1/",
        "<!-- x --!><img src=//10.0.0.1/>": "http://10.0.0.1/", "<img src='\\\\10.0.0.1\\b'>": "http://10.0.0.1/b",
        "<img src=https:10.0.0.1/>": "https://10.0.0.1/", "<img src=http:////10.0.0.1/>": "http://10.0.0.1/", "<base href=//10.0.0.1><img src=q>": "http://10.0.0.1/q",
        "<p style=\"background: URL( '//10.0.0.1/b' )\">": "http://10.0.0.1/b", "<meta http-equiv=refresh content='0; url=//10.0.0.1/'>": "http://10.0.0.1/",
        "<form action=//10.0.0.1/f>": "http://10.0.0.1/f", "<object data=//10.0.0.1/o>": "http://10.0.0.1/o", "<video poster=//10.0.0.1/v>": "http://10.0.0.1/v",
        "<script src='//10.0.0.1/j' data=\">\">x</script>": "http://10.0.0.1/j", "<img src='http://10.0.0.1\\@8.8.8.8/'>": "http://10.0.0.1/@8.8.8.8/"}
    got = {}
    res = spark.createDataFrame([("n.test", 0, "9.9.9.9")], "host string, pos int, ip string")
    for r in ADM.resource_admission(pages(spark, *spellings), res).collect():
        got.setdefault(r["page_id"], []).append((r["target"], r["action"]))
    for i, (text, target) in enumerate(spellings.items()):
        assert (target, "abort") in got[i], text


def test_what_is_no_resource(spark):
    texts = ["<!-- <img src=//10.0.0.1/> -->", "<script>var a = '<img src=//10.0.0.1/>'</script>", "<textarea><img src=//10.0.0.1/></textarea>",
             "<p>src=//10.0.0.1/</p>", "", None, "<title><a href=//10.0.0.1/></title>", "<style>p{background:red}", "<img alt=src>"]
    assert ADM.resources(pages(spark, *texts)).collect() == []
    assert [(r["ref"], r["target"]) for r in ADM.resources(pages(spark, "<img srcset='a.png, b.png 2x,data:x,y 3x , c.png,'>")).collect()] == [
        ("a.png", "http://n.test/d/a.png"), ("b.png", "http://n.test/d/b.png"), ("data:x,y", "data:x,y"), ("c.png", "http://n.test/d/c.png")]


def nested(rnd, n):
    names = ["nav", "article", "a", "div", "section", "p", "br", "img", "main-nav"]
    return "".join(rnd.choice(["<{}>", "</{}>", "<{} class='x ad'>"]).format(rnd.choice(names)) + "t" for _ in range(n))


def test_depths_equal_a_stack(spark):
    rnd = random.Random(6)
    texts = [nested(rnd, n) for n in [1, 2, 5, 10, 40] * 8]
    tokens = B.page_tokens(pages(spark, *texts))
    depth = {(r["page_id"], r["pos"]): r for r in B.region_depth(tokens).collect()}
    pairs = {(r["page_id"], r["pos"]): r for r in B.tag_intervals(tokens).collect()}
    ads = {(r["page_id"], r["pos"]): r for r in B.annotate(tokens.drop("attrs")).collect()}
    by_page = {}
    for (page, pos), r in sorted(depth.items()):
        by_page.setdefault(page, []).append((pos, r["tag"]))
    for page, row in by_page.items():
        regions, stacks, closes = dict.fromkeys(H.REGIONS, 0), {}, {}
        levels = {}
        for pos, tag in row:
            name = tag.lstrip("/")
            for region, family in H.REGIONS.items():
                if name in family:
                    regions[region] = max(0, regions[region] - 1) if tag.startswith("/") else regions[region] + 1
                assert depth[page, pos][f"{region}_depth"] == regions[region]
            stack = stacks.setdefault(name, [])
            if tag.startswith("/"):
                levels[pos] = len(stack) if stack else None
                if stack:
                    closes[stack.pop()] = pos
            elif name not in H.VOID_TAGS:
                stack.append(pos)
                levels[pos] = len(stack)
        boxes = [(o, closes.get(o, 1 << 30)) for o, t in row if pairs[page, o]["is_ad"]]
        assert all(t in H.AD_TAGS for o, t in row if pairs[page, o]["is_ad"])
        for pos, tag in row:
            assert pairs[page, pos]["level"] == levels.get(pos), (page, pos)
            assert pairs[page, pos]["close_pos"] == closes.get(pos), (page, pos)
            assert ads[page, pos]["ad_depth"] == sum(o <= pos < c for o, c in boxes)


def markdown(spark, *htmls):
    return [r["markdown"] for r in M.page_markdown(pages(spark, *htmls), scope="none").orderBy("page_id").collect()]


def test_sloppy_pages(spark):
    assert markdown(
        spark, "</nav><nav><p>menu</p></nav><p>real text</p>", "</a><p><a href=/1>only</a> <a href=/2>links</a></p>",
        "</article><article><p>in</p></article><p>out</p>", "<main-nav><p>menu</p></main-nav><p>real</p>", "<p>before</p><article-card>card</article-card>",
        "<html><head><title>T</title><body><p>x", "<title>T</title><p>x", "<head><meta charset=x><title>T</title><p>x</p>", "<head>old <meta> text</head><p>x</p>",
        "<header><p>h</p></header><p>x</p>", "<p>much plain text here <a href=/unq>u</a><a href = \"/sp\">s</a><a href=\"/x?a=1&amp;b=2\">e</a></p>",
        "</div><section class='ad'><p>buy</p><section>more</section></section><p>x</p>", "</ul><ol><li>a</ol>", "<styled-x>a</styled-x><p>b") == [
        "real text", None, "in", "menu\n\nreal", "before\n\ncard", "x", "x", "x", "old text\n\nx", "x",
        "much plain text here [u](http://n.test/unq)[s](http://n.test/sp)[e](http://n.test/x?a=1&b=2)", "x", "1. a", "a\n\nb"]
