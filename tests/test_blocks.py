"""Block contract (D1-D14) on small pages."""
import random

from pyspark.sql import functions as F

from pagemark.operators import blocks as B
from pagemark.operators import markdown as M

PAGES = {
    1: ("https://s.example/a/b?x=1#top",
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=\"/home\">Home</a></nav>"
        "<header><h1>Site</h1></header><div class=\"ad\">Buy now</div><article><h2>Title &amp; more</h2>"
        "<p>Hello <b>bold</b> and <i>it</i> with <a href=\"../c?d=1\">a link</a> and <code>x</code>.</p>"
        "<ul><li>one</li><li>two</li></ul><ol><li>first</li><li>second</li></ol>"
        "<blockquote><p>quoted</p></blockquote><pre>line 1\n  line 2</pre>"
        "<table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>a</td></tr></table>"
        "<!-- <p>comment</p> --><script>var t=\"</p>\";</script><p><b></b>unclosed <b>mark</p></article>"
        "<footer>&copy; s.example</footer></body></html>"),
    2: ("http://n.example/", "<body><p>No article here, plain paragraph text that is long enough.</p>"
                            "<nav><p>menu</p></nav><p><a href=\"/x\">all link text here</a></p></body>"),
    3: ("http://e.example/", "<html><body><script>only()</script></body></html>"),
    4: ("http://t.example/", "no tag at all"),
    5: ("http://t.example/d/", "Before <p>after &#8217; &#x2014; caf&eacute; &nope; &#0;<script>var x = '<p>never</p>'"),
    6: ("http://t.example/d/", "<p>see, among much plain text around them, <a href=\"x\"><b>bold link</b></a>, <a href=\"/y\"> <span>plain</span> </a>.</p>"
                               "<p><b>a <i>b</i></b> <b> c <i> d</p><p>next <a href=\"/z\"><img src=\"i\"></a><b><i> </i></b>done<em></p>"),
    7: ("http://t.example/", "<ol><li>one<ul><li>in</li><li>out</li></ul></li><li>two</li></ol><ol><li>new</li></ol>"),
    8: ("http://t.example/", None), 9: ("http://t.example/", ""),
}


def test_page_markdown(spark):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in PAGES.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["markdown"] for r in M.page_markdown(df, scope="none").collect()}
    md = got[1]
    assert md.split("\n\n") == [
        "## Title & more",
        "Hello **bold** and *it* with [a link](https://s.example/c?d=1) and `x`.",
        "- one", "- two", "1. first", "2. second", "> quoted",
        "```\nline 1\n  line 2\n```",
        "| k | v |\n| --- | --- |", "| 1 | a |",
        "unclosed **mark**",
    ]
    assert got[2] == "No article here, plain paragraph text that is long enough."
    assert got[3] is None and got[8] is None and got[9] is None
    assert got[4] == "no tag at all"
    assert got[5] == "Before\n\nafter ’ — café &nope; &#0;"
    assert got[6].split("\n\n") == [
        "see, among much plain text around them, [**bold link**](http://t.example/d/x), [plain](http://t.example/y).",
        "**a *b*** **c *d***", "next done"]
    assert got[7].split("\n\n") == ["1. one", "- in", "- out", "2. two", "1. new"]


def test_host_boilerplate(spark):
    """What one host repeats but for case, numbers and blanks goes; the same text elsewhere stays."""

    body = "<p>Own text of page {0}, {1} words long</p><p>Visitor  no. {0}</p><p>SEE ALSO</p>"
    names = ["alpha", "beta", "gamma"]
    rows = [(i, f"http://a.test/{i}", body.format(i, names[i])) for i in range(3)] + [(9, "http://b.test/9", "<p>see also</p><p>Visitor no. 4</p>")]
    blocks = B.block_markdown(B.page_blocks(B.page_tokens(spark.createDataFrame(rows, "page_id long, url string, html string"))))
    kept = sorted((r["page_id"], r["md"]) for r in B.kept_blocks(blocks, scope="host", min_pages=3).collect())
    assert kept == [(i, f"Own text of page {i}, {names[i]} words long") for i in range(3)] + [(9, "Visitor no. 4"), (9, "see also")]


def _grid(rows):
    """Lines of a table by placing its cells one by one on a grid."""
    taken, lines = {}, []
    for r, row in enumerate(rows):
        line, col = {}, 0
        for text, cols, span in row:
            for k in range(cols):
                while (r, col) in taken:
                    col += 1
                for below in range(1, min(span, len(rows) - r)):
                    taken[r + below, col] = True
                line[col] = text if k == 0 else ""
                col += 1
        width = max([*line, *(c for q, c in taken if q == r), -1]) + 1
        lines.append([line.get(c, "") for c in range(width)])
    return lines


def test_table_grid_equals_placing_cells(spark):
    rnd = random.Random(14)
    tables = [[[(f"t{r}{c}", rnd.choice([1, 1, 2, 3]), rnd.choice([1, 1, 2, 4, 65534])) for c in range(rnd.randint(0, 4))] for r in range(rnd.randint(1, 6))] for _ in range(60)]
    tables += [[], [[]], [[("a", 1, 1)]] * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "id long, rows array<array<struct<text:string,cols:int,rows:int>>>")
    for r in df.select("id", B.table_grid(F.col("rows")).alias("g")).collect():
        got, want = [list(x) for x in r["g"]], _grid(tables[r["id"]])
        strip = lambda lines: ["|".join(x).rstrip("|") for x in lines]
        assert strip(got) == strip(want), tables[r["id"]]


def test_tables(spark):
    htmls = ["<table><tr><td>a|b</td><td></td><td>c</td></tr><tr><td colspan=2>x</td><td>y<td>z</table><p>after</p>",
             "<table><tr><th rowspan=2>A</th><th colspan='2'>B</th></tr><tr><td>c</td><td rowspan=0>d</td></tr><tr><td>e<td>f</tr><tr><td></td></tr></table>",
             "<p>x</p><table><tr></tr><tr><td></td><td> </td></tr><tr><td><p>one</p><ul><li>two</li></ul></td><td><a href=/q>l</a></td></tr></table><ul><li>o</ul>",
             "<td>loose</td><p>y</p>", "<table><tr><td colspan=99999999999 rowspan=x>w</td></tr></table>"]
    df = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    got = [r["markdown"] for r in M.page_markdown(df, scope="none").orderBy("page_id").collect()]
    assert got[:4] == ["| a\\|b |  | c |\n| --- | --- | --- |\n\n| x |  | y | z |\n\nafter",
                       "| A | B |  |\n| --- | --- | --- |\n\n|  | c | d |\n\n| e | f |  |",
                       "x\n\n| one two | [l](http://h/q) |\n| --- | --- |\n\n- o", "loose\n\ny"]
    assert got[4].startswith("| w |") and got[4].split("\n")[1].count("---") == 1000


def test_long_table_of_cells_that_reach_to_its_end(spark):
    """A line holds what it shows, not the columns that earlier rows still span."""
    n = 400
    rows = [[(f"r{i}", 1, 65534), ("", 2, 1)] for i in range(n)]
    df = spark.createDataFrame([(1, rows)], "id long, rows array<array<struct<text:string,cols:int,rows:int>>>")
    r = df.select(B.table_lines(F.col("rows")).alias("lines"), B.table_rows_markdown(F.col("rows")).alias("md"),
                  B.table_grid(F.col("rows")).alias("grid")).first()
    assert [(x["width"], [tuple(c) for c in x["cells"]]) for x in r["lines"]] == [(i + 3, [(i, f"r{i}")]) for i in range(n)]
    assert [list(x) for x in r["grid"]] == [[""] * i + [f"r{i}", "", ""] for i in range(n)]
    assert r["md"][0] == "| r0 |  |  |\n| --- | --- | --- |"
    assert r["md"][3] == "|  |  |  | r3 |  |  |" and len(r["md"]) == n


def test_partitions_grow_with_the_pages(spark):
    """A task's share of the pages is bounded: twice the HTML, twice the tasks."""
    from pagemark.session import TASK_CHARS
    def parts(n):
        df = spark.range(n).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.lit("y" * (TASK_CHARS // 2)).alias("html"))
        return B.page_tokens(df).rdd.getNumPartitions()
    assert (parts(40), parts(80)) == (20, 40)


def test_page_queries_take_the_bounded_step(spark, tmp_path, monkeypatch):
    """The widest step of each page query has a task for each TASK_CHARS of its HTML."""
    from pagemark import session
    from pagemark.plans import pages_job as P
    from pagemark.sources.derived import nested_pages
    monkeypatch.setattr(session, "TASK_CHARS", 1000)
    seen = []
    for module in (P, M):
        monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(df.rdd.getNumPartitions()) or df)
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.lit("<p>" + "y" * 497).alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    for query in (P.q_kept_blocks, P.q_kept_by_host, P.q_page_markdown, P.q_size_saving):
        query(spark, str(tmp_path))
    assert seen == [20] * 4
    assert P.q_block_features(spark, str(tmp_path)).rdd.getNumPartitions() == 20
    chars = nested_pages(spark, str(tmp_path)).agg(F.sum(F.length("html"))).first()[0]
    assert P.q_nested_markdown(spark, str(tmp_path)).rdd.getNumPartitions() == -(-chars // 1000)
