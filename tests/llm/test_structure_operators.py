"""Conversation repair, URL rules and whitening against brute force."""
import hashlib
import math
import random
import re
import zlib
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemark.llm import queries, repair, urlrules, whitening

SF = "/root/testdata/sf0.001"

# ---- conversation repair


def every_script(rows):
    """Least (cost, audit) by trying every edit of every row and up to two inserts a gap."""
    edits = []
    for initial, must_go, truncated in rows:
        own = [(2, "D", "")]
        if not must_go:
            extra = 5 if truncated else 0
            own += [(extra, "K", initial)] + [(1 + extra, "R", r) for r in "ua"]
        edits.append(own)
    gap = [(5 * n, "I" * n, "".join(x)) for n in range(3) for x in product("ua", repeat=n)]
    found = []
    for script in product(gap, *[x for e in edits for x in (e, gap)]):
        if re.fullmatch("(s?(ua)+)?", "".join(x[2] for x in script)):
            found.append((sum(x[0] for x in script), "".join(x[1] for x in script)))
    return min(found)


def all_splits(cells):
    """CYK with every split point of every span."""
    n, table = len(cells), {}
    for length in range(1, n + 1):
        for i in range(n - length + 1):
            if length == 1:
                table[i, 1] = cells[i]
                continue
            cell = {}
            for k in range(1, length):
                for key, value in repair.join(table[i, k], table[i + k, length - k]).items():
                    cell[key] = min(cell.get(key, value), value)
            table[i, length] = cell
    return repair.best(table[0, n])


def test_cells_equal_every_script_and_every_split():
    rnd = random.Random(3)
    kinds = [(i, g, t and not g) for i in ("s", "u", "a", "t") for g in (False, True) for t in (False, True)]
    for n in (1, 2, 2, 3, 3, 3):
        for _ in range(6):
            rows = [rnd.choice(kinds) for _ in range(n)]
            spans = repair.Spans()
            for r in rows:
                spans.add(repair.row_cell(*r))
            assert repair.best(spans.whole()) == every_script(rows), rows
    for n in (4, 7, 12, 17):
        for _ in range(5):
            cells = [repair.row_cell(*rnd.choice(kinds)) for _ in range(n)]
            spans = repair.Spans()
            for c in cells:
                spans.add(c)
            assert repair.best(spans.whole()) == all_splits(cells)
    assert repair.best(repair.Spans().whole()) == (0, "")


def plain_repair(rows):
    """rows: (turn, role, text) in order -> the contract's columns, edits from the cells."""
    seen, last, cells, out = set(), None, [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            out[fault] += 1
        if last is not None and last + role[:1] not in ("su", "ua", "au"):
            out["illegal"] += 1
        last = role[:1]
        cells.append(repair.row_cell(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    out["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    spans = repair.Spans()
    for c in cells:
        spans.add(c)
    out["cost"], out["audit"] = repair.best(spans.whole())
    said, state, left = [], "", list(rows)
    for edit in out["audit"]:
        _, role, text = left.pop(0) if edit != "I" else (None, None, "")
        if edit != "K" and edit != "D":
            role = "assistant" if state.endswith("u") else "user"
        if edit != "D":
            state += role[0]
            said.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", state)
    out["repaired_sha256"] = hashlib.sha256("\n".join(said).encode()).hexdigest()
    return out


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(conv, [])
        if k:
            role = "user" if k == 4 else role
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def conversations():
    rnd = random.Random(5)
    texts = ["Yes.", "No", "", " \t", None, "So?\n", "é", "x " * 30_000 + ".", "a\x85", "Long ago. And"]
    rows = []
    for conv in [None, *range(-2, 60)]:
        for t in range(rnd.randint(1, 12)):
            rows.append((conv, rnd.choice([t, t, t, None, t * 3]), rnd.choice(["user", "assistant", "system", "tool", None]), rnd.choice(texts)))
    rows += rows[:20]
    roles = ["user", "assistant"]
    rows += [(1000, t, roles[t % 2] if t % 17 else "system", f"Text {t % 900}.") for t in range(5000)]
    rows += [(1001, 7, "user", "Same.")] * 700
    return rows


def test_structure_repair(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("kind", "audit", "digest", "head", "part", "copies"):
        df = df.withColumn(name, F.lit("x"))
    df.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_structure_repair(spark, str(tmp_path)).collect()
    want = plain_damage(rows)
    assert len(got) == len(want)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    for r in got:
        assert {k: r[k] for k in names} == plain_repair(want[r["conv_id"]]), r["conv_id"]


def test_structure_repair_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_structure_repair(spark, str(tmp_path)).count() == 0


# ---- whitening


def check_eigen(r, tolerance=1e-10):
    values, vectors = whitening.eigen(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    want = np.concatenate([want, np.zeros(r.shape[1] - len(want))])
    top = max(want[0], 1e-300)
    assert np.all(np.abs(values - want) <= 1e-12 * top)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < tolerance
    assert np.abs(r.T @ r @ vectors - vectors * values).max() <= 1e-11 * top


def test_solver():
    rng = np.random.default_rng(4)
    for m in (1, 2, 3, 8, 33, 64):
        for _ in range(3):
            check_eigen(np.linalg.qr(rng.standard_normal((3 * m, m)))[1])
    check_eigen(np.linalg.qr(rng.standard_normal((5, 12)))[1])                       # fewer rows than dimensions
    check_eigen(np.diag(rng.standard_normal(9)))
    check_eigen(np.eye(10))                                                          # one value, ten times
    check_eigen(np.zeros((4, 4)))
    u, v = (np.linalg.qr(rng.standard_normal((20, 20)))[0] for _ in range(2))
    for spectrum in ([1.0] * 10 + [2.0] * 10, [1 + 1e-9 * i for i in range(20)], [10.0 ** -i for i in range(20)],
                     [1.0] * 19 + [0.0], [5.0] * 3 + [1e-3] * 17):
        check_eigen(np.linalg.qr(u @ np.diag(spectrum) @ v)[1])
    wilkinson = np.diag(np.abs(np.arange(-10, 11)).astype(float) + 3) + np.diag(np.ones(20), 1)
    check_eigen(wilkinson)


def test_dqds_is_accurate_for_small_values():
    d, e = [1.0, 1e-3, 1e-6, 1e-9], [1e-2, 1e-5, 1e-8]
    got = whitening.dqds(d, e)
    import decimal
    decimal.getcontext().prec = 60
    # The product of all values is the squared determinant, exactly the diagonal's product.
    assert math.isclose(math.prod(got), math.prod(x * x for x in d), rel_tol=1e-13)


VECTORS = [[0.5, -1.0, 2.0], [1.0, 0.25, -3.0], [0.0, 0.1, 0.2], [4.0, -2.0, 1.0], [0.5, -1.0, 2.0], None,
           [1.0, None, 2.0], [1.0, float("nan"), 0.0], [1.0, float("inf"), 0.0], [], [1.0, 2.0], [9.0, 9.0, 8.0]]


def plain_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    away = x * n - s
    centred = away / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return n, (away * away).sum(axis=1), centred @ vecs[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_rows(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(VECTORS)), "vec_id long, embedding array<float>").withColumns(
        {c: F.lit("x") for c in ("x", "n", "part", "r", "dim", "label")})
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_whitening(spark, str(tmp_path)).collect()
    kept = [0, 1, 2, 3, 4, 11]
    n, deviation, whitened, explained = plain_whitening([VECTORS[i] for i in kept])
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(i, c) for i in kept for c in (1, 2, 3)]
    signs = {}
    for r in got:
        i, c = kept.index(r["vec_id"]), r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], explained[c], rel_tol=1e-9)
        signs.setdefault(c, set()).add(round(r["whitened"] / whitened[i, c], 7))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values())


def test_whitening_table(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviation, whitened, explained = plain_whitening([r["embedding"] for r in rows])
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = queries.op11_whitening(spark, SF).collect()
    assert len(got) == 8 * len(rows)
    for r in got:
        i = at[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
    for c in range(8):
        values = np.array([r["whitened"] for r in sorted(got, key=lambda r: at[r["vec_id"]]) if r["component"] == c + 1])
        sign = np.sign(values @ whitened[:, c])
        assert np.abs(values * sign - whitened[:, c]).max() < 1e-9


def test_triangles_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(11)
    rows = whitening.usable(df)
    model = whitening.fit(rows)
    assert whitening.identity_error(rows, model) < 1e-9 and model.n == df.count()


def test_whitening_without_variance(spark, tmp_path):
    for k, rows in enumerate(([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None], [[]])):
        spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        assert queries.op11_whitening(spark, f"{tmp_path}/{k}").collect() == []
    # A constant and a dependent dimension: two components are left.
    rng = np.random.default_rng(1)
    rows = [[float(a), 1.0, float(a), float(b)] for a, b in rng.integers(-50, 50, (40, 2))]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/d/embeddings.parquet")
    got = queries.op11_whitening(spark, f"{tmp_path}/d").collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 80 and got[0]["identity_error"] < 1e-9


def test_deviation_beyond_a_long():
    model = whitening.Fit(2, (0, 0), np.ones(1), np.ones((1, 2)), 1.0)
    x = np.array([[2 ** 61, 0], [3, 4]], dtype=np.int64)
    assert whitening._exact_deviation(x, model) == [None, 100]


# ---- URL rules

URLS = ["http://a.example.org/es/1", "https://ORG/x", "http://b.org", "http://c.example.org/en/12?x=1#t", "http://c.example.org/en/21",
        "https://shop.com/fr/", "https://shop.com/de/a.html", "https://shop.com/it/a.html", "ftp://de.net/de/9", "no scheme", None, "",
        "http://Éxample.ORG/es/", "http://a.org:80/x", "http://x.net?u=http://b.org/", "http://user@a.org/", "http://xorg/", "://org/", "http://",
        "http://n.net/" + "s/" * 20_000]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", after).group()
    path = re.match(r"[^?#]*", after[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def plain_rule(host, path):
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_listed_rules(spark, tmp_path):
    rows = [(i, u) for i, u in enumerate(URLS + URLS[:3])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("html", "row", "hit", "id", "tokens", "host")})
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op12_url_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        rule = plain_rule(*plain_parts(url))
        assert (got[i]["host"], got[i]["path"]) == plain_parts(url)
        assert got[i]["rule"] == (rule.text if rule else None)
        assert got[i]["verdict"] == rule.verdict if rule else got[i]["verdict"] in ("allow", "block")
    judged = urlrules.judge(df, queries.URL_RULES, urlrules.fit(df.select("url", F.lit(None).cast("string").alias("label"))))
    assert judged.columns == [*df.columns, "judged"] and judged.filter("judged.rule is null and judged.verdict <> 'allow'").count() == 0


def test_no_urls(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op12_url_rules(spark, str(tmp_path)).count() == 0


def labelled(n=300):
    rnd = random.Random(8)
    hosts = ["shop", "win-casino", "blog", "news", "cheap-casino"]
    rows = []
    for i in range(n):
        host, lang, page = rnd.choice(hosts), rnd.choice(["en", "de", "fr"]), rnd.randrange(40)
        bad = "casino" in host or (host == "shop" and lang == "de")
        rows.append((f"http://{host}.example.{rnd.choice(['com', 'net'])}/{lang}/{page}" + rnd.choice(["", "?ref=1", "#top", ".html"]),
                     "block" if bad != (rnd.random() < 0.03) else "allow"))
    return rows


def plain_rules(rows, tokens, least, confidence):
    """All rules by counting every antecedent of every URL."""
    counts, with_label = {}, {}
    for key in sorted(set(rows)):
        for k in range(1, len(tokens[key[0]]) + 1):
            for a in combinations(tokens[key[0]], k):
                counts[a] = counts.get(a, 0) + 1
                with_label[a, key[1]] = with_label.get((a, key[1]), 0) + 1
    rules = {(a, v): (n / counts[a], n) for (a, v), n in with_label.items() if n >= least and n / counts[a] >= confidence}
    return {k: x for k, x in rules.items() if not any(
        (s := (k[0][:i] + k[0][i + 1:], k[1])) in rules and rules[s][0] >= x[0] for i in range(len(k[0])))}


def test_mined_rules_and_matches(spark):
    rows = labelled()
    df = spark.createDataFrame(rows + rows[:50], "url string, label string")
    rules = urlrules.fit(df, min_support=0.02)
    read = df.select("url", urlrules.tokens(F.col("url"), urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url"))).alias("t"))
    tokens = {r["url"]: tuple(r["t"]) for r in read.collect()}
    assert all(list(t) == sorted(set(t)) and len(t) <= urlrules.ITEMS for t in tokens.values())
    total = len(set(rows))
    want = plain_rules(rows, tokens, max(2, 0.02 * total), urlrules.MIN_CONFIDENCE)
    got = {(tuple(r["antecedent"]), r["verdict"]): (r["confidence"], r["support"]) for r in rules.collect()}
    assert got == want and len(want) > 5
    judged = urlrules.judge(df, [], rules).collect()
    for r in judged:
        fire = [(c, n, -len(a), v == "allow", [-ord(x) for x in " ".join(a)], v, a) for (a, v), (c, n) in want.items() if set(a) <= set(tokens[r["url"]])]
        if not fire:
            assert r["judged"]["verdict"] == "allow" and r["judged"]["antecedent"] is None
            continue
        top = max(f[:4] for f in fire)
        a, v = min((f[6], f[5]) for f in fire if f[:4] == top)
        assert (tuple(r["judged"]["antecedent"]), r["judged"]["verdict"], r["judged"]["confidence"]) == (a, v, top[0])
    right = sum(("casino" in u or ("shop" in u and "/de/" in u)) == (v == "block") for u, v in ((r["url"], r["judged"]["verdict"]) for r in judged))
    assert right / len(judged) > 0.97


def test_only_the_telling_tokens_are_mined(spark):
    """A third of the URLs share a path of 60 segments; a URL still gives at most ITEMS tokens."""
    long_path = "/".join(f"seg{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = labelled(100) + [(f"http://copy.example.com/{long_path}/{chr(97 + i % 26)}{chr(97 + i // 26)}", "block") for i in range(50)]
    df = spark.createDataFrame(rows, "url string, label string")
    rules = urlrules.fit(df, min_support=0.02)
    assert 0 < rules.count() < 2 ** urlrules.ITEMS
    copies = urlrules.judge(df, [], rules).filter("url like '%copy.example%'").select("judged.*").collect()
    assert len(copies) == 50 and {(r["verdict"], r["confidence"]) for r in copies} == {("block", 1.0)}


@pytest.mark.parametrize("k", [1, 3])
def test_ratio_is_zero_for_the_overall_rate(spark, k):
    v = spark.range(1).select(urlrules._ratio(F.lit(k * 2), F.lit(k * 4), F.lit(50), F.lit(100)).alias("v")).head()["v"]
    assert abs(v) < 1e-12
