"""Request policy (L1-L12): the reference has no tests here; these pin the
code's semantics (rate boundary, refill kept on reject, precedence, keys,
rotation, header precedence, redaction)."""
import bisect
import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from pagemark.operators import folds
from pagemark.operators import policy as P
from pagemark.sources import derived

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _req(i, ts, path="/mcp", query="key=k1", headers=(), peer="9.9.9.9", scope="http"):
    return (i, ts, scope, path, query, [{"name": n, "value": v} for n, v in headers], peer)


def _requests(spark, rows):
    return spark.createDataFrame(rows, "id long, ts timestamp, scope_type string, path string, "
                                       "query_string string, headers array<struct<name:string,value:string>>, "
                                       "client_ip string")


def _keys(spark, lines=(("2024-01-01 00:00:00", ["k1", "# old", " k2 ", ""]),)):
    rows = [(ts, i, line) for ts, ls in lines for i, line in enumerate(ls)]
    df = spark.createDataFrame(rows, "loaded_at string, line_no int, line string")
    return P.key_set(df.withColumn("loaded_at", F.to_timestamp("loaded_at")))


def test_rate_boundary_and_refill(spark):
    rows = [_req(i, T0) for i in range(21)]
    rows.append(_req(21, T0 + dt.timedelta(seconds=1)))  # 0.5 token: still rejected
    rows.append(_req(22, T0 + dt.timedelta(seconds=2)))  # refilled to 1 token: passes
    d = {r["id"]: r for r in P.policy(_requests(spark, rows), _keys(spark)).collect()}
    assert [d[i]["status"] for i in range(20)] == [None] * 20
    assert d[20]["status"] == 429 and d[21]["status"] == 429
    assert d[22]["status"] is None
    assert d[21]["tokens_after"] == 1_000_000  # rejected request keeps its refill


def test_precedence_and_keys(spark):
    rows = [_req(i, T0) for i in range(20)]  # drain the bucket of 9.9.9.9
    rows += [_req(20, T0, path="/.well-known/x")]  # rate first
    rows += [_req(30, T0, path="/.well-known", peer="1.1.1.1"),
             _req(31, T0, path="/.well-known/oauth", peer="1.1.1.1"),
             _req(32, T0, path="/.well-knownx", query="", peer="1.1.1.1"),
             _req(33, T0, query="key=", peer="1.1.1.1"),
             _req(34, T0, query="v=1", peer="1.1.1.1"),
             _req(35, T0, query="key=nope", peer="1.1.1.1"),
             _req(36, T0, query="key=&key=k2", peer="1.1.1.1"),
             _req(37, T0, query="key=k%31", peer="1.1.1.1"),
             _req(38, T0, scope="websocket", peer="1.1.1.1")]
    d = {r["id"]: r for r in P.policy(_requests(spark, rows), _keys(spark)).collect()}
    assert d[20]["status"] == 429
    assert d[30]["status"] == 404 and d[31]["status"] == 404 and d[32]["status"] == 401
    assert d[33]["status"] == 401 and d[34]["status"] == 401 and d[35]["status"] == 401
    assert d[36]["status"] is None and d[37]["status"] is None
    assert d[38]["reason"] == "passed (not http)"


def test_empty_key_set_denies(spark):
    d = P.policy(_requests(spark, [_req(1, T0)]), _keys(spark, (("2024-01-01 00:00:00", ["# none"]),)))
    assert d.collect()[0]["status"] == 401


def test_query_decoding(spark):
    df = spark.createDataFrame([("key=&key=a+b%20c",), ("x=1",), ("key=k3&key=k4",)], "q string")
    from pagemark.functions.urls import query_param
    got = [r[0] for r in df.select(query_param(F.col("q"), "key")).collect()]
    assert got == ["a b c", "", "k3"]


def test_key_rotation(spark):
    keys = _keys(spark, (("2024-01-01 00:00:00", ["k1", "k2"]), ("2024-01-15 00:00:00", ["k2", "k3"])))
    rows = [_req(1, dt.datetime(2024, 1, 10), query="key=k1", peer="a"),
            _req(2, dt.datetime(2024, 1, 20), query="key=k1", peer="b"),
            _req(3, dt.datetime(2024, 1, 20), query="key=k3", peer="c"),
            _req(4, dt.datetime(2023, 12, 31), query="key=k1", peer="d"),
            _req(5, dt.datetime(2024, 1, 15), query="key=k2", peer="e")]
    d = {r["id"]: r["key_ok"] for r in P.key_check(_requests(spark, rows), keys).collect()}
    assert d == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_header_precedence(spark):
    rows = [_req(1, T0, headers=[("X-Forwarded-For", "1.1.1.1, 2.2.2.2")]),
            _req(2, T0, headers=[("X-Forwarded-For", "1.1.1.1"), ("CF-Connecting-IP", "3.3.3.3")]),
            _req(3, T0, headers=[("x-forwarded-for", ""), ("X-Forwarded-For", " 4.4.4.4 ")]),
            _req(4, T0, headers=[("cf-connecting-ip", "")], peer=None),
            _req(5, T0, headers=[], peer="5.5.5.5")]
    got = {r["id"]: r["identity"] for r in P.client_identity(_requests(spark, rows)).collect()}
    assert got == {1: "1.1.1.1", 2: "3.3.3.3", 3: "4.4.4.4", 4: "unknown", 5: "5.5.5.5"}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "/mcp?key=abc&x=1", ["GET /mcp?key=s3cr3t", "x"]),
                                (2, "key=abc at start", ["&key=a b"])], "id long, msg string, args array<string>")
    got = {r["id"]: r for r in P.redacted_log(df).collect()}
    assert got[1]["msg"] == "/mcp?key=REDACTED&x=1"
    assert got[1]["args"] == ["GET /mcp?key=REDACTED", "x"]
    assert got[2]["msg"] == "key=abc at start"
    assert got[2]["args"] == ["&key=REDACTED b"]


def test_lookup_reuse_ttl(spark):
    rows = [(1, "h", 80, 0), (2, "h", 80, 59_999_999), (3, "h", 80, 60_000_000), (4, "h", 443, 1),
            (5, "h", 80, 60_000_001)]
    df = spark.createDataFrame(rows, "id long, host string, port int, ts_us long")
    got = {r["id"]: r["hit"] for r in folds.decision_reuse(df, ["host", "port"]).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}
    zero = {r["id"]: r["hit"] for r in folds.decision_reuse(df, ["host", "port"], ttl_us=0).collect()}
    assert not any(zero.values())


def test_key_lines_and_hosts(spark):
    got = sorted(r.key for r in _keys(spark, (("2024-01-01 00:00:00", ["k1", " k2 ", "", "# old", "  # old"]),))
                 .collect())
    assert got == ["k1", "k2"]
    hosts = sorted(r.host for r in P.allowed_hosts(derived.ALLOWED_HOSTS_OPTION, spark).collect())
    assert hosts == ["127.0.0.1", "[::1]", "localhost"]


def _plain_bucket(rows, bucket):
    state, out = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        level, last = state.get(key, (bucket.cap_units, t))
        level = min(bucket.cap_units, level + t - last)
        ok = level >= bucket.period_us
        level -= bucket.period_us if ok else 0
        state[key] = (level, t)
        out[i] = (ok, level)
    return out


def _plain_reuse(rows, ttl):
    expiry, out = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = key in expiry and expiry[key] > t
        if not out[i]:
            expiry[key] = t + ttl
    return out


def _traffic(rnd, n):
    """A key with most rows and hardly a gap, bursts, ties, rare keys, a null key."""
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 0, 1, 3, 10, 40, 90])
        rows.append((i, rnd.choice(["hot"] * 8 + ["b", "c", None]), t))
    rows += [(n + i, "slow", 1000 * i) for i in range(20)] + [(n + 100 + i, "burst", 5000) for i in range(30)]
    rnd.shuffle(rows)
    return rows


def test_folds_equal_the_plain_rules(spark):
    rnd = random.Random(9)
    for n, bucket, ttl, block in ((1500, folds.Bucket(3, 50), 70, 200), (1500, folds.Bucket(5, 17), 300, 64), (800, folds.Bucket(1, 7), 1, 1000),
                                  (800, folds.Bucket(20, 400), 5000, 50), (600, folds.Bucket(2, 1), 40, 10 ** 9)):
        rows = _traffic(rnd, n)
        df = spark.createDataFrame(rows, "id long, identity string, ts_us long").withColumn("block", F.lit("x"))
        got = folds.token_bucket(df, bucket=bucket, block_us=block)
        assert got.columns == ["id", "identity", "ts_us", "block", "allowed", "tokens_after"]
        assert {r["id"]: (r["allowed"], r["tokens_after"]) for r in got.collect()} == _plain_bucket(rows, bucket)
        reuse = folds.decision_reuse(df, ["identity"], ttl_us=ttl, block_us=block)
        assert {r["id"]: r["hit"] for r in reuse.collect()} == _plain_reuse(rows, ttl)


def test_steps_equal_the_fold():
    """The step function of a block, at every entering state, against the rows one by one."""
    rnd = random.Random(10)
    for _ in range(60):
        bucket = folds.Bucket(rnd.randint(1, 5), rnd.randint(1, 9))
        times = np.cumsum([rnd.choice([0, 1, 2, 5, 20]) for _ in range(rnd.randint(1, 30))])
        levels, expiries = folds.Levels(bucket), folds.Expiries(rnd.randint(1, 15))
        for part in np.array_split(times, 3):
            if len(part):
                levels.feed(part)
                expiries.feed(part)
        assert len(levels.steps()) <= 4 * bucket.capacity + 4
        for level in range(bucket.cap_units + 1):
            want, last = level, times[0]
            for t in times:
                want = min(bucket.cap_units, want + t - last)
                want -= bucket.period_us if want >= bucket.period_us else 0
                last = t
            assert folds.apply_steps(levels.steps(), level) == want
        for expiry in range(-3, int(times[-1]) + 20):
            want = expiry
            for t in times:
                want = want if want > t else t + expiries.ttl
            assert folds.apply_steps(expiries.steps(), expiry) == want


def test_a_hot_key_without_gaps_is_many_blocks(spark):
    """One identity with all rows and no idle gap: every block is entered by its own state."""
    bucket = folds.Bucket(3, 100)
    df = spark.range(20_000).select("id", F.lit("hot").alias("identity"), (F.col("id") * 60).alias("ts_us"))
    d, keys = folds._keyed(df, ["identity"])
    parts = folds.segments(d, keys, "ts_us", "id", bucket.cap_units, 10_000)
    assert parts.select("_seg").distinct().count() == 1 and parts.select("_block").distinct().count() == 120
    got = {r["id"]: (r["allowed"], r["tokens_after"]) for r in folds.token_bucket(df, bucket=bucket, block_us=10_000).collect()}
    assert got == _plain_bucket([(i, "hot", 60 * i) for i in range(20_000)], bucket)


def test_asof_with_many_versions(spark):
    """Ten thousand versions on one day, requests on and between them, before the first
    and long after the last, and one without a time."""
    rnd = random.Random(12)
    day = dt.datetime(2024, 3, 1)
    loads = sorted({rnd.randrange(86_400_000_000) for _ in range(10_000)})
    at = [-1, 0, *loads[:200], *(x - 1 for x in loads[:200]), *(rnd.randrange(-10 ** 10, 10 ** 13) for _ in range(2000))]
    versions = spark.createDataFrame([(day + dt.timedelta(microseconds=x), f"k{i}") for i, x in enumerate(loads)], "loaded_at timestamp, key string")
    rows = [(i, day + dt.timedelta(microseconds=x)) for i, x in enumerate(at)] + [(-1, None)]
    got = {r["id"]: r["loaded_at"] for r in P.key_asof(spark.createDataFrame(rows, "id long, ts timestamp"), versions).collect()}
    for i, x in enumerate(at):
        k = bisect.bisect_right(loads, x)
        assert got[i] == (day + dt.timedelta(microseconds=loads[k - 1]) if k else None)
    assert got[-1] is None
    assert P.key_asof(spark.createDataFrame(rows, "id long, ts timestamp"), versions.limit(0)).where("loaded_at is not null").count() == 0
