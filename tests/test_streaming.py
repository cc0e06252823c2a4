"""Batch = stream for the stateful operators, and the late-row rule."""
import datetime as dt

from pyspark.sql import functions as F

from pagemark.operators import folds
from pagemark.streaming import stateful as W
from pagemark.streaming.replay import run_stream

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)
BUCKET = folds.Bucket(capacity=3, period_us=10_000_000)  # 3 tokens, one per 10 s


def _rows(spark, rows):
    return spark.createDataFrame(rows, "id long, ts timestamp, scope_type string, identity string")


def test_token_bucket_stream_equals_batch(spark):
    rows = []
    i = 0
    for minute in range(6):  # six one-minute chunks, bursts of 5 per identity
        for ident in ("a", "b"):
            for k in range(5):
                rows.append((i, T0 + dt.timedelta(minutes=minute, seconds=k), "http", ident))
                i += 1
    src = _rows(spark, rows)
    batch = folds.token_bucket(src.withColumn("ts_us", F.unix_micros("ts")), "identity", "ts_us", "id", BUCKET)
    want = {r.id: (r.allowed, r.tokens_after) for r in batch.collect()}
    out = run_stream(spark, "t_bucket", src, "ts", lambda s: W.token_bucket_stream(s, BUCKET))
    got = {r.id: (r.allowed, r.tokens_after) for r in out.collect()}
    assert got == want
    assert sum(not a for a, _ in want.values()) == 2 * 6 * 2  # 3 of each burst of 5 pass


def test_late_row_gets_no_refill(spark):
    # Batch 1: three requests drain the bucket at t=20s. Batch 2 (later file):
    # a row stamped t=5s (older than the stored last) gets no refill and is
    # rejected; then t=30s has refilled one token.
    rows1 = [(1, T0 + dt.timedelta(seconds=20), "http", "x"), (2, T0 + dt.timedelta(seconds=20), "http", "x"),
             (3, T0 + dt.timedelta(seconds=20), "http", "x")]
    rows2 = [(4, T0 + dt.timedelta(seconds=5), "http", "x"), (5, T0 + dt.timedelta(seconds=30), "http", "x")]
    src = _rows(spark, rows1 + rows2).withColumn(
        "ts2", F.when(F.col("id") <= 3, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 100 SECONDS")))
    # Files are cut by ts2 (arrival order), the operator sees ts (event time).
    out = run_stream(spark, "t_late", src.drop("ts").withColumnRenamed("ts2", "arrival").withColumn(
        "ts", F.when(F.col("id") == 4, F.lit(T0 + dt.timedelta(seconds=5)))
        .when(F.col("id") == 5, F.lit(T0 + dt.timedelta(seconds=30))).otherwise(F.col("arrival"))),
        "arrival", lambda s: W.token_bucket_stream(s.drop("arrival"), BUCKET))
    got = {r.id: r.allowed for r in out.collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True}


SNAPS = "url string, ts timestamp, elapsed_ms long, md string, poll_budget_ms long, poll_interval_ms long, is_end boolean"


def test_snapshot_timer_ends_state(spark):
    """No further poll arrives: the timer reports the last one and removes the
    state; a later render of the same URL starts afresh."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("u", at(0), 0, "a", 1000, 250, False), ("u", at(0.25), 250, "b", 1000, 250, False),
            ("other", at(100), 0, "x", 1000, 250, False), ("other", at(100.25), 250, "x", 1000, 250, False),
            ("other", at(100.5), 500, "y", 1000, 250, False),  # after the result: ignored
            ("tick", at(200), 0, None, 1000, 250, True), ("tick2", at(300), 0, None, 1000, 250, True),
            ("u", at(400), 0, "c", 1000, 250, False), ("u", at(400.25), 250, "c", 1000, 250, False)]
    src = spark.createDataFrame(rows, SNAPS)
    out = run_stream(spark, "t_snap", src, "ts", lambda s: W.snapshot_stream(s), phases=4)
    got = sorted((r.url, r.polls, r.how, r.md) for r in out.collect() if not r.url.startswith("tick"))
    assert got == [("other", 2, "stable", "x"), ("u", 2, "exhausted", "b"), ("u", 2, "stable", "c")]


def test_static_gate_streams_with_many_versions(spark):
    """The as-of join of key versions is one plan that a stream can run."""
    from pagemark.operators import policy as P
    keys = spark.createDataFrame([(T0 + dt.timedelta(hours=5 * k), f"k{k % 3}") for k in range(40)], "loaded_at timestamp, key string")
    rows = [(i, T0 + dt.timedelta(minutes=37 * i), f"key=k{i % 3}") for i in range(-3, 400)]
    src = spark.createDataFrame(rows, "id long, ts timestamp, query_string string")
    want = {i: 0 <= 37 * i and (min(37 * i // 300, 39)) % 3 == i % 3 for i, _, _ in rows}
    batch = {r.id: r.key_ok for r in P.key_check(src, keys).collect()}
    assert batch == want
    out = run_stream(spark, "t_gate", src, "ts", lambda s: W.static_gate_stream(s, keys))
    assert {r.id: r.key_ok for r in out.collect()} == want


def _run_on(spark, path, batches, build):
    """Each batch of rows appended and run from the same checkpoint."""
    for df in batches:
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
        (build(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/chk").option("path", f"{path}/out")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{path}/out")


def _keys_in_state(spark, path):
    rows = spark.read.format("statestore").option("stateVarName", "state").load(f"{path}/chk").collect()
    return sorted(r["key"][0] for r in rows)


def test_state_ends_with_its_time(spark, tmp_path):
    """Once the watermark has passed a bucket's idle time, a verdict's expiry or a render's
    budget, only the rows that moved it there are left in the state."""
    day = dt.timedelta(days=1)
    requests = [_rows(spark, [(k, T0 + dt.timedelta(seconds=k), "http", f"c{k % 3}") for k in range(9)]),
                _rows(spark, [(100, T0 + day, "http", "late")]), _rows(spark, [(101, T0 + 2 * day, "http", "later")])]
    _run_on(spark, f"{tmp_path}/b", requests, lambda s: W.token_bucket_stream(s, BUCKET))
    assert _keys_in_state(spark, f"{tmp_path}/b") == ["later"]
    lookups = [r.select("id", "ts", F.col("identity").alias("host"), F.lit(80).alias("port")) for r in requests]
    _run_on(spark, f"{tmp_path}/r", lookups, lambda s: W.decision_reuse_stream(s, 60_000_000))
    assert _keys_in_state(spark, f"{tmp_path}/r") == ["later"]
    caps = [r.select(F.col("identity").alias("url"), "ts", F.lit(0).cast("long").alias("elapsed_ms"), F.lit("m").alias("md"),
                     F.lit(1000).cast("long").alias("poll_budget_ms"), F.lit(250).cast("long").alias("poll_interval_ms"), F.lit(False).alias("is_end"))
            for r in requests]
    out = _run_on(spark, f"{tmp_path}/s", caps, W.snapshot_stream)
    assert _keys_in_state(spark, f"{tmp_path}/s") == ["later"]
    assert sorted(r.url for r in out.where("how = 'exhausted'").collect()) == ["c0", "c1", "c2", "late"]


def test_later_render_without_timer(spark, tmp_path):
    """Two renders of one URL in one micro-batch: the first ends where the second begins."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("u", at(400.25), 250, "c", 1000, 250, False), ("u", at(0.25), 250, "b", 1000, 250, False), ("u", at(400), 0, "c", 1000, 250, False), ("u", at(0), 0, "a", 1000, 250, False)]
    out = _run_on(spark, str(tmp_path), [spark.createDataFrame(rows, SNAPS)], W.snapshot_stream)
    assert sorted((r.polls, r.how, r.md) for r in out.collect()) == [(2, "exhausted", "b"), (2, "stable", "c")]


def test_first_lookups(spark, tmp_path):
    """One row of a key per horizon; a new one once the watermark has passed it."""
    rows = lambda *r: spark.createDataFrame([(i, "h", p, T0 + dt.timedelta(seconds=s)) for i, p, s in r], "id long, host string, port int, ts timestamp")
    batches = [rows((1, 80, 0), (2, 80, 0), (3, 443, 0)), rows((4, 80, 50), (5, 443, 59)), rows((6, 22, 200)), rows((7, 80, 260), (8, 443, 261))]
    out = _run_on(spark, str(tmp_path), batches, lambda s: W.first_lookups_stream(s, "60 seconds"))
    got = sorted(r.id for r in out.collect())
    assert len(got) == 5 and got[0] in (1, 2) and got[1:] == [3, 6, 7, 8]
