"""Structured Streaming forms of the stateful operators.

W1-W3 are stateful processors (``transformWithStateInPandas``): value state per key,
event-time timers that end it. A processor takes a key's rows of a micro-batch
chunk by chunk; what it holds of them are times and ids (W1, W2), which it puts in
order, or the few captures of one render (W3). Late rows (behind the watermark) are
dropped by Spark; a row older than the stored ``last`` gets no refill and does not
move ``last`` back. State ends only once it can no longer change a verdict: a bucket
idle for its full refill time is full again, a cached verdict is dead at its
expiry, a render is over with its budget.

W4 joins streams with static tables: requests with key sets by version, URLs with
address classes and host verdicts.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pagemark.operators import admission as ADM
from pagemark.operators import folds
from pagemark.operators import policy as P

CHUNK = 10_000   # rows of one frame given out


def _ordered(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """(ts_us, id) of a key's rows in a micro-batch, by time and id; nothing else is held."""
    parts = [(pdf["ts_us"].to_numpy(dtype=np.int64), pdf["id"].to_numpy(dtype=np.int64)) for pdf in rows]
    ts, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.lexsort((ids, ts))
    return ts[order], ids[order]


class _Timed(StatefulProcessor):
    """One value state and one event-time timer per key."""

    STATE = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)
        self.timer = handle.getValueState("timer", "at long")

    def keep(self, value: tuple, until_ms: int) -> None:
        """Store ``value`` and let the timer end it after ``until_ms``."""
        self.state.update(value)
        before = self.timer.get()[0] if self.timer.exists() else None
        if before != until_ms:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until_ms)
            self.timer.update((until_ms,))

    def drop(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.state.clear()
        self.timer.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


BUCKET_OUT = "id long, identity string, allowed boolean, tokens_after long"


class TokenBucket(_Timed):
    """Level and time of the last request."""

    STATE = "tokens long, last long"

    def __init__(self, bucket: folds.Bucket, idle_us: int):
        self.cap, self.cost, self.idle_us = bucket.cap_units, bucket.period_us, idle_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts, ids = _ordered(rows)
        tokens, last = self.state.get() if self.state.exists() else (self.cap, int(ts[0]))
        for at in range(0, len(ts), CHUNK):
            allowed, level = [], []
            for t in ts[at:at + CHUNK].tolist():
                tokens = min(self.cap, tokens + max(0, t - last))
                ok = tokens >= self.cost
                tokens -= self.cost if ok else 0
                last = max(last, t)
                allowed.append(ok)
                level.append(tokens)
            yield pd.DataFrame({"id": ids[at:at + CHUNK], "identity": key[0], "allowed": allowed, "tokens_after": level})
        self.keep((int(tokens), int(last)), (last + self.idle_us) // 1000)


def token_bucket_stream(requests: DataFrame, bucket: folds.Bucket, watermark: str = "1 hour") -> DataFrame:
    """W1 = L2 on a request stream (id, ts, scope_type, identity columns)."""
    http = requests.where(F.col("scope_type") == "http").select(
        "id", "ts", "identity", F.unix_micros("ts").alias("ts_us"))
    idle = max(folds.IDLE_EVICT_US, bucket.cap_units)
    return (http.withWatermark("ts", watermark).groupBy("identity")
            .transformWithStateInPandas(TokenBucket(bucket, idle), BUCKET_OUT, "Append", "EventTime"))


REUSE_OUT = "id long, host string, port long, hit boolean"


class Reuse(_Timed):
    """Expiry of the verdict made by the last miss; gone at that time."""

    STATE = "expiry long"

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts, ids = _ordered(rows)
        expiry = self.state.get()[0] if self.state.exists() else int(ts[0])
        hit = np.ones(len(ts), dtype=bool)
        at = int(np.searchsorted(ts, expiry))
        while at < len(ts):
            hit[at] = False
            expiry = int(ts[at]) + self.ttl_us
            at = max(at + 1, int(np.searchsorted(ts, expiry)))
        for at in range(0, len(ts), CHUNK):
            yield pd.DataFrame({"id": ids[at:at + CHUNK], "host": key[0], "port": int(key[1]), "hit": hit[at:at + CHUNK]})
        self.keep((int(expiry),), expiry // 1000 + 1)


def decision_reuse_stream(lookups: DataFrame, ttl_us: int, watermark: str = "1 hour") -> DataFrame:
    """W2 = B14 on a lookup stream (id, host, port, ts)."""
    lk = lookups.select("id", "host", F.col("port").cast("long").alias("port"), "ts",
                        F.unix_micros("ts").alias("ts_us"))
    return (lk.withWatermark("ts", watermark).groupBy("host", "port")
            .transformWithStateInPandas(Reuse(ttl_us), REUSE_OUT, "Append", "EventTime"))


def first_lookups_stream(lookups: DataFrame, ttl: str) -> DataFrame:
    """W2, close variant: the first lookup of a (host, port) seen within the watermark's
    delay ``ttl``, by ``dropDuplicatesWithinWatermark``. It differs from ``decision_reuse``
    at the boundary: a key is forgotten when the *watermark* (latest event time less
    ``ttl``) passes its lookup by ``ttl``, so a verdict may be reused for longer than its
    TTL, until a micro-batch has moved the watermark on; and which of a key's rows
    in one micro-batch counts as its first is Spark's choice."""
    return lookups.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["host", "port"])


def static_gate_stream(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Stream-static joins of the request stream with the key versions
    (an equi-join on days, one row for the newest) and the key set."""
    return P.key_check(requests, keys).select("id", "presented", "key_ok")


def admission_stream(urls: DataFrame, resolutions: DataFrame, col: str = "url") -> DataFrame:
    """Admission verdict of each URL of a stream. Literal addresses are classified in
    the row; names meet the static table of host verdicts (one row a host) by an
    equi-join that is read anew with every micro-batch."""
    return ADM.verdicts(ADM.with_hosts(urls, resolutions, col), col)


SNAP_OUT = "url string, polls long, how string, md string"


class Snapshots(_Timed):
    """The last poll of a render; after its result only the mark that swallows
    what still belongs to that render."""

    STATE = "last_md string, has_last boolean, last_slot long, n_polls long, done boolean, deadline_ms long"
    EMPTY = (None, False, -1, 0, False, 0)

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        captures = [(int(r.elapsed_ms), bool(r.is_end), None if pd.isna(r.md) else r.md, int(r.ts_ms), int(r.poll_budget_ms), int(r.poll_interval_ms))
                    for pdf in rows for r in pdf.itertuples(index=False)]
        # Renders of one URL follow each other; inside one, polls by time, an end after them.
        captures.sort(key=lambda c: (c[3] - c[0], c[0], c[1], c[2] is not None, c[2] or ""))
        last_md, has_last, last_slot, n, done, deadline = self.state.get() if self.state.exists() else self.EMPTY
        out = []
        for elapsed, is_end, md, ts_ms, budget, interval in captures:
            begun = ts_ms - elapsed
            if deadline and begun > deadline + self.grace_ms:
                # A later render: the one before ended without a terminal poll.
                if n and not done:
                    out.append((key[0], n, "exhausted", last_md if has_last else None))
                last_md, has_last, last_slot, n, done, deadline = self.EMPTY
            deadline = max(deadline, begun + budget)
            if done:
                continue
            if is_end:
                out.append((key[0], n, "exhausted", last_md if has_last else None))
                done = True
                continue
            slot = elapsed // interval
            if slot == last_slot:
                continue  # first capture of each interval only
            last_slot, n = slot, n + 1
            stable = bool(md) and has_last and md == last_md
            if stable or elapsed >= budget:
                out.append((key[0], n, "stable" if stable else "expired", md))
                done = True
                continue
            last_md, has_last = md, True
        until = max(deadline + self.grace_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.keep((None if done else last_md, has_last and not done, last_slot, n, done, deadline), until)
        if out:
            yield pd.DataFrame(out, columns=["url", "polls", "how", "md"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The budget is over and no further poll came: the last one counts.
        last_md, has_last, _, n, done, _ = self.state.get() if self.state.exists() else self.EMPTY
        self.state.clear()
        self.timer.clear()
        if n and not done:
            yield pd.DataFrame([(key[0], n, "exhausted", last_md if has_last else None)], columns=["url", "polls", "how", "md"])


def snapshot_stream(captures: DataFrame, watermark: str = "10 seconds", grace_ms: int = 10_000) -> DataFrame:
    """W3 = F1-F4 on a capture stream (url, ts, elapsed_ms, md,
    poll_budget_ms, poll_interval_ms, is_end): the result is emitted at the
    first terminal poll; an end-of-captures event, the event-time timer ``grace_ms``
    after the budget, or a later render of the URL emits the last poll as `exhausted`
    when none was terminal. The timer also removes the state."""
    rows = captures.withColumn("ts_ms", F.unix_millis("ts"))
    return (rows.withWatermark("ts", watermark).groupBy("url")
            .transformWithStateInPandas(Snapshots(grace_ms), SNAP_OUT, "Append", "EventTime"))
