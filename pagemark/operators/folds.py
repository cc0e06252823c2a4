"""Order-dependent per-key folds: token bucket (L2) and TTL decision reuse.

Both folds forget their past after a long enough gap: a bucket is full again
after ``capacity / refill`` of idle time, and a cached verdict has expired after
``ttl``. So each key's events split into independent segments at such gaps
(``segments``). What needs no sequence is solved by windows: a segment in which
no request is rejected (its levels follow from running minima), and every lookup
within one TTL of its segment's first.

The rest is folded by block composition. A block is what one key has in one
bucket of time within a segment; what it does to the state that enters it is a
step function (entering level to leaving level, entering expiry to leaving
expiry). Blocks are summarised in parallel, the summaries of a segment are
applied one after the other (a few numbers a block), and then every block is
replayed in parallel from the state that enters it. A key with a third of all
rows and no gap spreads over its blocks; windows run per (key, bucket) too,
with carries from one aggregate row per key and bucket.

Integer units keep the folds exact and order-free: tokens are counted in
``period_us`` units per token, one unit refilled per elapsed microsecond.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemark.session import cut_lineage

# --- fixed values of the reference (per-IP bucket; decision cache TTL) --------
DEFAULT_CAPACITY = 20          # tokens
DEFAULT_PERIOD_US = 2_000_000  # microseconds per refilled token (0.5 tokens/s)
DEFAULT_TTL_US = 60_000_000    # 60 s
IDLE_EVICT_US = 3_600_000_000  # buckets idle for an hour may be dropped

BLOCK_US = 3_600_000_000
LEAST = -(1 << 62)


@dataclass(frozen=True)
class Bucket:
    capacity: int = DEFAULT_CAPACITY
    period_us: int = DEFAULT_PERIOD_US

    @property
    def cap_units(self) -> int:
        return self.capacity * self.period_us


def _keyed(df: DataFrame, key: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with a string column for each key, never null, so that windows and joins on
    them share one partitioning and null keys are one key."""
    names = [f"_key{i}" for i in range(len(key))]
    return df.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for n, k in zip(names, key)}), names


def segments(df: DataFrame, key: list[str], ts: str, id_col: str, gap_us: int, block_us: int = BLOCK_US,
             cost: int = 0, cap: int = 0) -> DataFrame:
    """Adds ``_seg``, the timestamp of the segment's first row, where a segment starts at a
    key's first row or after a gap of at least ``gap_us``, ``_block``, the bucket of time,
    and for a token bucket of ``cap`` and ``cost`` ``_level``, the level after each row if
    none is rejected, and ``_calm``, whether none of the segment is.

    Skew-safe: windows run per (key, block), so a key with a third of all rows still
    spreads over many tasks. A block falls into pieces at its own gaps; what a piece
    needs from earlier ones (last time, segment, rows, least values) comes from one
    aggregate row per piece, joined back once.

    As long as nothing is rejected, the level after row k of a segment is the least of
    ``cap + (t_k - t_j) - cost * (k - j + 1)`` over all j up to k: a running minimum.
    """
    t = F.col(ts)
    d = df.withColumn("_block", F.floor(t / max(block_us, 1)).cast("long"))
    wb = Window.partitionBy(*key, "_block").orderBy(ts, id_col)
    so_far = wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_prev", F.lag(ts).over(wb))
    # The piece: the last gap inside the block, LEAST before the first one.
    d = d.withColumn("_piece", F.coalesce(F.last(F.when(t - F.col("_prev") >= gap_us, t), True).over(so_far), F.lit(LEAST))).drop("_prev")
    unit = [*key, "_block", "_piece"]
    here = Window.partitionBy(*unit).orderBy(ts, id_col)
    running = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_n", F.row_number().over(here).cast("long"))
    d = d.withColumn("_low", F.min(F.col("_n") * cost - cost - t).over(running))
    pieces = d.groupBy(*unit).agg(
        F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.max("_n").alias("_rows"), F.min("_low").alias("_least"),
        F.min(t - F.col("_n") * cost + F.col("_low")).alias("_own"), F.min(t - F.col("_n") * cost).alias("_bare"))
    line = Window.partitionBy(*key).orderBy("_block", "_piece")
    starts = (F.col("_piece") != LEAST) | F.coalesce(F.col("_from") - F.lag("_to").over(line) >= gap_us, F.lit(True))
    pieces = pieces.withColumn("_start", F.when(starts, F.col("_from")))
    pieces = pieces.withColumn("_seg", F.last("_start", True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    of_segment = Window.partitionBy(*key, "_seg")
    earlier = of_segment.orderBy("_block", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    pieces = pieces.withColumn("_carry", F.min(F.col("_least") + F.col("_before") * cost).over(earlier))
    lowest = F.least(F.col("_own"), F.col("_bare") - F.col("_before") * cost + F.col("_carry")) + cap
    pieces = pieces.withColumn("_calm", F.min(lowest).over(of_segment) >= 0)
    d = d.join(pieces.select(*unit, "_seg", "_before", "_carry", "_calm"), unit)
    least = F.least(F.col("_low") + F.col("_before") * cost, F.col("_carry"))
    return d.withColumn("_level", t - (F.col("_n") + F.col("_before")) * cost + cap + least).drop("_piece", "_n", "_low", "_before", "_carry")


# ---- block composition

# A step function as rows (from, slope, offset): from that argument on, slope * argument + offset.
STEPS = T.ArrayType(T.ArrayType(T.LongType()))


def apply_steps(steps, value: int) -> int:
    k = bisect_right(steps, value, key=lambda s: s[0]) - 1
    return int(steps[k][1]) * value + int(steps[k][2])


class Levels:
    """Step function of a block of requests: level before its first charge to level
    after its last."""

    def __init__(self, bucket: Bucket):
        self.cap, self.cost, self.last = bucket.cap_units, bucket.period_us, None
        self.pieces = [(0, 1, 0)]

    def feed(self, times: np.ndarray) -> None:
        for t in times.tolist():
            if self.last is not None:
                self._cut(t - self.last, self.cap, lambda v: self.cap)
            self._cut(0, self.cost, None)
            self.last = t if self.last is None else max(t, self.last)

    def _cut(self, gain: int, bound: int, at: Callable | None) -> None:
        """Adds ``gain``; then values from ``bound`` on become ``at`` (a refill's cap), or
        lose one token (a charge)."""
        out: list[tuple[int, int, int]] = []
        ends = [p[0] for p in self.pieces[1:]] + [self.cap + 1]

        def put(low, slope, offset):
            if not out or out[-1][1:] != (slope, offset):
                out.append((low, slope, offset))

        for (low, slope, offset), end in zip(self.pieces, ends):
            offset += gain
            turn = bound - offset if slope else (low if offset >= bound else end)
            if low < turn:
                put(low, slope, offset)
            if turn < end:
                put(max(low, turn), *((0, self.cap) if at else (slope, offset - self.cost)))
        self.pieces = out

    def steps(self) -> list[list[int]]:
        return [list(p) for p in self.pieces]


class Expiries:
    """Step function of a block of lookups: entering expiry to leaving expiry."""

    def __init__(self, ttl: int):
        self.ttl, self.parts = ttl, []

    def feed(self, times: np.ndarray) -> None:
        self.parts.append(times)

    def steps(self) -> list[list[int]]:
        ts = np.concatenate(self.parts)
        n = len(ts)
        # From a miss to the next one, until the block has none.
        then = np.searchsorted(ts, ts + self.ttl)
        then = np.where(then < n, then, np.arange(n))
        while (then != (jumped := then[then])).any():
            then = jumped
        leaving = ts[then] + self.ttl
        new = np.concatenate(([True], (leaving[1:] != leaving[:-1]) & (ts[1:] != ts[:-1])))
        out = [[LEAST if i == 0 else int(ts[i - 1]) + 1, 0, int(leaving[i])] for i in np.flatnonzero(new)]
        return [*out, [int(ts[-1]) + 1, 1, 0]]


def _runs(pdf: pd.DataFrame, unit: list[str], before: tuple | None):
    """(unit, whether its first row is here, from, to) for the runs of a sorted batch."""
    columns = [pdf[c].to_numpy() for c in unit]
    if not len(pdf):
        return
    turn = np.zeros(len(pdf) - 1, dtype=bool)
    for c in columns:
        turn |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(turn) + 1).tolist(), len(pdf)]
    for at, to in zip(edges, edges[1:]):
        of = tuple(c[at] for c in columns)
        yield of, of != before, at, to
        before = of


def _dealt(df: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*[F.col(c) for c in unit]).sortWithinPartitions(*unit, *order)


def _with_entry(rows: DataFrame, key: list[str], ts: str, id_col: str, first: Callable, between: Callable,
                summary: Callable) -> DataFrame:
    """``rows`` with ``_enter``, the state that enters their block: ``first(segment)`` for the
    first of a segment, else ``between(state that left the block before, its last time,
    this one's first)``. ``summary()`` makes what is fed a block and gives its steps."""
    unit = [*key, "_seg", "_block"]
    names = [F.col(c) for c in unit]
    fields = [rows.schema[c] for c in unit]
    of_segment = Window.partitionBy(*key, "_seg")
    line = rows.groupBy(*unit).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to")).withColumns({
        "_more": F.col("_block") < F.max("_block").over(of_segment), "_alone": F.count(F.lit(1)).over(of_segment) == 1})
    # A segment's last block needs no summary; most segments have no other.
    fed = rows.select(*names, F.col(ts).alias("_ts"), F.col(id_col).alias("_id")).join(line.where("_more").select(*unit), unit, "left_semi")

    def summarise(batches):
        held, of = None, None
        for pdf in batches:
            out, times = [], pdf["_ts"].to_numpy(dtype=np.int64)
            for now, fresh, at, to in _runs(pdf, unit, of):
                if fresh:
                    if held is not None:
                        out.append((*of, held.steps()))
                    held, of = summary(), now
                held.feed(times[at:to])
            if out:
                yield pd.DataFrame(out, columns=[*unit, "_steps"])
        if held is not None:
            yield pd.DataFrame([(*of, held.steps())], columns=[*unit, "_steps"])

    told = _dealt(fed, unit, ["_ts", "_id"]).mapInPandas(summarise, T.StructType([*fields, T.StructField("_steps", STEPS)]))

    def chain(batches):
        state, before, of = None, None, None
        for pdf in batches:
            enter = np.empty(len(pdf), dtype=np.int64)
            blocks = list(zip(pdf["_from"].tolist(), pdf["_to"].tolist(), pdf["_steps"]))
            for now, fresh, at, to in _runs(pdf, [*key, "_seg"], of):
                of = now
                for i in range(at, to):
                    start, end, steps = blocks[i]
                    enter[i] = first(int(of[-1])) if fresh else between(state, before, start)
                    state, before, fresh = apply_steps(steps, int(enter[i])) if steps is not None else None, end, False
            yield pdf[unit].assign(_enter=enter)

    entry = T.StructType([*fields, T.StructField("_enter", T.LongType())])
    linked = line.where("NOT _alone").select(*unit, "_from", "_to").join(told, unit, "left")
    entered = _dealt(linked, [*key, "_seg"], ["_block"]).mapInPandas(chain, entry)
    # One block alone (no row here) starts as its segment does; ``_replayed`` sees to that.
    return rows.join(entered, unit, "left")


def _replayed(rows: DataFrame, key: list[str], ts: str, id_col: str, first: Callable, step: Callable, added: list[T.StructField]) -> DataFrame:
    """Every block from the state that enters it: ``step(state, times, fresh)`` gives the
    state after a chunk of a block and the chunk's new columns."""
    unit = [*key, "_seg", "_block"]
    kept = [f for f in rows.schema.fields if f.name not in (*unit, "_enter")]
    names = [f.name for f in kept]

    def run(batches):
        state, of = None, None
        for pdf in batches:
            times, enters = pdf[ts].to_numpy(dtype=np.int64), pdf["_enter"].to_numpy()
            parts = []
            for now, fresh, at, to in _runs(pdf, unit, of):
                if fresh:
                    of = now
                    state = (first(int(of[-2])) if pd.isna(enters[at]) else int(enters[at]), None)
                state, columns = step(state, times[at:to])
                parts.append(columns)
            yield pdf[names].assign(**{f.name: np.concatenate([p[f.name] for p in parts]) for f in added})

    return _dealt(rows, unit, [ts, id_col]).mapInPandas(run, T.StructType([*kept, *added]))


# ---- token bucket

def token_bucket(df: DataFrame, key: str = "identity", ts_us: str = "ts_us", id_col: str = "id",
                 bucket: Bucket = Bucket(), block_us: int | None = None) -> DataFrame:
    """L2: per-key token bucket over rows (id, key, ts_us, other scalar
    columns carried through). Starts full; each row refills ``elapsed``
    units (capped), then is allowed and charged one token if at least one
    token is there, else rejected keeping the refilled level. Adds
    ``allowed`` and ``tokens_after`` (tokens in units).

    A segment whose levels without rejections never fall below 0 has none; the others
    are folded by blocks.
    """
    cap, cost = bucket.cap_units, bucket.period_us
    columns = df.columns
    d, keys = _keyed(df, [key])
    # Written once: both ways out read it.
    d = cut_lineage(segments(d, keys, ts_us, id_col, cap, block_us or max(BLOCK_US, 16 * cap), cost, cap))
    calm = d.where("_calm").select(*columns, F.lit(True).alias("allowed"), F.col("_level").alias("tokens_after"))
    rows = d.where("NOT _calm").select(*columns, *keys, "_seg", "_block")

    def between(level, before, start):
        return min(cap, level + start - before)

    def step(state, times):
        level, last = state
        n = len(times)
        allowed, after = np.empty(n, dtype=bool), np.empty(n, dtype=np.int64)
        for i, t in enumerate(times.tolist()):
            if last is not None and t > last:
                level = min(cap, level + t - last)
            allowed[i] = level >= cost
            if level >= cost:
                level -= cost
            last = t if last is None else max(t, last)
            after[i] = level
        return (level, last), {"allowed": allowed, "tokens_after": after}

    first = lambda segment: cap
    rows = _with_entry(rows, keys, ts_us, id_col, first, between, lambda: Levels(bucket))
    folded = _replayed(rows, keys, ts_us, id_col, first, step,
                       [T.StructField("allowed", T.BooleanType()), T.StructField("tokens_after", T.LongType())])
    return calm.unionByName(folded)


# ---- decision reuse

def decision_reuse(df: DataFrame, key: list[str], ts_us: str = "ts_us", id_col: str = "id",
                   ttl_us: int = DEFAULT_TTL_US, block_us: int | None = None) -> DataFrame:
    """A verdict made by a miss is reused while ``expiry > now`` (strict,
    so TTL 0 never hits), never renewed by a hit. Returns (id, key columns, hit).

    Within one TTL of a segment's first lookup all but that one are hits; only what
    comes later in a segment is folded by blocks, from miss to miss."""
    d = df.select(F.col(id_col).alias("id"), *[F.col(k) for k in key], F.col(ts_us).alias("ts_us"))
    if ttl_us <= 0:
        return d.select("id", *key, F.lit(False).alias("hit"))
    d, keys = _keyed(d, key)
    d = segments(d, keys, "ts_us", "id", ttl_us, block_us or max(BLOCK_US, 16 * ttl_us))
    first_row = F.row_number().over(Window.partitionBy(*keys, "_seg", "_block").orderBy("ts_us", "id")) == 1
    # Written once: both ways out read it.
    d = cut_lineage(d.drop("_level", "_calm").withColumn("_opens", first_row & (F.col("ts_us") == F.col("_seg"))))
    fresh = F.col("ts_us") < F.col("_seg") + ttl_us
    near = d.where(fresh).select("id", *key, (~F.col("_opens")).alias("hit"))
    rows = d.where(~fresh).drop("_opens")

    def step(state, times):
        expiry, _ = state
        hit = np.ones(len(times), dtype=bool)
        at = int(np.searchsorted(times, expiry))
        while at < len(times):
            hit[at] = False
            expiry = int(times[at]) + ttl_us
            at = int(np.searchsorted(times, expiry))
        return (expiry, None), {"hit": hit}

    first = lambda segment: segment + ttl_us
    rows = _with_entry(rows, keys, "ts_us", "id", first, lambda expiry, before, start: expiry, lambda: Expiries(ttl_us))
    return near.unionByName(_replayed(rows, keys, "ts_us", "id", first, step, [T.StructField("hit", T.BooleanType())]).select("id", *key, "hit"))
