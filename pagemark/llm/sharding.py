"""Minimax contiguous partition of a corpus into byte-balanced shards.

Atomic groups (equal texts) are ordered by a hash of the text and cut into
contiguous shards; the largest shard is as small as that order allows. The
smallest feasible capacity is found by binary search, each candidate checked
greedily.

The search never sees all groups. The driver holds a summary of the order:
nodes, each a range of hash values with the sum of its group sizes. Treating
nodes as divisible bounds the capacity from below, as atomic from above; while
the bounds differ, only nodes in which some cut can still fall are opened, at
most ``OPEN`` a round, each into ``2**STEP`` finer ones by one aggregation.
Ends when the bounds meet, at single groups at the latest.

Groups larger than an even share of what remains (fewer than the shard count)
come first in the order, each a shard of its own, so that they do not loosen
the capacity of all others.

Null texts have no bytes; null and empty texts are two groups. Repeated rows
are rows of their group. An empty table gives no rows. Only id and text
columns are read, once; what is shuffled are hashes, sizes and ids.
"""
from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagemark.llm.common import narrow, store
from pagemark.session import cut_lineage

ROW_BYTES = 8
FIRST = 12       # bits of the first summary
STEP = 8         # bits that opening a node adds
OPEN = 2048      # nodes opened at once
CELLS = 512      # numbering cells per shard


@dataclass(frozen=True)
class Node:
    prefix: int   # signed hash shifted right
    bits: int
    size: int
    groups: int

    @property
    def first(self) -> int:
        return self.prefix << (64 - self.bits)


def _reach(sums: list[int], open_: list[bool], start: float, capacity: float, whole: bool) -> tuple[float, int]:
    """How far one shard of ``capacity`` gets from position ``start`` (in bytes):
    (position, node reached). ``whole``: nodes are not divided; otherwise
    those marked open are."""
    at = min(start + capacity, sums[-1])
    k = bisect_right(sums, at) - 1
    if k < len(open_) and not whole and open_[k]:
        return at, k
    return max(start, sums[k]), k


def _shards(sums, open_, capacity, whole, limit) -> int:
    at, used = 0, 0
    while at < sums[-1] and used <= limit:
        to, _ = _reach(sums, open_, at, capacity, whole)
        used += 1
        if to <= at:
            return limit + 1
        at = to
    return used


def _least(sums, open_, limit, whole) -> int:
    low, high = -(-sums[-1] // limit), sums[-1]
    while low < high:
        mid = (low + high) // 2
        if _shards(sums, open_, mid, whole, limit) <= limit:
            high = mid
        else:
            low = mid + 1
    return high


def _summary(groups: DataFrame, bits: int) -> list[Node]:
    shift = 64 - bits
    rows = (groups.groupBy(F.shiftright("hash", shift).alias("prefix"))
            .agg(F.sum("bytes").alias("size"), F.count("*").alias("groups")).collect())
    return [Node(r["prefix"], bits, r["size"], r["groups"]) for r in rows]


def cut_points(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(first hash of every shard but the first, capacity) for ``groups``
    (``hash, bytes``; one row a hash)."""
    nodes = sorted(_summary(groups, FIRST), key=lambda n: n.first)
    if not nodes:
        return [], 0
    while True:
        sums = [0, *accumulate(n.size for n in nodes)]
        open_ = [n.groups > 1 for n in nodes]
        low, high = _least(sums, open_, shards, False), _least(sums, open_, shards, True)
        if low == high:
            break
        # Where the k-th cut can fall for any capacity still possible.
        near, far, chosen = 0, 0, set()
        for _ in range(shards):
            near, a = _reach(sums, open_, near, low, True)
            far, b = _reach(sums, open_, far, high, False)
            chosen.update(k for k in range(max(0, a), min(b + 1, len(nodes))) if open_[k])
        opened = sorted(chosen, key=lambda k: -nodes[k].size)[:OPEN]
        if not opened:
            break
        finer = []
        for bits in sorted({nodes[k].bits for k in opened}):
            prefixes = [nodes[k].prefix for k in opened if nodes[k].bits == bits]
            inside = groups.filter(F.shiftright("hash", 64 - bits).isin(prefixes))
            finer += _summary(inside, min(64, bits + STEP))
        gone = set(opened)
        nodes = sorted([n for k, n in enumerate(nodes) if k not in gone] + finer, key=lambda n: n.first)
    cuts, at = [], 0
    while True:
        at, k = _reach(sums, open_, at, high, True)
        if k >= len(nodes):
            return cuts, high
        cuts.append(nodes[k].first)


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
           row_bytes: int = ROW_BYTES) -> DataFrame:
    """``doc_id, size, text_crc32, hash, shard, slot`` per row; slots are gapless
    from 0 within a shard."""
    text = F.col(text_col)
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(text).alias("hash")))
    groups = store(rows.groupBy("hash").agg(F.sum("size").alias("bytes")))
    # Groups beyond an even share: fewer than `shards` exist.
    largest = [(r["hash"], r["bytes"]) for r in groups.orderBy(F.desc("bytes"), "hash").limit(shards).collect()]
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[int] = []
    for key, size in largest:
        if shards - len(alone) > 1 and size * (shards - len(alone)) > left:
            alone.append(key)
            left -= size
        else:
            break
    rest = groups.filter(~F.col("hash").isin(alone)) if alone else groups
    cuts, _ = cut_points(rest, shards - len(alone))
    shard: Column = F.lit(len(alone))
    for cut in cuts:
        shard = shard + (F.col("hash") >= F.lit(cut)).cast("int")
    for k, key in enumerate(alone):
        shard = F.when(F.col("hash") == F.lit(key), F.lit(k)).otherwise(shard)
    # Slots: cells by a hash of the id, so that no group of equal texts fills one.
    placed = rows.withColumn("shard", shard.cast("int")).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CELLS)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # at most shards * CELLS rows
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "cell").orderBy("doc_id", "hash")
    return narrow(placed.join(F.broadcast(offsets), ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", "hash", "shard",
                    (F.col("offset") + F.row_number().over(inside) - 1).cast("long").alias("slot")))


def write(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as one Parquet folder per shard."""
    keys = assigned.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "shard").distinct()
    (docs.join(keys, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_hash")))
     .drop("_id", "_hash").write.mode("overwrite").partitionBy("shard").parquet(path))
