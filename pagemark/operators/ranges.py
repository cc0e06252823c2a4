"""Longest-prefix match of addresses against a range table of any size (B9 beyond the
built-in classes, which compile into one CASE).

A range is a CIDR block; an address belongs to the longest block that holds it. Blocks
are taken in levels of 16 bits, as a router's table does. At level ``a`` the blocks of
``a`` + 1 to ``a`` + 16 bits meet the distinct prefixes of ``a`` + 16 bits that the
addresses have, dealt by their first ``a`` bits: a group holds at most 65,536 prefixes
and 131,070 blocks, whatever the table, and an address is one row of a level however
many lengths the table has. What a prefix finds goes on to the next level as the block
of its whole group. IPv4 addresses are matched as mapped IPv6 ones, so one table may
hold both.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemark.functions import addresses as A
from pagemark.session import cut_lineage

# Bits of a level (halves and words are cut at multiples of it), and rows a task matches.
STRIDE = 16
TASK_ROWS = 1 << 20
MAPPED = 0xffff << 32


def address_hex(v4: Column, hex32: Column) -> Column:
    """32 hex digits of an address, IPv4 as a mapped one; null if both are."""
    return F.coalesce(F.concat(F.lit(A.MAPPED_PREFIX), F.lpad(F.lower(F.hex(v4)), 8, "0")), hex32)


def _halves(hex32: Column) -> tuple[Column, Column]:
    """The upper and lower 64 bits of an address as longs (of a mapped IPv4 one only the last word has to be read)."""
    word = lambda i: F.conv(hex32.substr(1 + 8 * i, 8), 16, 10).cast("long")
    v4 = hex32.startswith(A.MAPPED_PREFIX)
    return (F.when(v4, F.lit(0).cast("long")).otherwise(F.shiftleft(word(0), 32).bitwiseOR(word(1))),
            F.when(v4, word(3) + MAPPED).otherwise(F.shiftleft(word(2), 32).bitwiseOR(word(3))))


# The first ``length`` bits of both halves (a shift by 64 would change nothing).
UPPER = "hi & CASE WHEN length >= 64 THEN -1L WHEN length <= 0 THEN 0L ELSE shiftleft(-1L, 64 - length) END"
LOWER = "lo & CASE WHEN length >= 128 THEN -1L WHEN length <= 64 THEN 0L ELSE shiftleft(-1L, 128 - length) END"


def range_table(ranges: DataFrame, cidr_col: str = "cidr", label_col: str = "label") -> DataFrame:
    """``length, hi, lo, label`` (the block's bits as two longs), one row a block: bits below the length do not count, of
    several labels of one block the smallest holds. Texts that are no CIDR are left out."""
    text = F.split(F.col(cidr_col), "/")
    d = ranges.select(text[0].alias("_base"), F.try_element_at(text, F.lit(2)).try_cast("int").alias("_bits"), F.col(label_col).alias("label"))
    d = A.with_v6_hex(d.withColumn("_quad", A.v4_from_quad(F.col("_base"))), "_base", "_v6")
    v4 = F.col("_quad").isNotNull()
    hi, lo = _halves(F.col("_v6"))
    d = d.select("label", "_bits", (F.col("_bits") + F.when(v4, 96).otherwise(0)).alias("length"),
                 F.when(v4, F.lit(0).cast("long")).otherwise(hi).alias("hi"), F.when(v4, F.col("_quad") + MAPPED).otherwise(lo).alias("lo"))
    valid = F.col("lo").isNotNull() & (F.col("_bits") >= 0) & (F.col("length") <= 128)
    # A generator, not a filter: a filter would move below the parsing and repeat it.
    d = d.select(F.inline(F.when(valid, F.array(F.struct("length", "hi", "lo", "label")))))
    return d.groupBy(F.expr(LOWER).alias("lo"), F.expr(UPPER).alias("hi"), "length").agg(F.min("label").alias("label"))


def _matcher(level: int):
    """For the rows of whole groups of ``level``: each prefix (a row without length) that a
    block holds, with the length and label of the longest. Blocks no longer than the level
    hold their group."""
    import pyarrow as pa

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        hi, lo = (rows.column(c).to_numpy() for c in ("hi", "lo"))
        asked = rows.column("length").is_null().to_numpy()
        length = rows.column("length").fill_null(-1).to_numpy()
        word, at = (hi, level) if level < 64 else (lo, level - 64)
        # The group's number and the bits of the level, as one long.
        group = np.int64(0)
        for half, bits in ((hi, min(level, 64)), (lo, max(level - 64, 0))):
            if bits:
                values, number = np.unique(half >> np.int64(64 - bits), return_inverse=True)
                group = group * len(values) + number
        key = group * (1 << STRIDE) + ((word >> np.int64(64 - STRIDE - at)) & ((1 << STRIDE) - 1))
        open_, best = np.flatnonzero(asked), np.full(len(hi), -1)
        open_ = open_[np.argsort(key[open_], kind="stable")]
        for bits in range(STRIDE, -1, -1):
            held = np.flatnonzero(length == level + bits) if bits else np.flatnonzero(~asked & (length <= level))
            if not len(held) or not len(open_):
                continue
            cut = np.int64(STRIDE - bits)
            held = held[np.argsort(key[held], kind="stable")]
            blocks, wanted = key[held] >> cut, key[open_] >> cut
            place = np.minimum(np.searchsorted(blocks, wanted), len(blocks) - 1)
            hit = blocks[place] == wanted
            best[open_[hit]] = held[place[hit]]
            open_ = open_[~hit]
        found = np.flatnonzero(best >= 0)
        at = pa.array(best[found])
        out = pa.table([rows.column("hi").take(pa.array(found)), rows.column("lo").take(pa.array(found)), rows.column("length").take(at), rows.column("label").take(at)],
                       names=["hi", "lo", "length", "label"])
        yield from out.to_batches(max_chunksize=1 << 16)

    return run


def _first(bits: int) -> tuple[Column, Column]:
    """The first ``bits`` bits of ``hi`` and ``lo``."""
    mask = lambda n: F.lit(-1 << (64 - n) if n else 0).cast("long")
    return F.col("hi").bitwiseAND(mask(min(bits, 64))).alias("hi"), F.col("lo").bitwiseAND(mask(max(bits - 64, 0))).alias("lo")


def longest_prefix(addresses: DataFrame, table: DataFrame, hex_col: str) -> DataFrame:
    """``addresses`` with ``label`` and ``length`` of the longest block of ``table`` (as
    ``range_table`` gives it) that holds ``hex_col``; null when none does."""
    table = cut_lineage(table.select("hi", "lo", "length", "label"))
    hi, lo = _halves(F.col(hex_col))
    addresses = cut_lineage(addresses.withColumns({"_hi": hi, "_lo": lo}))
    once = cut_lineage(addresses.where("_hi IS NOT NULL").select(F.col("_hi").alias("hi"), F.col("_lo").alias("lo")).distinct())
    kind = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()),
                         T.StructField("length", T.IntegerType()), T.StructField("label", table.schema["label"].dataType)])
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # 129 rows at most
    levels = {max(length - 1, 0) // STRIDE * STRIDE for length in counts}
    n_once, found = once.count(), table.where("length = 0")
    # Levels between the first and the last that have blocks hand on what was found.
    for level in range(min(levels), max(levels) + 1, STRIDE) if levels else ():
        end = level + STRIDE
        asked = once.select(*_first(end)).distinct() if end < 128 else once
        rows = (asked.withColumns({"length": F.lit(None).cast("int"), "label": F.lit(None).cast(kind["label"].dataType)})
                .unionByName(table.where((F.col("length") > level) & (F.col("length") <= end))).unionByName(found))
        n = n_once + sum(count for length, count in counts.items() if level < length <= end)
        found = rows.repartition(-(-n // TASK_ROWS), *_first(level)).mapInArrow(_matcher(level), kind)
    if levels and max(levels) + STRIDE < 128:
        # What the prefixes of the last level found holds for their addresses.
        at = once.select(F.struct("hi", "lo").alias("_a"), *_first(max(levels) + STRIDE))
        found = at.join(found, ["hi", "lo"]).select("_a.hi", "_a.lo", "length", "label")
    found = found.select(F.col("hi").alias("_fhi"), F.col("lo").alias("_flo"), "length", "label")
    return (addresses.join(found, (F.col("_lo") == F.col("_flo")) & (F.col("_hi") == F.col("_fhi")), "left")
            .drop("_hi", "_lo", "_fhi", "_flo"))
