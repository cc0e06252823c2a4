"""Conversation structure repair by weighted CYK interval parsing.

A conversation's rows, in order, are edited into one whose role initials read
``(s?(ua)+)?``. Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert
(an empty user or assistant turn, anywhere) 5; a blank or duplicate row has to be
deleted, a truncated row that is not deleted adds 5.

The grammar in Chomsky normal form has a nonterminal ``X[p,q]`` for each pair of
places in the pattern (start, after ``s``, after ``u``, after ``a``): it derives the
spans whose edits lead from p to q. Its rules are ``X[p,q] -> X[p,r] X[r,q]``, the edits
of one row, and the closure under inserts on both sides; a conversation is
``X[0,0] | X[0,3]``. A cell holds, for each nonterminal, the least (cost, audit),
the audit being the edits' initials. Every derivation of a span can be
re-bracketed at any of its split points (for each point there is an r), so one
split per span gives the same cells as all splits: spans are combined bottom-up
by length 1, 2, 4, ... in linear many combinations. Of two audits of one span
with equal cost none is a prefix of the other (a longer one would only add
inserts), so the least audit of a whole is made of the least audits of its parts.

Rows are reduced to narrow ones without texts; equal rows are one row with a
count; a text's first place is found by windows over at most ``BUCKET`` turns. A
global range sort cuts long conversations across tasks, each task combines the
rows it has into one span per conversation, then the few spans of each
conversation are combined. Repaired rows are read back in order as a stream,
one Arrow batch at a time, beside the audit (a character a row).

Null texts and roles are one space; null conversation ids are one conversation;
null turns come first. Rows of one turn are ordered by role, the text's first
``HEAD`` characters and its digest. A role without an initial cannot be kept. Blank,
duplicate and truncated rows are counted by the first that holds. Repeated rows
are duplicates. Empty tables give no rows; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

INSERT, REROLE, DELETE, CUT_OFF = 5, 1, 2, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
BUCKET = 4096
HEAD = 32

# The pattern's places: 0 start, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GOALS = (0, 3)
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
MADE = {p: r for (p, r) in STEP if r in ROLES}   # the one role that an insert or rerole can give at a place

Cell = dict[tuple[int, int], tuple[int, str]]


def join(left: Cell, right: Cell) -> Cell:
    """Binary rules: the cell of two adjacent spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is None:
                continue
            best, total = out.get((p, q)), cost + other[0]
            if best is None or total < best[0]:
                out[p, q] = (total, audit + other[1])
            elif total == best[0] and (whole := audit + other[1]) < best[1]:
                out[p, q] = (total, whole)
    return out


def _inserts() -> Cell:
    """Closure of the insert rules: from p to q by inserted turns alone."""
    closure: Cell = {(p, p): (0, "") for p in range(4)}
    once: Cell = dict(closure)
    for p, role in MADE.items():
        once[p, STEP[p, role]] = (INSERT, "I")
    for _ in range(4):
        closure = join(closure, once)
    return closure


INSERTS = _inserts()


@lru_cache(maxsize=256)
def row_cell(initial: str, must_go: bool, truncated: bool) -> Cell:
    """Terminal rules of one row, closed under inserts."""
    raw: Cell = {}

    def offer(p, q, cost, letter):
        raw[p, q] = min(raw.get((p, q), (cost, letter)), (cost, letter))

    for p in range(4):
        offer(p, p, DELETE, "D")
        if not must_go:
            extra = CUT_OFF if truncated else 0
            if (p, initial) in STEP:
                offer(p, STEP[p, initial], extra, "K")
            if p in MADE:
                offer(p, STEP[p, MADE[p]], REROLE + extra, "R")
    return join(join(INSERTS, raw), INSERTS)


class Spans:
    """Adjacent spans combined bottom-up: whenever the two last have one length."""

    def __init__(self):
        self.stack: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, length: int = 1) -> None:
        while self.stack and self.stack[-1][0] <= length:
            n, left = self.stack.pop()
            cell, length = join(left, cell), n + length
        self.stack.append((length, cell))

    def whole(self) -> Cell:
        cell = {(p, p): (0, "") for p in range(4)}
        for _, right in reversed(self.stack):
            cell = join(right, cell)
        return cell


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in GOALS if (0, q) in cell)


_SPAN = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SCHEMA = ("conv_id {0}, part int, first_initial string, last_initial string, first_turn {1}, last_turn {1}, "
           "blank long, duplicate long, truncated long, illegal long, turns long, "
           "cells array<struct<p:int,q:int,cost:long,audit:string>>")


class _Stretch:
    """Counts and cells of the rows of one conversation that a task has in order."""

    def __init__(self):
        self.spans = Spans()
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_initial = self.last_initial = self.first_turn = self.last_turn = None

    def row(self, turn, initial, copies, blank, first, truncated):
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            if turn != self.last_turn:
                self.counts["turns"] += 1
            self.last_turn = turn
        for k in range(copies):
            again = not blank and not (first and k == 0)
            fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
            if fault:
                self.counts[fault] += 1
            if self.last_initial is not None:
                self.counts["illegal"] += self.last_initial + initial not in LEGAL
            else:
                self.first_initial = initial
            self.last_initial = initial
            self.spans.add(row_cell(initial, blank or again, fault == "truncated"))

    def follow(self, other: dict) -> None:
        """Append the stretch that a later task has found."""
        self.counts = {k: v + other[k] for k, v in self.counts.items()}
        if self.last_initial is None:
            self.first_initial = other["first_initial"]
        else:
            self.counts["illegal"] += self.last_initial + other["first_initial"] not in LEGAL
        self.last_initial = other["last_initial"]
        if other["first_turn"] is not None:
            if self.first_turn is None:
                self.first_turn = other["first_turn"]
            self.counts["turns"] -= self.last_turn is not None and self.last_turn == other["first_turn"]
            self.last_turn = other["last_turn"]
        self.spans.add({(c["p"], c["q"]): (c["cost"], c["audit"]) for c in other["cells"]}, len(other["cells"][0]["audit"]))


def _flush(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=like)


def _order() -> list[str]:
    return ["conv_id", "turn", "role", "head", "digest"]


def ordered_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """The operator's reading of a table: ``conv_id, turn, role, text`` and what orders
    equal turns."""
    text = F.coalesce(F.col(text_col), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                       F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"),
                       F.substring(text, 1, HEAD).alias("head"), F.sha2(text, 256).alias("digest"))


def _faults(rows: DataFrame) -> DataFrame:
    """Narrow rows: one per distinct (turn, role, text) with its number of copies and
    whether it is the text's first place."""
    rest = F.rtrim("text", F.lit(BLANKS))
    flat = rows.select("conv_id", "turn", "role", "head", "digest", (rest == "").alias("blank"),
                       (~F.substring(rest, -1, 1).isin(*ENDS)).alias("truncated"))
    once = flat.groupBy(*_order()).agg(F.count("*").cast("int").alias("copies"), F.max("blank").alias("blank"),
                                       F.max("truncated").alias("truncated"))
    said = ["conv_id", "role", "digest"]
    bucket = F.expr("turn div " + str(BUCKET))
    near = F.row_number().over(W.partitionBy(*said, bucket).orderBy("turn"))
    # Only a bucket's first row meets those of other buckets.
    far = F.row_number().over(W.partitionBy(*said, F.when(F.col("near") > 1, F.col("turn"))).orderBy("turn"))
    return once.withColumn("near", near).withColumn("far", far).select(
        *_order(), "copies", "blank", "truncated", ((F.col("near") == 1) & (F.col("far") == 1)).alias("first"))


def repair(rows: DataFrame, **columns) -> DataFrame:
    """Per conversation ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit``. ``columns``: names, as in ``ordered_rows``."""
    flat = _faults(ordered_rows(rows, **columns))
    kind, turn = flat.schema["conv_id"].dataType.simpleString(), flat.schema["turn"].dataType.simpleString()
    schema = _SCHEMA.format(kind, turn)
    sorted_ = flat.select(*_order(), F.substring("role", 1, 1).alias("initial"), "copies", "blank", "first", "truncated")
    sorted_ = sorted_.repartitionByRange(*_order()).sortWithinPartitions(*_order()).drop("role", "head", "digest")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, conv, at, like = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if like is None:
                like = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("part", pa.int32()),
                                  ("first_initial", pa.string()), ("last_initial", pa.string()),
                                  ("first_turn", batch.schema.field("turn").type), ("last_turn", batch.schema.field("turn").type),
                                  *[(k, pa.int64()) for k in _COUNTS], ("cells", pa.list_(_SPAN))])
            done = []
            for r in batch.to_pylist():
                if at is None or r["conv_id"] != conv:
                    if at is not None:
                        done.append(_stretch_row(conv, part, at))
                    conv, at = r["conv_id"], _Stretch()
                at.row(r["turn"], r["initial"], r["copies"], r["blank"], r["first"], r["truncated"])
            if done:
                yield _flush(done, like)
        if at is not None:
            yield _flush([_stretch_row(conv, part, at)], like)

    found = sorted_.mapInArrow(stretches, schema)
    names = [c for c in found.columns if c != "conv_id"]
    gathered = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("stretches"))
    out = (f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                whole = _Stretch()
                for other in r["stretches"]:
                    whole.follow(other)
                cost, audit = best(whole.spans.whole())
                span = 0 if whole.first_turn is None else whole.last_turn - whole.first_turn + 1
                done.append({"conv_id": r["conv_id"], "gaps": span - whole.counts["turns"], "cost": cost, "audit": audit}
                            | {k: whole.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")})
            yield _flush(done, pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(k, pa.int64()) for k in (
                "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())]))

    return gathered.mapInArrow(conversations, out)


def _stretch_row(conv, part: int, at: _Stretch) -> dict:
    cells = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in at.spans.whole().items()]
    return {"conv_id": conv, "part": part, "first_initial": at.first_initial, "last_initial": at.last_initial,
            "first_turn": at.first_turn, "last_turn": at.last_turn, "cells": cells} | at.counts


def repaired_turns(rows: DataFrame, summary: DataFrame, **columns) -> DataFrame:
    """The repaired conversations, rows of one conversation together and in order:
    ``conv_id, at`` (from 0) ``, edit`` (K, R or I) ``, role, text``."""
    flat = ordered_rows(rows, **columns)
    heads = summary.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(flat.schema[c].dataType).alias(c) for c in (
        "turn", "role", "text", "head", "digest")], "audit")
    both = heads.unionByName(flat.withColumns({"kind": F.lit(1), "audit": F.lit(None).cast("string")}))
    keys = ["conv_id", "kind", "turn", "role", "head", "digest"]
    stream = both.repartition("conv_id").sortWithinPartitions(*keys).select("conv_id", "kind", "role", "text", "audit")
    kind = flat.schema["conv_id"].dataType.simpleString()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, n = None, "", 0, 0, 0
        for batch in batches:
            like = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("at", pa.int64()), ("edit", pa.string()),
                              ("role", pa.string()), ("text", pa.string())])
            done = []

            def made(edit, text):
                nonlocal state, n
                role = MADE[state]
                state = STEP[state, role]
                done.append({"conv_id": conv, "at": n, "edit": edit, "role": ROLES[role], "text": text})
                n += 1

            for r in batch.to_pylist():
                if r["kind"] == 0:
                    conv, audit, at, state, n = r["conv_id"], r["audit"], 0, 0, 0
                else:
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = STEP[state, r["role"][0]]
                        done.append({"conv_id": conv, "at": n, "edit": "K", "role": r["role"], "text": r["text"]})
                        n += 1
                    elif edit == "R":
                        made("R", r["text"])
                while at < len(audit) and audit[at] == "I":
                    made("I", "")
                    at += 1
            if done:
                yield _flush(done, like)

    return stream.mapInArrow(replay, f"conv_id {kind}, at long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the newline-joined ``role:text`` of conversations whose turns
    lie together and in order, as ``repaired_turns`` leaves them."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        conv, digest, like = None, None, None
        for batch in batches:
            like = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("sha256", pa.string())])
            done = []
            for c, at, role, text in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "at", "role", "text")]):
                if at == 0:
                    if digest is not None:
                        done.append({"conv_id": conv, "sha256": digest.hexdigest()})
                    conv, digest = c, hashlib.sha256()
                digest.update((f"\n{role}:{text}" if at else f"{role}:{text}").encode("utf-8", "surrogatepass"))
            if done:
                yield _flush(done, like)
        if digest is not None:
            yield _flush([{"conv_id": conv, "sha256": digest.hexdigest()}], like)

    return turns.select("conv_id", "at", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """A stand-in for broken conversations: rows changed by ``crc32('conv_id:turn') % 20``:
    0 drops a row, 1 empties its text, 2 removes sentence ends, 3 repeats it, 4 sets
    role user. Null texts, roles and key parts are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slot = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    text: Column = said("text")
    return rows.select("conv_id", "turn", "role", "text", slot.alias("slot")).filter("slot <> 0").select(
        "conv_id", "turn", F.when(F.col("slot") == 4, "user").otherwise(said("role")).alias("role"),
        F.when(F.col("slot") == 1, "").when(F.col("slot") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("slot") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
