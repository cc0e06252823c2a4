"""Order-preserving packing by dynamic programming.

Documents are packed in the order in which their partition delivers them into
windows of at most ``capacity`` tokens. Windows may be cut at document ends
(no penalty), sentence ends (``sentence_penalty``) and, inside sentences longer
than ``grid`` tokens, at every ``grid``-th token (``hard_penalty``). The cuts
minimise padding plus penalties: with positions p and best costs f,

    f[j] = penalty[j] + capacity - p[j] + min(f[i] + p[i]),  p[j] - p[i] <= capacity

so the minimum over the admissible window is kept in a monotone queue and each
candidate is handled in constant time. Tokens are cut freely, never dropped.

Each input partition is packed on its own in blocks of ``block`` tokens, the
last window of a block being carried into the next, so memory does not grow
with the partition and only the last window of a partition is short. Nothing
is shuffled. A lost task is recomputed to the same pieces when its input
partition is deterministic (a table scan); pack a stored table.

Null and empty texts give one piece, the end-of-document id alone. Repeated
rows are packed as separate documents. An empty table gives no pieces. Only
the id and text columns are read, whatever else the table holds.
"""
from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from pagemark.llm import tokens

CAPACITY = 1024
SENTENCE_PENALTY = 2
HARD_PENALTY = 8
GRID = 16
BLOCK = 1 << 18


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, grid: int,
               sentence_penalty: int, hard_penalty: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions (0 and the end included) and their penalties."""
    at = np.union1d(np.flatnonzero(ends[ids]) + 1, doc_ends)
    at = np.concatenate(([0], at))
    gaps = np.diff(at)
    inner = (gaps - 1) // grid  # extra cuts inside sentences longer than the grid
    total = int(inner.sum())
    if total:
        first = np.repeat(np.cumsum(inner) - inner, inner)
        extra = np.repeat(at[:-1], inner) + grid * (np.arange(total) - first + 1)
        positions = np.concatenate((at, extra))
        penalties = np.concatenate((np.full(len(at), sentence_penalty), np.full(total, hard_penalty)))
        order = np.argsort(positions, kind="stable")
        positions, penalties = positions[order], penalties[order]
    else:
        positions, penalties = at, np.full(len(at), sentence_penalty)
    penalties[np.searchsorted(positions, doc_ends)] = 0
    penalties[0] = 0
    return positions, penalties


def best_cuts(positions: np.ndarray, penalties: np.ndarray, capacity: int) -> np.ndarray:
    """Positions of the cheapest cuts, from 0 to the last candidate."""
    p, pen = positions.tolist(), penalties.tolist()
    back = [0] * len(p)
    queue = deque([(0, 0, 0)])  # (f + p, position, index), f + p rising
    for j in range(1, len(p)):
        here = p[j]
        low = here - capacity
        while queue[0][1] < low:
            queue.popleft()
        best, _, i = queue[0]
        back[j] = i
        value = best + capacity + pen[j]  # f[j] + p[j]
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, here, j))
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = back[j]
    cuts.append(0)
    return np.array(cuts[::-1], dtype=np.int64)


def _packer(id_type: pa.DataType, schema: pa.Schema, capacity: int, sentence_penalty: int,
            hard_penalty: int, grid: int, block: int, json_path: str, rank_path: str, end_id: int):
    def run(batches):
        ends = tokens.sentence_ends(rank_path)
        state = {"next": TaskContext.get().partitionId() << 32}
        docs: list[tuple] = []  # (id, ids still to pack, ids before them, ids of the document)
        held = 0

        def flush(final: bool):
            nonlocal docs, held
            lengths = np.array([len(d[1]) for d in docs], dtype=np.int64)
            doc_ends = np.cumsum(lengths)
            ids = np.concatenate([d[1] for d in docs])
            cuts = best_cuts(*candidates(ids, doc_ends, ends, grid, sentence_penalty, hard_penalty), capacity)
            if not final:
                cuts = cuts[:-1]  # the last window goes on in the next block
            stop = int(cuts[-1])
            starts = np.union1d(cuts[:-1], (doc_ends - lengths)[doc_ends - lengths < stop])
            stops = np.append(starts[1:], stop)
            doc = np.searchsorted(doc_ends, starts, side="right")
            window = np.searchsorted(cuts, starts, side="right") - 1
            before = np.array([d[2] for d in docs], dtype=np.int64)
            total = np.array([d[3] for d in docs], dtype=np.int64)
            offsets = np.append(starts, stop) * 4
            data = pa.py_buffer(np.ascontiguousarray(ids[:stop], dtype="<u4").tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), data])
            out = pa.RecordBatch.from_arrays([
                pa.array([d[0] for d in docs], id_type).take(pa.array(doc)),
                pa.array(before[doc] + starts - (doc_ends - lengths)[doc]),
                pa.array(stops - starts), packed, pa.array(total[doc]),
                pa.array(state["next"] + window), pa.array(starts - cuts[window]),
            ], schema=schema)
            state["next"] += len(cuts) - 1
            rest = []
            for k in range(int(np.searchsorted(doc_ends, stop, side="right")), len(docs)):
                name, left, done, size = docs[k]
                cut = max(0, stop - int(doc_ends[k] - lengths[k]))
                rest.append((name, left[cut:], done + cut, size))
            docs, held = rest, sum(len(d[1]) for d in rest)
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*tokens.encode(text, json_path, rank_path), end_id], dtype=np.uint32)
                docs.append((name, ids, 0, len(ids)))
                held += len(ids)
                if held >= block:
                    yield flush(False)
        if docs:
            yield flush(True)
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY,
         sentence_penalty: int = SENTENCE_PENALTY, hard_penalty: int = HARD_PENALTY, grid: int = GRID,
         block: int = BLOCK, json_path: str | None = None, rank_path: str | None = None,
         end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian unsigned
    32-bit), ``doc_tokens, sequence_id, offset``."""
    from pyspark.sql.pandas.types import to_arrow_type

    default_json, default_ranks = tokens.default_paths()
    fields = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = fields.schema["doc_id"].dataType
    long = T.LongType()
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("start", long), T.StructField("length", long),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", long),
        T.StructField("sequence_id", long), T.StructField("offset", long)])
    arrow_id = to_arrow_type(id_type)
    arrow = pa.schema([("doc_id", arrow_id), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                       ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    run = _packer(arrow_id, arrow, capacity, sentence_penalty, hard_penalty, min(grid, capacity), max(block, 4 * capacity),
                  json_path or default_json, rank_path or default_ranks, end_id)
    return fields.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: ``sequence_id, ids, length, documents`` in piece order.
    A sequence has at most ``capacity`` pieces, so the groups are bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return (pieces.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id",
                    F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                    F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
                    F.col("parts.doc_id").alias("documents")))
