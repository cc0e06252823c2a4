"""SimHash near-duplicate groups by binary-trie self-join.

1. ``fingerprints``: 64-bit SimHash per document over whole texts, 4-word
   shingles, one Arrow pass, no shuffle.
2. Equal fingerprints collapse to one row before anything is compared, so a
   group of exact copies of any size is one trie leaf.
3. ``links``: the trie is dealt to tasks by pigeonhole. With 6 blocks of bits
   and at most 4 differing bits, two blocks are equal, so every linked pair
   meets in one of 15 sub-tries whose two blocks are fixed. Inside a sub-trie
   node pairs are traversed together, their differing bits accumulate, and a
   pair is dropped as soon as the budget is exceeded, or when all below it is
   known to be one component. Only a spanning forest of the links leaves a
   task: at most one edge per fingerprint, never all pairs of a group.
   Sub-tries beyond ``cell_limit`` fingerprints are cut into chunks and run
   per pair of chunks, so no task holds more than two chunks.
4. ``components``: alternating large-star / small-star over the edges, each
   round written to the shared checkpoint folder.

Null, empty and blank texts have no words and fingerprint zero, linked like
any other. Repeated rows share their fingerprint. Rows with a null id take
part and get the smallest id of their component (null if it has none). An
empty table gives an empty result. Only id and text columns are read.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from pagemark.llm.common import fresh, narrow, store, union_all
from pagemark.session import cut_lineage

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCKS = 6
CELL_LIMIT = 1 << 15
SALTS = 8
_PRODUCT = 64       # node pairs of at most this many leaf pairs are compared directly
_FRONT = 1 << 17    # node pairs expanded at once
_PAIRS = 1 << 19    # leaf pairs compared at once


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text as an unsigned integer; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only: A-Z and x20, x09-x0D
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts = (stops - sizes)[: len(words) - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops[shingle - 1:].tolist())], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, text_key`` (hash of the text) ``, fingerprint`` (long, two's
    complement of the 64 bits)."""
    @F.pandas_udf(LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, shingle, seed) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(values.view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), simhash.asNondeterministic()("text").alias("fingerprint"))


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, concatenated."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class _Forest:
    """Component labels of a sorted run of fingerprints, and the edges that joined them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self._mark()

    def _mark(self):
        # Runs of one label: a range lies in one component if its ends share a run.
        self.run = np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))

    def unite(self, a: np.ndarray, b: np.ndarray):
        changed = False
        while True:
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(high, return_index=True)  # each root hooks once, to a smaller one
            self.edges.append((a[first], b[first]))
            parent = np.arange(len(self.root))
            parent[high[first]] = low[first]
            while True:
                jumped = parent[parent]
                if (jumped == parent).all():
                    break
                parent = jumped
            self.root = parent[self.root]
            changed = True
        if changed:
            self._mark()


def trie_forest(values: np.ndarray, cells: np.ndarray, budget: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning-forest edges (index pairs) of values at most ``budget`` bits apart
    within a cell. ``values`` (uint64) are sorted within each run of ``cells``."""
    n = len(values)
    bounds = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True])))
    forest = _Forest(n)
    zeros: dict[int, np.ndarray] = {}

    def below(depth: int) -> np.ndarray:  # zeros of the bit at this depth before each index
        if depth not in zeros:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate(([0], np.cumsum(bit == 0)))
        return zeros[depth]

    lo, hi = bounds[:-1], bounds[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    stack = [(0, np.stack([lo, hi, lo, hi, np.zeros(len(lo), dtype=lo.dtype)]))]
    while stack:
        depth, front = stack.pop()
        if front.shape[1] > _FRONT:
            stack.append((depth, front[:, _FRONT:]))
            front = front[:, :_FRONT]
        alo, ahi, blo, bhi, diff = front
        run, root = forest.run, forest.root
        one = (run[alo] == run[ahi - 1]) & (run[blo] == run[bhi - 1]) & (root[alo] == root[blo])
        if one.any():
            front = front[:, ~one]
            alo, ahi, blo, bhi, diff = front
        small = ((ahi - alo) * (bhi - blo) <= _PRODUCT) | (depth >= 64)
        if small.any():
            size = ((ahi - alo) * (bhi - blo))[small]
            base, width, other = alo[small], (bhi - blo)[small], blo[small]
            ends = np.cumsum(size)
            at = 0
            while at < len(size):  # blocks of bounded pair counts
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + _PAIRS, side="right")))
                counts = size[at:to]
                inner = _ranges(counts)
                w = np.repeat(width[at:to], counts)
                i = np.repeat(base[at:to], counts) + inner // w
                j = np.repeat(other[at:to], counts) + inner % w
                ok = (i != j) & (forest.root[i] != forest.root[j])
                i, j = i[ok], j[ok]
                near = np.bitwise_count(values[i] ^ values[j]) <= budget
                if near.any():
                    forest.unite(i[near], j[near])
                at = to
            front = front[:, ~small]
            alo, ahi, blo, bhi, diff = front
        if not front.shape[1]:
            continue
        z = below(depth)
        amid, bmid = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        own = alo == blo  # a node with itself: its two crossings are one
        nxt = np.concatenate([
            np.stack([alo, amid, blo, bmid, diff]), np.stack([amid, ahi, bmid, bhi, diff]),
            np.stack([alo, amid, bmid, bhi, diff + 1]),
            np.stack([amid, ahi, blo, bmid, diff + 1])[:, ~own]], axis=1)
        same = nxt[0] == nxt[2]
        live = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget) & ~(same & (nxt[1] - nxt[0] < 2))
        if live.any():
            stack.append((depth + 1, nxt[:, live]))
    return forest.edges


def _block_masks(blocks: int, budget: int) -> list[int]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - budget)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None,
          cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of the distinct
    ``prints.fingerprint`` at most ``max_bits`` apart."""
    blocks = blocks or max_bits + 2
    masks = _block_masks(blocks, max_bits)
    keyed = prints.select("fingerprint", F.explode(F.array(*[
        F.struct(F.lit(k).alias("part"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("fixed"))
        for k, m in enumerate(masks)])).alias("cell")).select("fingerprint", "cell.part", "cell.fixed")
    sizes = keyed.groupBy("part", "fixed").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, ["part", "fixed"])  # a sub-trie of one leaf has no pair
    pieces = F.ceil(F.col("n") / F.lit(cell_limit)).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), pieces.cast("long")).cast("int")
    # Chunk pairs of a large sub-trie; with one piece the only cell is (0, 0).
    others = F.explode(F.sequence(F.lit(0), pieces - 1)).alias("other")
    dealt = (keyed.select("part", "fixed", "fingerprint", own.alias("own"), others)
             .select("fingerprint", F.xxhash64("part", "fixed", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
             .repartition("cell").sortWithinPartitions("cell"))

    def run(batches):
        held_cells, held_values = [], []

        def solve(cells, values):
            order = np.lexsort((values, cells))
            cells, values = cells[order], values[order]
            edges = trie_forest(values, cells, max_bits)
            if not edges:
                return None
            a, b = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(values[a].view(np.int64)), pa.array(values[b].view(np.int64))], names=["a", "b"])

        count = 0
        for batch in batches:
            held_values.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held_cells.append(batch.column(1).to_numpy(zero_copy_only=False))
            count += batch.num_rows
            if count >= 2 * CELL_LIMIT:
                cells, values = np.concatenate(held_cells), np.concatenate(held_values)
                last = int(np.flatnonzero(cells != cells[-1])[-1]) + 1 if (cells != cells[-1]).any() else 0
                if last:
                    if (out := solve(cells[:last], values[:last])) is not None:
                        yield out
                held_cells, held_values, count = [cells[last:]], [values[last:]], len(cells) - last
        if count:
            if (out := solve(np.concatenate(held_cells), np.concatenate(held_values))) is not None:
                yield out

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): root is the smallest
    node reachable. Alternating stars; the rounds grow with the logarithm of
    the longest chain."""
    def mark(frame):
        return frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                          .filter("a != b").distinct())
    before = mark(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _dealt(both.filter("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _dealt(large, least, "a", "b")
        current = store(union_all([
            small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")),
            least.select("a", F.col("m").alias("b"))]).distinct())
        after = mark(current)
        if after == before:
            break
        before = after
    return union_all([current.select(F.col("a").alias("node"), F.col("b").alias("root")),
                      current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()])


def _dealt(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) in ``SALTS`` copies: the rows of one key,
    which may be all edges of a component, spread by the hash of ``by``."""
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [key, "salt"]).drop("salt")


def classes(prints: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """``doc_id, text_key, fingerprint, root`` (smallest linked fingerprint)
    ``, component_id`` for a stored table of fingerprints."""
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    roots = store(components(links(distinct, max_bits, cell_limit=cell_limit)))
    # Only linked fingerprints ask for their component's smallest id; all others are their own.
    linked = store(distinct.join(roots, F.col("fingerprint") == F.col("node")).select("fingerprint", "least_id", "root"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = _dealt(linked, least, "root", "fingerprint").select("fingerprint", "root", "component_id")
    alone = distinct.join(linked, "fingerprint", "left_anti").select(
        "fingerprint", F.col("fingerprint").alias("root"), F.col("least_id").alias("component_id"))
    return narrow(prints.join(found.unionByName(alone), "fingerprint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Per document ``doc_id, text_key, fingerprint`` (16 hex digits) ``, root,
    component_id`` (smallest id reachable over links of at most ``max_bits`` bits)."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    return classes(prints, max_bits, cell_limit).withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs``, all columns, per component: that with the smallest id
    (rows without one come last); of repeated rows one stays."""
    found = near_duplicates(docs, id_col, text_col, **options)
    first = found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("p"))
    columns = docs.columns
    picked_id, picked_key, n = (fresh(columns, x) for x in ("__id", "__key", "__n"))
    picked = first.select(F.col("p.doc_id").alias(picked_id), F.col("p.text_key").alias(picked_key)).distinct()
    joined = docs.join(picked, F.col(id_col).eqNullSafe(F.col(picked_id)) & (F.xxhash64(F.col(text_col)) == F.col(picked_key)))
    # Rows equal in id and text may differ elsewhere: the smallest by all that can be ordered stays.
    ordered = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant" and c not in (id_col, text_col)]
    same = W.partitionBy(picked_id, picked_key).orderBy(*[F.col(f"`{c}`") for c in (*ordered, text_col)])
    return joined.withColumn(n, F.row_number().over(same)).filter(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in columns])
