"""Benchmark decontamination as a prefix-filtered set join, in DataFrame
expressions only.

Items are cut into windows of ``window`` consecutive words (shorter items are
one window). A window occurs in a document only if all its words do, so one
necessary prefix word is enough to find it: its rarest, by the words' counts
over all documents. Documents explode to (position, word) inside one
generated-code span, meet the prefix words in a hash join, pass the length and
positional bounds (the window must fit around that position), and are verified
by comparing the whole window at once; the document's word array only leaves
the span for verified windows.

The windows are the stated query set. They are run in blocks of at most
``block_windows`` windows, each block small enough to broadcast by its proven
bound, one pass over the documents per block (one block for benchmarks of up
to ``block_windows`` windows; the count is read first).

Null texts have no words: nothing occurs in them. Repeated document rows each
get the full result. Items with the same text form one class and are expanded
to their ids only per matched document; items with a null id mark words as
hit but are not counted or listed. Empty tables give empty results or zero
hits. Only id and text columns are read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pagemark.llm.common import WORD, lower_az, narrow, store, union_all, words
from pagemark.session import cut_lineage

WINDOW = 13
BLOCK_WINDOWS = 100_000
PERCENT = 5  # of a document's words


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(classes: ``class, item_id``; windows: ``class, at, phrase, size``).
    A class is the space-joined words of an item."""
    source = items.select(F.col(id_col).alias("item_id"), words(lower_az(F.col(text_col)), WORD).alias("w"))
    source = source.filter(F.size("w") > 0).withColumn("class", F.array_join("w", " "))
    classes = source.select("class", "item_id").distinct()
    one = source.groupBy("class").agg(F.first("w").alias("w"))
    last = F.greatest(F.size("w") - F.lit(window) + 1, F.lit(1))
    cut = one.select("class", "w", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    return classes, cut.select("class", "at", F.slice("w", F.col("at"), window).alias("ws")).select(
        "class", F.array_join("ws", " ").alias("phrase"), F.size("ws").alias("size"))


def _exploded(docs: DataFrame) -> DataFrame:
    """Positions and lower-cased words; every column but these stays a reference."""
    exploded = docs.select("*", F.posexplode("w").alias("pos", "raw"))
    return exploded.withColumn("word", lower_az(F.col("raw"))).drop("raw")


def occurrences(docs: DataFrame, windows: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Every place of every distinct phrase: ``doc_id, text_key, n_words, start, size, phrase``.
    ``docs``: ``doc_id, text_key, w`` (words, not lower-cased)."""
    phrases = store(windows.select("phrase", "size").distinct())
    blocks = max(1, -(-phrases.count() // block_windows))
    found = []
    for block in range(blocks):
        mine = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block) if blocks > 1 else phrases
        parts = mine.select("phrase", "size", F.posexplode(F.split("phrase", " ")).alias("place", "word"))
        # At most block_windows * window words: the bound of this block's broadcasts.
        counts = (_exploded(docs.select("w")).join(F.broadcast(parts.select("word").distinct()), "word")
                  .groupBy("word").agg(F.count("*").alias("n")))
        ranked = parts.join(F.broadcast(counts), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rarest = ranked.groupBy("phrase", "size").agg(
            F.min(F.struct("n", "word", "place")).alias("p")).select(
            "phrase", "size", F.col("p.n").alias("n"), F.col("p.word").alias("word"), F.col("p.place").alias("place"))
        # A window whose rarest word is in no document occurs nowhere.
        prefix = store(rarest.filter("n > 0").select("phrase", "size", "word", "place"))
        hits = _exploded(docs).join(F.broadcast(prefix), "word")
        start = F.col("pos") - F.col("place")
        fits = (start >= 0) & (start + F.col("size") <= F.size("w"))
        same = lower_az(F.array_join(F.slice("w", start + 1, F.col("size")), " ")) == F.col("phrase")
        found.append(hits.filter(F.when(fits, same).otherwise(False))
                     .select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"),
                             start.cast("long").alias("start"), "size", "phrase"))
    return union_all(found)


EMPTY_SPANS = "cast(array() as array<struct<start:bigint,stop:bigint>>)"


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"),
                       words(F.col(text_col), WORD).alias("w"))


def _spans(places: DataFrame, key: list[str]) -> DataFrame:
    """Union of the intervals ``start, stop`` of each ``key``: array ``spans`` by start. A
    place begins a span if it starts beyond every stop so far; one ordered pass over
    a document's places, then one row per span."""
    ordered = W.partitionBy(*key).orderBy("start", "stop")
    far = F.max("stop").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    marked = places.withColumn("begins", F.coalesce((F.col("start") > far).cast("int"), F.lit(1)))
    numbered = marked.withColumn("span", F.sum("begins").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = numbered.groupBy(*key, "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_id_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW,
            percent: int = PERCENT, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Documents in which a window occurs: ``doc_id, text_key`` (hash of the text)
    ``, n_words, n_hit, spans`` (merged hit intervals) ``, items`` (ids as strings,
    sorted) ``, contaminated``. One row per distinct id and text."""
    classes, windows = item_windows(items, item_id_col, item_text_col, window)
    windows = store(windows)
    hits = cut_lineage(occurrences(_source(docs, id_col, text_col), windows, block_windows))
    key = ["doc_id", "text_key"]
    # Places and items of one document meet in one aggregation; a place and a
    # class each count once however many windows or repeated rows give them.
    spans = _spans(hits.select(*key, "n_words", "start", (F.col("start") + F.col("size")).alias("stop")).distinct(), [*key, "n_words"])
    listed = (hits.select(*key, "phrase").distinct()
              .join(windows.select("phrase", "class").distinct(), "phrase")
              .select(*key, "class").distinct()
              .join(classes.filter("item_id IS NOT NULL"), "class")
              .select(F.col("doc_id").alias("i_doc"), F.col("text_key").alias("i_key"), F.col("item_id").cast("string").alias("item"))
              .groupBy("i_doc", "i_key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    found = spans.join(listed, F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("text_key") == F.col("i_key")), "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return (found.select(*key, "n_words", n_hit.alias("n_hit"), "spans",
                         F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``matches`` for every document row, those without a match included."""
    found = matches(docs, items, id_col, text_col, **options).select(
        F.col("doc_id").alias("m_doc"), F.col("text_key").alias("m_key"), "n_hit", "spans", "items", "contaminated")
    rows = _source(docs, id_col, text_col).select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"))
    return narrow(rows.join(found, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("text_key") == F.col("m_key")), "left")).select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.expr(EMPTY_SPANS)).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"))
