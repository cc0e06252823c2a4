"""Delta-maintained token-count rollups.

A change is an insert, delete or revise of one document's count under one
tokenizer version. A batch commit turns its changes into signed rows (an
insert +new, a delete -old, a revision both) against the committed ledger,
writes them and their sums by source, language and tokenizer version to folders of
its own, and then claims the next entry of the log, which names them. Only what the
log names is read: a batch that died halfway is simply run again, a batch
delivered twice is recognised and changes nothing. An entry is created exclusively,
so of two writers that read the same state one claims it and the other reads the
new state and computes its batch again (``ATTEMPTS`` times at most). This needs a
file system that creates a file only if it is not there (HDFS, local disks).

Totals are additive: the sum of the committed batches' delta sums, whatever
the order. Within a batch the last change of a document (by ``seq``) counts;
deleting or revising what is not there behaves as nothing or as an insert;
inserting what is there as a revision. Changes with any other op, or none, are
ignored before that. ``compact`` writes the counted documents and totals as one entry,
after which earlier folders are not read any more; a commit does so itself after
``COMPACT`` entries.

Null source or language is a group of its own; changes with a null document id
or tokenizer version are ignored; a null count is zero. Empty batches commit.
Extra columns are ignored.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pagemark.llm import tokens
from pagemark.llm.common import narrow
from pagemark.session import checkpoint_dir

KEYS = ("source", "lang", "tokenizer")
SIGNED = "doc_id string, source string, lang string, tokenizer string, tokens long, sign int"
SUMS = "source string, lang string, tokenizer string, documents long, tokens long"
LOG = "seq long, batch long, data string"   # batch null: a compaction, which replaces what is before it
ATTEMPTS = 20
COMPACT = 64


class Rollup:
    """State under ``path``: ``ledger/<data>`` (signed rows), ``sums/<data>``, and
    ``log/<seq>.json``, one small file an entry."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{checkpoint_dir(spark).rstrip('/')}/rollups/{uuid.uuid4().hex}").rstrip("/")
        if path is None:
            self._claim(0, None, None)

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Rollup:
        made = cls(spark, path)
        made._claim(0, None, None)
        return made

    def _claim(self, seq: int, batch: int | None, data: str | None) -> bool:
        """Create entry ``seq`` of the log; False if it is there already."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{seq:08d}.json")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = files.create(target, False)
        except Py4JJavaError:
            if files.exists(target):
                return False
            raise
        try:
            out.write(bytearray(json.dumps({"seq": seq, "batch": batch, "data": data}).encode()))
        finally:
            out.close()
        return True

    def _log(self) -> list:
        """Entries in order; one that is being written is not seen yet."""
        rows = self.spark.read.schema(LOG).json(f"{self.path}/log").where("seq IS NOT NULL").collect()
        return sorted(rows, key=lambda r: r["seq"])

    def committed(self) -> list[int]:
        return sorted(r["batch"] for r in self._log() if r["batch"] is not None)

    def _read(self, kind: str, schema: str, log: list | None = None) -> DataFrame:
        log = self._log() if log is None else log
        start = max((i for i, r in enumerate(log) if r["batch"] is None), default=0)
        paths = [f"{self.path}/{kind}/{r['data']}" for r in log[start:] if r["data"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self, among: DataFrame | None = None, log: list | None = None) -> DataFrame:
        """The documents counted now: ``doc_id, source, lang, tokenizer, tokens``; only those
        ``among`` the given (doc_id, tokenizer), whose ledger rows alone are aggregated."""
        rows = self._read("ledger", SIGNED, log)
        if among is not None:
            rows = rows.join(among, ["doc_id", "tokenizer"], "left_semi")
        keys = ["doc_id", *KEYS]
        return (rows.groupBy(*keys).agg(F.sum(F.col("tokens") * F.col("sign")).alias("tokens"), F.sum("sign").alias("n"))
                .filter("n > 0").drop("n"))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (``seq, op, doc_id, source, lang, tokenizer, tokens``);
        False if the batch was committed before."""
        latest = W.partitionBy("doc_id", "tokenizer").orderBy(F.desc("seq"), "op", "source", "lang", "tokens")
        new = (changes.filter("doc_id IS NOT NULL AND tokenizer IS NOT NULL AND op IN ('insert', 'delete', 'revise')").select(
            "seq", "op", F.col("doc_id").cast("string").alias("doc_id"), "source", "lang", "tokenizer",
            F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
            .withColumn("rank", F.row_number().over(latest)).filter("rank = 1"))
        come = new.filter("op IN ('insert', 'revise')").select("doc_id", *KEYS, "tokens", F.lit(1).alias("sign"))
        for _ in range(ATTEMPTS):
            log = self._log()
            if any(r["batch"] == batch for r in log):
                return False
            gone = self.current(new.select("doc_id", "tokenizer"), log).select("doc_id", *KEYS, "tokens", F.lit(-1).alias("sign"))
            if self._append(log, batch, gone.unionByName(come)):
                start = max(i for i, r in enumerate(log) if r["batch"] is None)
                if len(log) - start >= COMPACT:
                    self.compact()
                return True
        raise RuntimeError(f"batch {batch} lost the log's next entry {ATTEMPTS} times")

    def _append(self, log: list, batch: int | None, rows: DataFrame) -> bool:
        """Write signed rows and their sums, then claim the entry after ``log``."""
        data = uuid.uuid4().hex
        ledger = f"{self.path}/ledger/{data}"
        narrow(rows).write.parquet(ledger)
        (self.spark.read.schema(SIGNED).parquet(ledger).groupBy(*KEYS)
         .agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("tokens") * F.col("sign")).alias("tokens"))
         .coalesce(1).write.parquet(f"{self.path}/sums/{data}"))
        return self._claim(log[-1]["seq"] + 1, batch, data)

    def compact(self) -> bool:
        """One entry with the counted documents instead of all before it; False if a commit
        came in between, which then stands."""
        log = self._log()
        return self._append(log, None, self.current(log=log).select("doc_id", *KEYS, "tokens", F.lit(1).alias("sign")))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` of the committed batches."""
        return (self._read("sums", SUMS).groupBy(*KEYS)
                .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents > 0"))


def count_tokens(text: Column, json_path: str | None = None, rank_path: str | None = None) -> Column:
    """Tokens of whole texts under the byte-level BPE vocabulary; null: 0."""
    default_json, default_ranks = tokens.default_paths()
    json_path, rank_path = json_path or default_json, rank_path or default_ranks
    return _counter(json_path, rank_path)(text)


def _counter(json_path: str, rank_path: str):
    def run(batches):
        for texts in batches:
            yield pd.Series([len(tokens.encode(t, json_path, rank_path)) for t in texts], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long").asNondeterministic()
