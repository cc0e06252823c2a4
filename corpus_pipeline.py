"""Corpus pipeline: toxicity, quality rules, near-duplicates, decontamination, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet and reads back as the
next stage's documents. All but the last return the columns they were given.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemark.llm import decontam, packing, quality, simhash, toxicity
from pagemark.llm.common import fresh
from pagemark.llm.queries import held_out
from pagemark.session import cut_lineage
from pagemark.sources.tables import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; rows without text stay."""
    columns = docs.columns
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=~held_out())
    into = fresh(columns, "__toxicity")
    scored = toxicity.score(docs, model, into=into)
    return scored.filter(F.col(f"{into}.score") < toxicity.THRESHOLD).select(*[F.col(f"`{c}`") for c in columns])


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    return quality.apply_policy(quality.ledger(docs)).filter("kept").select("doc.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    found_id, found_key = fresh(docs.columns, "__id"), fresh(docs.columns, "__key")
    found = decontam.matches(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(
        F.col("doc_id").alias(found_id), F.col("text_key").alias(found_key))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(found_id)) & (F.xxhash64("text") == F.col(found_key)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as ``op9_pack`` returns them."""
    return packing.pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", reject_low_quality),
    ("simhash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

# Learned scores, XXH64 fingerprints and token ids have no SQL form; the stages
# are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
