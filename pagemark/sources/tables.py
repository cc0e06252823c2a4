"""Scans of the driver tables (A1-A7 read side).

Every reader returns a lazy DataFrame; column pruning and filter pushdown
reach the Parquet scan because nothing here selects eagerly.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as a session-zone TIMESTAMP (it loads as NTZ)."""
    ev = table(spark, sf_dir, "events")
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))
