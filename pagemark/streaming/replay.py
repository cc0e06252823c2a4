"""Replay a derived table as a file stream and read the sink back.

The table is written once, split by event time into a few phases; each phase
is appended to the stream's input folder, as many files as Spark writes, and
the query runs on from its checkpoint until it has read them. State carries
across phases as it would for a live feed, and every run reads several files
in one micro-batch. All paths live under the shared checkpoint folder named
by ``spark.checkpoint.dir``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemark.session import checkpoint_dir

PHASES = 4


def _base(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def split_by_time(df: DataFrame, ts: str, path: str, phases: int = PHASES) -> DataFrame:
    """``df`` written once, partitioned by ``phase``: equal parts of its time span."""
    at = F.unix_micros(F.col(ts))
    span = df.agg(F.min(at).alias("_low"), (F.max(at) - F.min(at) + 1).alias("_span"))  # one row
    phase = F.floor((at - F.col("_low")) * phases / F.col("_span")).cast("int")
    df.crossJoin(F.broadcast(span)).withColumn("phase", phase).drop("_low", "_span").write.partitionBy("phase").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_stream(spark: SparkSession, name: str, source: DataFrame, ts: str, build, phases: int = PHASES) -> DataFrame:
    """Replay ``source`` as a stream through ``build(stream_df)`` with
    ``availableNow`` runs into a Parquet sink; return the sink as a batch
    DataFrame."""
    base = _base(spark, name)
    staged = split_by_time(source, ts, f"{base}/staged", phases)
    for phase in range(phases):
        staged.where(F.col("phase") == phase).drop("phase").select(*source.columns).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{base}/in")
        query = (build(stream).writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", f"{base}/chk").option("path", f"{base}/out")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
