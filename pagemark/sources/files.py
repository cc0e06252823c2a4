"""File sources and sinks (A1, A4, A5, A7) for production inputs.

The registered queries derive their inputs from the driver tables; these are
the readers a deployment points at its own captures.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: tool defaults of the reference ------------------------------
URL_DEFAULTS = {"wait_until": "domcontentloaded", "timeout_ms": 60000, "headless": True,
                "poll_budget_ms": 5000, "poll_interval_ms": 250}
WAIT_UNTIL = ("load", "domcontentloaded", "networkidle", "commit")

URL_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("wait_until", T.StringType()),
    T.StructField("timeout_ms", T.IntegerType()),
    T.StructField("headless", T.BooleanType()),
    T.StructField("poll_budget_ms", T.IntegerType()),
    T.StructField("poll_interval_ms", T.IntegerType()),
])
HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
REQUEST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("scope_type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("query_string", T.StringType()),
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("client_ip", T.StringType()),
])


def read_urls(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: URL work list; missing options take the tool defaults, and an
    unknown ``wait_until`` is kept but flagged."""
    df = spark.read.format(fmt).schema(URL_SCHEMA).option("header", "true").load(path)
    out = df.select("url", *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in URL_DEFAULTS.items()])
    return out.withColumn("valid_wait_until", F.col("wait_until").isin(*WAIT_UNTIL))


def read_key_file(spark: SparkSession, path: str) -> DataFrame:
    """A4: one key per line, trimmed; blank and `#` lines dropped; a set. A
    missing file is an empty set (every key check then fails closed)."""
    empty = spark.createDataFrame([], "key string")
    try:
        lines = spark.read.text(path)
        lines.schema  # resolves the path now
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # only a missing file means no keys
        return empty
    key = F.regexp_replace(F.col("value"), "^[ \t\r\n]+|[ \t\r\n]+$", "")
    return lines.select(key.alias("key")).where((F.col("key") != "") & ~F.col("key").startswith("#")).distinct()


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A5: request log as JSON lines (nested header pairs), batch or stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUEST_SCHEMA).json(path)


RESPONSE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("body", T.StringType()),
    T.StructField("elapsed_ms", T.LongType()),
    T.StructField("error", T.StringType()),
])
CAPTURE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("elapsed_ms", T.LongType()),
    T.StructField("capture_mode", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("error", T.StringType()),
])
BROKEN = "_broken"


def _captured(spark: SparkSession, path: str, schema: T.StructType, stream: bool, max_files: int | None) -> DataFrame:
    """JSON lines of captures. Lines that are no such record are left out, as nobody can
    tell their URL; ``stream`` reads files as they come, each once (Spark's file
    offsets), at most ``max_files`` a micro-batch."""
    reader = (spark.readStream if stream else spark.read).schema(T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())]))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.json(path)
    return rows.where(F.col("url").isNotNull()).drop(BROKEN)


def read_responses(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """A2: captured responses as JSON lines, headers as name/value pairs the way servers
    write them. Header names are lower-cased here, once; of a repeated name the
    last value holds, except that ``location`` keeps its first, as clients do.
    Gives ``url, status, headers`` (map) ``, body, elapsed_ms, error``."""
    rows = _captured(spark, path, RESPONSE_SCHEMA, stream, max_files)
    pairs = F.filter("headers", lambda h: h["name"].isNotNull())
    lowered = F.transform(pairs, lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"), F.trim(h["value"]).alias("value")))
    place = F.filter(lowered, lambda h: h["name"] == "location")
    headers = F.map_from_entries(F.concat(lowered, F.slice(place, 1, 1)))   # the last of a name wins (session setting)
    return rows.select("url", "status", headers.alias("headers"), "body", "elapsed_ms", "error")


def read_captures(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """A3: render captures as JSON lines, batch or stream: ``url, ts, elapsed_ms,
    capture_mode`` (headless unless said) ``, html, error``."""
    rows = _captured(spark, path, CAPTURE_SCHEMA, stream, max_files)
    return rows.withColumn("capture_mode", F.coalesce("capture_mode", F.lit("headless")))


def write_captured(rows: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines as ``read_responses`` and ``read_captures`` take them; a map of headers
    becomes pairs."""
    kind = dict(rows.dtypes).get("headers", "")
    if kind.startswith("map"):
        rows = rows.withColumn("headers", F.transform(F.map_entries("headers"), lambda e: F.struct(
            e["key"].alias("name"), e["value"].alias("value"))))
    rows.write.mode(mode).json(path)


def write_outcomes(outcomes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Outcome sink, one directory per status."""
    outcomes.write.mode(mode).partitionBy("status").parquet(path)


def stream_outcomes(outcomes: DataFrame, path: str, checkpoint: str):
    """A7 for streams: append-only Parquet sink with its own checkpoint."""
    return (outcomes.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).partitionBy("status").start())
