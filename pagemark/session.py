"""Spark session settings shared by jobs, tests and the bench.

On a cluster the session comes from the launcher; ``configure`` only fills
in settings that are still unset, so cluster-level choices win.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. Sized for local tests; on a cluster the
# launcher's values (shuffle partitions, broadcast threshold) take over.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast is decided at run time by AQE from the measured size of the
    # small side; this is the size bound (bytes) for that decision.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Duplicate header names in a request: the last one wins (L1).
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files of cut lineage are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    conf = spark.conf
    # A broadcast bound chosen by the launcher holds at run time too.
    chosen = spark.sparkContext.getConf().get("spark.sql.autoBroadcastJoinThreshold", None)
    for key, value in DEFAULTS.items():
        if chosen and key == "spark.sql.adaptive.autoBroadcastJoinThreshold":
            value = chosen
        try:
            if conf.get(key, None) in (None, ""):
                conf.set(key, value)
        except Exception:  # static conf already fixed by the launcher
            pass
    # Python workers import this package from where the driver has it (on a cluster it is
    # shipped with the job; a folder that is not there does no harm).
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    # Static settings that must be pinned, whatever the launcher chose.
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "pagemark") -> SparkSession:
    """Session for tests and the bench (local mode, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Python workers and stateful processors talk over local sockets, not ports.
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("PAGEMARK_DRIVER_MEMORY", "16g"))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage and stream checkpoints.

    Read from ``spark.checkpoint.dir`` as the cluster names it; only when it is
    unset (local tests) a scratch folder is created, which the context then holds.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="pagemark-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


# Characters of text a task takes, and how few are worth a task of their own.
TASK_CHARS, LEAST_TASK_CHARS = 4 * 1024 * 1024, 64 * 1024


def partitions_for(df, column: str) -> int:
    """Partitions for ``df`` such that a task's share of the texts in ``column`` stays the
    same however large the table is; up to the number of cores also for less. Reads
    ``df`` once: written out beforehand where it is costly."""
    chars = df.agg(F.sum(F.length(column))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-chars // TASK_CHARS), min(cores, -(-chars // LEAST_TASK_CHARS)))


def tables_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; to be called when no
    DataFrame built on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and
    return a DataFrame reading it back.

    Used for narrow intermediate tables that later steps branch from, filter
    on and reuse: the written copy is computed once, survives executor loss
    (the output committer makes the write atomic), prunes columns on read,
    and keeps the optimizer from inlining the address-parsing expressions
    into every filter pushed below them.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
