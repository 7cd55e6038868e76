"""Session settings the library benefits from."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings, safe to apply to a session somebody else created.
RUNTIME_CONF = {
    # Returns leave their window stage partitioned by (symbol, day). With this off, a join on
    # (symbol, day, slot) keeps that partitioning, so the bars cross the network once, not twice.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Events that turn out small per partition are hashed, and the bars need no second sort for the
    # join. Larger ones fall back to sort-merge; Spark checks the size at run time.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


PARTITION_BYTES = 128 * 1024 * 1024


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the runtime settings to an existing session.

    ``input_bytes``, the size of the bars a job reads, sets how finely its shuffles start out; adaptive
    execution merges what turns out small but never splits beyond this number.
    """
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    if input_bytes is not None:
        wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // PARTITION_BYTES))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eventide")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``. The library never makes one up."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def with_scratch(spark: SparkSession) -> SparkSession:
    """For scripts and comparisons in one process: a temporary checkpoint folder where none is configured."""
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventide-scratch-"))
    return spark


def table_bytes(spark: SparkSession, *paths: str) -> int:
    """Size of files and folders, from the file system's own summary."""
    total = 0
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        total += place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return total


def input_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size of a file or folder and when it last changed, to tell whether what was derived from it still holds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    changed = [files.getFileStatus(place).getModificationTime()]
    if files.getFileStatus(place).isDirectory():
        changed += [s.getModificationTime() for s in files.listStatus(place)]
    return table_bytes(spark, path), max(changed)
