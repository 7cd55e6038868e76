"""What several operators share: scratch tables, Arrow mapping, ranks over sorted partitions."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from eventide.session import shared_folder, with_scratch

BROADCAST_ROWS = 1_000_000  # counted before a broadcast; rows of a few numbers or short strings
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which every executor reaches.

    Where that is unset, as in tests, a temporary folder serves, but only in a session of one process.
    """
    return f"{shared_folder(with_scratch(spark))}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: what follows no longer depends on lost tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table of short rows that has been counted to be small; otherwise leave the join to Spark."""
    return F.broadcast(table) if table.count() <= most else table


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to differ from every column, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII text takes the faster built-in, with the same result."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows in a global order, written, with ``part`` and ``pos`` (row number inside its part, from 0).

    Parts are ranges of the order, so (part, pos) sorts all rows. The table is written, because sampled range
    bounds may change when a lost stage runs again. Sampling reads ``df`` once more than it is used.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n, dtype=np.int64))],
                names=[*batch.schema.names, "part", "pos"],
            )
            done += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema.fields)
    return written(spread.mapInArrow(number, f"{fields}, part int, pos bigint"), name)


def with_rank(table: DataFrame, group: str | None = None, rank: str = "rank") -> DataFrame:
    """Add the rank from 0, over all rows or inside each ``group``, to a table of ``numbered``.

    ``group`` must lead the order, so that its rows are neighbours. One small row per part (and group) is summed up.
    """
    keys = ["part"] if group is None else [group, "part"]
    counts = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"))
    before = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = counts.select(
        *[F.col(k).alias(f"_{k}") for k in keys], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base")
    )
    same = [table[k].eqNullSafe(bases[f"_{k}"]) for k in keys]
    joined = table.join(bases, same)
    return joined.withColumn(rank, F.col("_base") + F.col("pos")).drop("_base", *[f"_{k}" for k in keys])
