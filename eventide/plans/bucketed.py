"""Returns in a bucketed table: the layout as an index for joins by symbol and day.

Rows are dealt into buckets by (symbol, day), sorted by symbol, day and time inside each, in one folder per month. A join of
events with their window's returns finds them partitioned as it needs and shuffles only the events; no symbol, however much
it trades, is more than its days to one bucket. A bucketed table needs a name in the session's catalog, so a new session
says where it lies with :func:`attach`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COLUMNS = "symbol STRING, day DATE, ts TIMESTAMP_NTZ, r1m DOUBLE, rv_30m DOUBLE, month DATE"


def write_bucketed(returns: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Write (symbol, day, ts, r1m, rv_30m) into a new table under ``path`` and read it."""
    month = F.trunc("day", "month").alias("month")
    # Dealt out as the buckets are, each bucket is written by one task, as one file a month.
    dealt = returns.select("symbol", "day", "ts", "r1m", "rv_30m", month).repartition(buckets, "symbol", "day")
    writer = dealt.write.format("parquet").bucketBy(buckets, "symbol", "day").sortBy("symbol", "day", "ts").partitionBy("month")
    writer.option("path", path).saveAsTable(table)
    return read_bucketed(returns.sparkSession, table)


def attach(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """Name a table that another session has written."""
    spark.sql(
        f"CREATE TABLE {table} ({COLUMNS}) USING parquet PARTITIONED BY (month) "
        f"CLUSTERED BY (symbol, day) SORTED BY (symbol, day, ts) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.recoverPartitions(table)
    return read_bucketed(spark, table)


def read_bucketed(spark: SparkSession, table: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The returns of a closed range of days (all without bounds); whole months outside are not listed."""
    rows = spark.table(table)
    for bound, sign in ((first, ">="), (last, "<=")):
        if bound is not None:
            rows = rows.filter(F.expr(f"day {sign} DATE '{bound}' AND month {sign} trunc(DATE '{bound}', 'month')"))
    return rows.select("symbol", "day", "ts", "r1m", "rv_30m")
