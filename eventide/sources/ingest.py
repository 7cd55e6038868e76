"""Reading, cleaning and adding rows to the domain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from eventide.functions import parsing
from eventide.sources import archives

KLINE_FIELDS = 12  # columns of an archive row; the ones after the ninth are not used
# First cell of an optional header line.
HEADER_CELLS = ("open_time", "open time")


# ---- kline archives -----------------------------------------------------------------------

def read_archive_lines(spark: SparkSession, folder: str, symbols: Sequence[str], months: tuple[str, str] | None = None) -> DataFrame:
    """(path, symbol, month, line_no, line) of every archive whose symbol is wanted, and whose month lies between the two given.

    Symbols and months are read off the file names, so no other archive is opened.
    """
    wanted = [s.strip().upper() for s in symbols]
    lines = archives.register(spark).read.format(archives.FORMAT).option("path", folder).load().filter(F.col("symbol").isin(wanted))
    return lines if months is None else lines.filter(F.col("month").between(*months))


def parse_kline_lines(lines: DataFrame) -> DataFrame:
    """(symbol, line_no, line, ...) -> typed bar columns plus ``is_valid``; header lines are left out.

    Cells are taken by position: 0 epoch milliseconds, 1-5 open, high, low, close, volume, 8 trades.
    """
    names = [f"_c{i}" for i in range(KLINE_FIELDS)]
    cells = F.from_csv("line", ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE"})
    split = lines.withColumn("_cells", cells).select("*", "_cells.*").drop("_cells", "line")
    header = (F.col("line_no") == 0) & F.lower(parsing.strip(F.coalesce("_c0", F.lit("")))).isin(*HEADER_CELLS)
    typed = split.filter(~header).select(
        *[c for c in split.columns if not c.startswith("_c")],
        parsing.epoch_millis_to_timestamp(F.col("_c0")).alias("open_time"),
        parsing.to_double(F.col("_c1")).alias("open_price"),
        parsing.to_double(F.col("_c2")).alias("high_price"),
        parsing.to_double(F.col("_c3")).alias("low_price"),
        parsing.to_double(F.col("_c4")).alias("close_price"),
        parsing.to_double(F.col("_c5")).alias("volume"),
        parsing.to_int(F.col("_c8")).alias("number_of_trades"),
    )
    return flag_klines(typed)


def flag_klines(typed: DataFrame) -> DataFrame:
    """Add ``is_valid``: every field converted, volume and trades not negative.

    NaN passes, as it is neither missing nor negative.
    """
    fields = ["open_time", "open_price", "high_price", "low_price", "close_price", "volume", "number_of_trades"]
    negative = ((F.col("volume") < 0) & ~F.isnan("volume")) | (F.col("number_of_trades") < 0)
    return typed.withColumn("is_valid", _all_present(fields) & F.coalesce(~negative, F.lit(False)))


# ---- CSV tables ---------------------------------------------------------------------------

def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header line: the named columns as text, a column the file lacks as NULL, and
    ``arrival``, which orders the rows as they stand in their files."""
    table = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    # Ids grow along each piece of a file; pieces are ordered by where they start.
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    named = [F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return table.select(*named, place.alias("arrival"))


def clean_series(text: DataFrame, values: Sequence[str], time: str = "ts") -> DataFrame:
    """(symbol, ts, values..., arrival, is_valid) from text; an empty symbol or a bad cell is invalid."""
    typed = text.select(
        "arrival",
        parsing.clean_symbol("symbol").alias("symbol"),
        parsing.to_timestamp(F.col(time)).alias(time),
        *[parsing.to_double(F.col(v)).alias(v) for v in values],
    )
    return typed.withColumn("is_valid", (F.col("symbol") != "") & _all_present([time, *values]))


def _all_present(columns: Sequence[str]) -> Column:
    present = F.lit(True)
    for column in columns:
        present = present & F.col(column).isNotNull()
    return present


def valid_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter("is_valid").drop("is_valid")


def quality_counts(flagged: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n_good, n_bad)."""
    return flagged.groupBy(*keys).agg(
        F.count_if(F.col("is_valid")).alias("n_good"), F.count_if(~F.col("is_valid")).alias("n_bad")
    )


def load_klines(spark: SparkSession, folder: str, symbols: Sequence[str], months: tuple[str, str] | None = None) -> DataFrame:
    return parse_kline_lines(read_archive_lines(spark, folder, symbols, months).drop("month"))


def load_funding(spark: SparkSession, path: str) -> DataFrame:
    return clean_series(read_csv_text(spark, path, ["symbol", "ts", "rate"]), ["rate"])


def load_open_interest(spark: SparkSession, path: str) -> DataFrame:
    return clean_series(read_csv_text(spark, path, ["symbol", "ts", "oi"]), ["oi"])


def load_premium_index(spark: SparkSession, path: str) -> DataFrame:
    values = ["open_val", "high_val", "low_val", "close_val"]
    return clean_series(read_csv_text(spark, path, ["symbol", "ts", *values]), values)


def write_csv(table: DataFrame, path: str) -> None:
    """CSV with a header line and ISO times separated by a blank."""
    times = [name for name, kind in table.dtypes if kind == "timestamp_ntz"]
    table.withColumns({c: F.col(c).cast("string") for c in times}).write.mode("overwrite").csv(path, header=True)


# ---- symbols and keyed inserts ------------------------------------------------------------

def symbol_dimension(names: DataFrame, column: str = "symbol") -> DataFrame:
    """(symbol, base_asset, quote_asset): cleaned and distinct, empties skipped."""
    symbol = F.col("symbol")
    cleaned = names.filter(F.coalesce(F.col(column), F.lit("")) != "")
    cleaned = cleaned.select(parsing.clean_symbol(column).alias("symbol")).distinct()
    return cleaned.select(
        symbol, parsing.base_asset(symbol).alias("base_asset"), parsing.quote_asset(symbol).alias("quote_asset")
    )


def insert_ignore(batch: DataFrame, target: DataFrame | None, key: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """Rows of ``batch`` to append: the first to arrive per key, if the target has no such key yet.

    Only one writer may add to a table at a time. The rank limit is applied in the map tasks too, so a
    key repeated without end reaches its reduce task as one row per map task.
    """
    first = Window.partitionBy(*key).orderBy(*arrival)
    fresh = batch.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1).drop("_rank")
    return fresh if target is None else fresh.join(target.select(*key), list(key), "left_anti")


# ---- helpers of the sample series ---------------------------------------------------------

def time_grid(bounds: DataFrame, step: str) -> DataFrame:
    """(symbol, ts): regular times from ``start_ts`` to ``end_ts`` of each row, both ends possible."""
    times = F.sequence("start_ts", "end_ts", F.expr(f"INTERVAL {step}"))
    return bounds.select("symbol", F.explode(times).alias("ts"))


def boost_at_events(series: DataFrame, events: DataFrame, value: str, factor: float | Column) -> DataFrame:
    """Scale ``value`` by ``factor`` on the rows whose (symbol, ts) is an event."""
    factor = factor if isinstance(factor, Column) else F.lit(factor)
    marked = events.select("symbol", "ts", F.lit(True).alias("_hit"))
    joined = series.join(marked, ["symbol", "ts"], "left")
    return joined.withColumn(value, F.when(F.col("_hit"), F.col(value) * factor).otherwise(F.col(value))).drop("_hit")
