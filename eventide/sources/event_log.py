"""Domain tables derived from a raw event log (event_type, ts, value).

Each event type plays a symbol and each value a trade. Minute bars, 8-hourly rates, hourly open
interest and premium follow by grouping; all of it is lazy.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventide.functions.parsing import base_asset, quote_asset
from eventide.functions.times import TimeLike, clip, floor_time, shift
from eventide.plans.market import Market


def _bars(log: DataFrame, width: str, value) -> DataFrame:
    return log.groupBy(F.col("event_type").alias("symbol"), floor_time("ts", width).alias("ts")).agg(
        F.min_by(value, "ts").alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, "ts").alias("close"),
        F.sum(value).alias("volume"),
        F.count(F.lit(1)).cast("int").alias("trades"),
    )


# Widths of the buckets each table is grouped by.
WIDTHS = {"klines": timedelta(minutes=1), "funding": timedelta(hours=8), "open_interest": timedelta(hours=1)}


@dataclass(frozen=True)
class LogMarket(Market):
    """Tables derived from a log. A time range is put on the log itself, where the scan can use it: a test on
    a bucket's start does not get below the grouping."""

    log: DataFrame | None = None
    derived: dict | None = None  # the tables as they were built, to notice one that was replaced

    def between(self, name: str, column: str, start: TimeLike | None, end: TimeLike | None) -> DataFrame:
        if name not in WIDTHS or getattr(self, name) is not self.derived[name]:
            return super().between(name, column, start, end)
        # Every row of a bucket lies between its start and its end.
        part = clip(self.log, "ts", start, shift(end, WIDTHS[name]))
        return clip(_tables(part)[name], column, start, end)


def market_from_log(log: DataFrame, **options) -> LogMarket:
    tables = _tables(log)
    return LogMarket(**tables, log=log, derived=tables, **options)


def _tables(log: DataFrame) -> dict[str, DataFrame]:
    value = F.col("value")
    symbol = F.col("symbol")
    # A price must be positive for its logarithm to exist.
    minute = _bars(log.filter(value > 0), "1 minute", value)
    hourly = _bars(log, "1 hour", (value - 50) / 1000)
    by_type = F.col("event_type").alias("symbol")
    return dict(
        symbols=log.select(by_type).distinct().select(
            "symbol", base_asset(symbol).alias("base_asset"), quote_asset(symbol).alias("quote_asset")
        ),
        klines=minute.select(
            "symbol",
            F.col("ts").alias("open_time"),
            F.col("open").alias("open_price"),
            F.col("high").alias("high_price"),
            F.col("low").alias("low_price"),
            F.col("close").alias("close_price"),
            "volume",
            F.col("trades").alias("number_of_trades"),
        ),
        funding=log.groupBy(by_type, floor_time("ts", "8 hours").alias("ts")).agg(
            ((F.avg(value) - 50) / 100_000).alias("rate")
        ),
        open_interest=log.groupBy(by_type, floor_time("ts", "1 hour").alias("ts")).agg(
            (F.sum(value) * 100).alias("oi")
        ),
        premium_index=hourly.select(
            "symbol",
            "ts",
            F.col("open").alias("open_val"),
            F.col("high").alias("high_val"),
            F.col("low").alias("low_val"),
            F.col("close").alias("close_val"),
        ),
        event_markers=log.groupBy(by_type, floor_time("ts", "8 hours").alias("event_ts")).agg(
            F.lit("funding").alias("kind")
        ),
    )


def load_market(spark: SparkSession, folder: str, **options) -> LogMarket:
    return market_from_log(spark.read.parquet(f"{folder}/events.parquet"), **options)
