"""Daily summaries that merge over days: exact distinct counts as bitmaps, percentiles as sketches.

Neither needs the rows again. A day's distinct bar times are the set bits of one bitmap per symbol: a bar stands at its
minute of the day, and bars off the minute grid have a bitmap per distance from it, so counts stay exact for any times. Bitmaps
of the same day merge by OR, however often a bar was seen, and days add up.

Percentiles over groups that are too large to sort can be asked of KLL sketches instead. They are a choice of the caller
and never stand in for the exact forms: the rank of the answer is off by at most ``rank_error(k)`` of the rows, whatever
their number and however many sketches were merged, in 99 of 100 cases; by twice that all but never.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

DEFAULT_K = 400


def minute_bitmaps(klines: DataFrame) -> DataFrame:
    """(symbol, d, off_grid, minutes): a bit per minute of the day with a bar; off_grid in microseconds after the minute."""
    time = F.col("open_time")
    minute = F.hour(time) * 60 + F.minute(time) + 1  # bit positions count from 1; 0 would share its bit with 1
    off_grid = F.expr("CAST(extract(SECOND FROM open_time) * 1000000 AS BIGINT)")
    placed = klines.select("symbol", F.to_date(time).alias("d"), off_grid.alias("off_grid"), minute.cast("bigint").alias("_minute"))
    return placed.groupBy("symbol", "d", "off_grid").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_minute")).alias("minutes"))


def distinct_counts(bitmaps: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys..., n_days, n_klines): different days and different bar times. Several bitmaps of a day count once."""
    days = bitmaps.groupBy("symbol", "d", "off_grid").agg(F.bitmap_count(F.bitmap_or_agg("minutes")).alias("_n"))
    days = days.groupBy("symbol", "d").agg(F.sum("_n").alias("_n"))
    return days.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.sum("_n").alias("n_klines"))


def rank_error(k: int) -> float:
    """Share of the rows by which a sketch's rank may be off (99 % of cases); a fixed property of this kind of sketch."""
    return 2.296 / k**0.9723


def daily_sketches(series: DataFrame, value: str, k: int = DEFAULT_K) -> DataFrame:
    """(symbol, d, n, sketch) of the values that are numbers, by day of ``ts``."""
    numbers = series.filter(F.col(value).isNotNull() & ~F.isnan(value)).select("symbol", F.to_date("ts").alias("d"), F.col(value).cast("double").alias("_v"))
    return numbers.groupBy("symbol", "d").agg(F.count("_v").alias("n"), F.kll_sketch_agg_double("_v", k).alias("sketch"))


def sketched_percentile(sketches: DataFrame, share: float, keys: Sequence[str] = (), name: str = "percentile") -> DataFrame:
    """(keys..., n, name): approximate percentile over all days of each group, from sketches of equal ``k``."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_sketch"))
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(share)))
    return merged.select(*keys, "n", found.alias(name))
