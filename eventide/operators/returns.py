"""Log returns and rolling volatility over bars.

The textbook form is one window per symbol, ordered by time: a handful of tasks, each walking
years of bars. Here the window runs per (symbol, day) instead. Each day is given copies of the
rows just before it (the *lead-in*), so every frame sees exactly the rows it would have seen in
the per-symbol window, gaps in the data included, and the copies are dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventide.functions.times import TimeLike, clip, in_range, naive_utc

# The frame is the current row and the 30 before it. The oldest of these needs one more price.
VOL_PRECEDING = 30

_OLDEST = "0001-01-01"  # the one chunk that holds everything before the range


def _days_needed(bar_days: DataFrame, first: Column, rows: int) -> DataFrame:
    """The days before ``first`` that hold the last ``rows`` bars of any symbol."""
    newer = Window.partitionBy("symbol").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum("n_bars").over(newer), F.lit(0))
    counted = bar_days.filter((F.col("day") < first) & (F.col("n_bars") > 0)).withColumn("_after", after)
    return counted.filter(F.col("_after") < rows).select("day").distinct()


def _reaching_back(series: DataFrame, bar_days: DataFrame, start: TimeLike, rows: int) -> DataFrame:
    """The series from the day of ``start`` on, and of earlier days those that can hold lead-in rows.

    Which days these are is only known when the query runs, so the scan of the older folders is pruned then, by the days
    themselves: at most one short row per calendar day, and so broadcast.
    """
    first = F.lit(naive_utc(start).date().isoformat()).cast("date")
    needed = F.broadcast(_days_needed(bar_days, first, rows))
    older = series.filter(F.col("day") < first).join(needed, "day", "left_semi")
    return series.filter(F.col("day") >= first).unionByName(older.select(*series.columns))


def with_lead_in(
    series: DataFrame, value: str, rows: int, start: TimeLike | None = None, bar_days: DataFrame | None = None
) -> DataFrame:
    """(symbol, day, ts, value, owned): each day's rows plus the last ``rows`` rows before it.

    With ``start``, everything earlier counts as one chunk that only serves as lead-in, so it is
    cut down to its last rows before the shuffle. ``bar_days`` (symbol, day, n_bars), the number of bars a series stored by
    day has, spares it the days that hold none of these rows.
    """
    calendar_day = F.to_date("ts")
    # Stated here, the test reaches both readers of the series; Spark then shares their common part.
    dated = F.expr("symbol IS NOT NULL AND day IS NOT NULL")
    body = clip(series, "ts", start, None).select("symbol", calendar_day.alias("day"), "ts", value).filter(dated)
    if start is None:
        series = body
    else:
        if bar_days is not None and "day" in series.columns:
            series = _reaching_back(series, bar_days, start, rows)
        day = F.when(in_range("ts", start, None), calendar_day).otherwise(F.lit(_OLDEST).cast("date"))
        series = series.select("symbol", day.alias("day"), "ts", value).filter(dated)

    entry = F.struct("ts", value)
    if rows == 1:
        tails = series.groupBy("symbol", "day").agg(
            F.max("ts").alias("ts"), F.max_by(value, "ts").alias(value)
        ).select("symbol", "day", F.array(entry).alias("tail"))
    else:
        # The rank limit is applied per map task before the shuffle, and again after it.
        newest = Window.partitionBy("symbol", "day").orderBy(F.desc("ts"))
        tails = (
            series.withColumn("_rank", F.row_number().over(newest))
            .filter(F.col("_rank") <= rows)
            .groupBy("symbol", "day")
            .agg(F.sort_array(F.collect_list(entry)).alias("tail"))
        )
    # One row per symbol and day, so this per-symbol window is as short as the calendar. Every
    # day present holds at least one row: the `rows` days before are always enough.
    before = Window.partitionBy("symbol").orderBy("day").rowsBetween(-rows, -1)
    lead_in = (
        tails.withColumn("_seen", F.flatten(F.collect_list("tail").over(before)))
        .select("symbol", "day", F.explode(F.slice("_seen", F.greatest(F.size("_seen") - rows, F.lit(0)) + 1, rows)).alias("_e"))
        .select("symbol", "day", "_e.ts", f"_e.{value}", F.lit(False).alias("owned"))
    )
    return body.withColumn("owned", F.lit(True)).unionByName(lead_in.filter(F.col("day") > F.lit(_OLDEST).cast("date")))


def _bars_until(klines: DataFrame, end: TimeLike | None) -> DataFrame:
    # Both measures only look back, so later bars can be cut at the scan.
    bars = clip(klines, "open_time", None, end)
    stored_day = ["day"] if "day" in klines.columns else []
    return bars.select("symbol", F.col("open_time").alias("ts"), F.col("close_price").alias("close"), *stored_day)


def _log_change(by_day) -> Column:
    # A price that is not positive has no logarithm: NULL, as Spark's ln gives.
    return F.log("close") - F.log(F.lag("close").over(by_day))


def log_returns(
    klines: DataFrame, start: TimeLike | None = None, end: TimeLike | None = None, bar_days: DataFrame | None = None
) -> DataFrame:
    """(symbol, day, ts, r1m): log change to the previous bar of the symbol.

    The previous *bar* counts, however long ago; the very first bar has NULL. With bounds, only
    rows of that closed time range are returned, with the same values as without.
    """
    bars = with_lead_in(_bars_until(klines, end), "close", 1, start, bar_days)
    by_day = Window.partitionBy("symbol", "day").orderBy("ts")
    return bars.withColumn("r1m", _log_change(by_day)).filter("owned").select("symbol", "day", "ts", "r1m")


def minute_returns(
    klines: DataFrame, start: TimeLike | None = None, end: TimeLike | None = None, bar_days: DataFrame | None = None
) -> DataFrame:
    """(symbol, day, ts, r1m, rv_30m): log returns and their sample deviation over 31 rows."""
    bars = with_lead_in(_bars_until(klines, end), "close", VOL_PRECEDING + 1, start, bar_days)
    by_day = Window.partitionBy("symbol", "day").orderBy("ts")
    returns = bars.withColumn("r1m", _log_change(by_day))
    # The oldest lead-in row has no price before it here; its NULL lies outside every owned frame,
    # or it is the symbol's first bar and NULL is right.
    rolling = F.stddev_samp("r1m").over(by_day.rowsBetween(-VOL_PRECEDING, 0))
    return returns.withColumn("rv_30m", rolling).filter("owned").select("symbol", "day", "ts", "r1m", "rv_30m")
