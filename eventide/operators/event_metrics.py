"""Per-event measures: drift, cumulative path, volatility, tiles, and daily statistics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from eventide.operators import ranking
from eventide.operators.event_windows import Measure, Reach, window_pairs, window_stats
from eventide.operators.trailing import trailing_percentile, trailing_percentile_at

# The windows of the study.
FORWARD_60M = Reach(after=timedelta(minutes=60), closed_left=False)
FORWARD_30M = Reach(after=timedelta(minutes=30), closed_left=False)
AFTER_30M = Reach(after=timedelta(minutes=30))
BEFORE_1H = Reach(before=timedelta(hours=1))
BEFORE_1D = Reach(before=timedelta(days=1))
CAR_WINDOW = Reach(before=timedelta(minutes=60), after=timedelta(minutes=180))
TERCILES = 3
DECILES = 10
HIGH_SHARE = 0.9


def as_events(funding: DataFrame) -> DataFrame:
    """Funding prints as events: (symbol, event_ts, rate)."""
    return funding.select("symbol", F.col("ts").alias("event_ts"), "rate")


def drift(events: DataFrame, returns: DataFrame, reach: Reach, name: str) -> DataFrame:
    """Summed return after each event and the number of returns summed; NULL if all were NULL."""
    return window_stats(events, returns, [Measure(name, "sum", reach), Measure("n_minutes", "count", reach)])


def event_markouts(events: DataFrame, returns: DataFrame) -> DataFrame:
    """(symbol, event_ts, rate, markout_60m, n_minutes)."""
    return drift(events, returns, FORWARD_60M, "markout_60m")


def volatility(events: DataFrame, returns: DataFrame, reach: Reach, name: str) -> DataFrame:
    """(symbol, event_ts, name): sample deviation of the returns in the window."""
    return window_stats(events.select("symbol", "event_ts"), returns, [Measure(name, "stddev", reach)])


def event_window_returns(events: DataFrame, returns: DataFrame) -> DataFrame:
    """(symbol, event_ts, ts, r1m, post_ret): every return from 60 minutes before to 180 after.

    ``post_ret`` is 0 before the event; the event's own minute counts as after.
    """
    pairs = window_pairs(events.select("symbol", "event_ts"), returns, CAR_WINDOW)
    post = F.when(F.col("ts") >= F.col("event_ts"), F.col("r1m")).otherwise(F.lit(0.0))
    return pairs.select("symbol", "event_ts", "ts", "r1m", post.alias("post_ret"))


def event_car_series(events: DataFrame, returns: DataFrame) -> DataFrame:
    """(symbol, event_ts, ts, car): running sum of the post-event returns of each event."""
    path = Window.partitionBy("symbol", "event_ts").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return event_window_returns(events, returns).select(
        "symbol", "event_ts", "ts", F.sum("post_ret").over(path).alias("car")
    )


def event_volatility_levels(events: DataFrame, returns: DataFrame) -> DataFrame:
    """(symbol, event_ts, rv_1h, rv_1d) for events with at least one return in the hour before.

    The hour lies inside the day, so a left join of the two measures adds no row: one pass does both.
    """
    measures = [
        Measure("rv_1h", "stddev", BEFORE_1H),
        Measure("rv_1d", "stddev", BEFORE_1D),
        Measure("_rows", "rows", BEFORE_1H),
    ]
    stats = window_stats(events.select("symbol", "event_ts"), returns, measures)
    return stats.filter(F.col("_rows") > 0).drop("_rows")


def with_vol_regime(levels: DataFrame) -> DataFrame:
    """Add ``vol_regime``: tercile of rv_1h over all rows, NULL volatility in the highest."""
    return ranking.tile(levels, TERCILES, "rv_1h", ["symbol", "event_ts"], (), "vol_regime")


def daily_deciles(funding: DataFrame) -> DataFrame:
    """(symbol, ts, rate, rate_decile, event_date): decile of the rate among all prints of its day."""
    dated = funding.select("symbol", "ts", "rate", F.to_date("ts").alias("event_date"))
    tiled = ranking.tile(dated, DECILES, "rate", ["symbol", "ts"], ["event_date"], "rate_decile")
    return tiled.select("symbol", "ts", "rate", "rate_decile", "event_date")


def daily_rate_stats(funding: DataFrame) -> DataFrame:
    """(symbol, d, p90_abs_rate, avg_abs_rate, n_events)."""
    sized = funding.select("symbol", F.to_date("ts").alias("d"), F.abs("rate").alias("abs_rate"))
    extra = [F.avg("abs_rate").alias("avg_abs_rate"), F.count(F.lit(1)).alias("n_events")]
    return ranking.exact_percentile(sized, "abs_rate", HIGH_SHARE, ["symbol", "d"], "p90_abs_rate", extra)


def rolling_oi(open_interest: DataFrame, closed: bool = False, start=None, end=None) -> DataFrame:
    """(symbol, ts, oi, p90_oi_14d)."""
    return trailing_percentile(
        open_interest, "oi", HIGH_SHARE, closed=closed, start=start, end=end, name="p90_oi_14d"
    )


def rolling_oi_at(open_interest: DataFrame, times: DataFrame, closed: bool = False, start=None, end=None) -> DataFrame:
    """(symbol, ts, oi, p90_oi_14d) for the snapshots taken at ``times`` (symbol, ts)."""
    return trailing_percentile_at(
        open_interest, times, "oi", HIGH_SHARE, closed=closed, start=start, end=end, name="p90_oi_14d"
    )


def symbol_daily_stats(klines: DataFrame, funding: DataFrame) -> DataFrame:
    """(symbol, d, n_klines, n_funding_events, avg_volume): counts are 0 on the missing side, the mean NULL."""
    bars = klines.groupBy("symbol", F.to_date("open_time").alias("d")).agg(
        F.count(F.lit(1)).alias("n_klines"), F.avg("volume").alias("avg_volume")
    )
    prints = funding.groupBy("symbol", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n_funding_events"))
    joined = bars.join(prints, ["symbol", "d"], "full")
    return joined.select(
        "symbol",
        "d",
        F.coalesce("n_klines", F.lit(0).cast("bigint")).alias("n_klines"),
        F.coalesce("n_funding_events", F.lit(0).cast("bigint")).alias("n_funding_events"),
        "avg_volume",
    )
