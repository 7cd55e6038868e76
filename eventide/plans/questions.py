"""The analytical questions, each one function of (views, parameters) to a DataFrame.

``views`` is either :class:`eventide.plans.market.LiveViews` (computed from the base tables) or
:class:`eventide.plans.store.StoredViews` (read from stored tables); the question is the same.
Building a question starts no Spark job; results are ordered the way a reader would expect them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventide.functions.times import TimeLike, clip, in_range
from eventide.operators import event_metrics as metrics, ranking


def _mean_drift(markouts: DataFrame, *keys: str) -> DataFrame:
    """Mean of the 60-minute drift per class; events whose drift is NULL count but do not weigh in."""
    return markouts.groupBy(*keys).agg(
        F.avg("markout_60m").alias("avg_markout_60m"), F.count(F.lit(1)).alias("n_events")
    )


def event_car(views, start: TimeLike, end: TimeLike, symbol: str | None = None) -> DataFrame:
    """Q1: lowest and highest point of the cumulative return path of each event."""
    path = views.event_car(start, end, symbol)
    return (
        path.groupBy("symbol", "event_ts")
        .agg(F.min("car").alias("min_car"), F.max("car").alias("max_car"))
        .orderBy("event_ts", "symbol")
    )


def event_car_late_filter(views, start: TimeLike, end: TimeLike, symbol: str) -> DataFrame:
    """Q1 with the filter written last.

    The filter names the columns the path is partitioned by, so Catalyst moves it below the window
    by itself.
    """
    path = views.event_car().filter((F.col("symbol") == symbol) & in_range("event_ts", start, end))
    return (
        path.groupBy("symbol", "event_ts")
        .agg(F.min("car").alias("min_car"), F.max("car").alias("max_car"))
        .orderBy("event_ts")
    )


def funding_deciles(views, start: TimeLike, end: TimeLike, scope: str = "all") -> DataFrame:
    """Q2: mean drift by the daily decile of the funding rate."""
    deciles = views.funding_deciles(start, end, scope).select("symbol", F.col("ts").alias("event_ts"), "rate_decile")
    return _mean_drift(views.markouts_of(deciles, start, end), "rate_decile").orderBy("rate_decile")


def regime_events(views, start: TimeLike, end: TimeLike, closed: bool = False, scope: str = "all") -> DataFrame:
    """(symbol, event_ts): |rate| above its daily 90th percentile and open interest above its trailing one."""
    prints = views.funding(start, end).withColumn("d", F.to_date("ts"))
    stats = views.daily_rate_stats(start, end, scope).select("symbol", "d", "p90_abs_rate")
    extreme = prints.join(stats, ["symbol", "d"]).filter(F.abs("rate") > F.col("p90_abs_rate"))
    levels = views.rolling_oi_at(extreme.select("symbol", "ts"), start, end, closed)
    return levels.filter(F.col("oi") > F.col("p90_oi_14d")).select("symbol", F.col("ts").alias("event_ts"))


def extreme_regimes(
    views,
    start: TimeLike,
    end: TimeLike,
    min_events: int = 5,
    top_k: int = 10,
    closed: bool = False,
    scope: str = "all",
) -> DataFrame:
    """Q3: symbols by mean drift after extreme events."""
    events = regime_events(views, start, end, closed, scope)
    by_symbol = _mean_drift(views.markouts_of(events, start, end), "symbol")
    return (
        by_symbol.filter(F.col("n_events") >= min_events)
        .orderBy(F.desc_nulls_first("avg_markout_60m"), "symbol")
        .limit(top_k)
    )


def median_daily_vol(views, start: TimeLike | None, end: TimeLike | None) -> DataFrame:
    """One row: the median of rv_1d over the events of the range."""
    levels = views.daily_vol(start, end)
    return ranking.exact_percentile(levels, "rv_1d", 0.5, (), "med_rv")


def low_vol_safe_symbols(views, start: TimeLike, end: TimeLike, median_scope: str = "filtered") -> DataFrame:
    """Q4: symbols with at least one event that is not "low volatility followed by a fall".

    An event is ruled out only if its rv_1d is below the median *and* some single return within
    30 minutes after it is negative; any other event, NULL volatility included, lets its symbol pass.
    ``median_scope``: the median over the ``filtered`` events, or over ``all``.
    """
    first, last = (None, None) if median_scope == "all" else (start, end)
    events = ranking.with_percentile(views.fall_risk(first, last), "rv_1d", 0.5, "med_rv")
    ruled_out = F.coalesce(F.col("rv_1d") < F.col("med_rv"), F.lit(False)) & (F.col("n_falls") > 0)
    safe = events.filter(in_range("event_ts", start, end) & ~ruled_out)
    return safe.select("symbol").distinct().orderBy("symbol")


def hourly_markouts(views, start: TimeLike, end: TimeLike) -> DataFrame:
    """Q5: mean drift by hour of day."""
    markouts = views.event_markouts(start, end)
    hour = F.hour("event_ts").cast("bigint")
    return _mean_drift(markouts.withColumn("funding_hour", hour), "funding_hour").orderBy("funding_hour")


def vol_regime_markouts(views, start: TimeLike, end: TimeLike, scope: str = "all") -> DataFrame:
    """Q6: mean drift by tercile of the volatility in the hour before the event."""
    return _mean_drift(views.vol_regime_events(start, end, scope), "vol_regime").orderBy("vol_regime")


def symbol_overview(views, start: TimeLike, end: TimeLike) -> DataFrame:
    """Q7 from daily statistics: the volume is a mean of daily means."""
    daily = clip(views.symbol_daily_stats(), "d", start, end)
    return (
        daily.groupBy("symbol")
        .agg(
            F.sum("n_klines").alias("n_klines"),
            F.sum("n_funding_events").alias("n_funding_events"),
            F.avg("avg_volume").alias("avg_kline_volume"),
        )
        .orderBy("symbol")
    )


def symbol_overview_raw(market, start: TimeLike, end: TimeLike) -> DataFrame:
    """Q7 from the base tables: bars of the range, but every funding print of the symbol.

    Both sides are aggregated to one row per symbol before they meet; the bars-times-prints product
    a plain join would build never exists. Keys are unique, so rows are what distinct times would be.
    """
    bars = (
        clip(market.klines, "open_time", start, end)
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("n_klines"), F.avg("volume").alias("avg_kline_volume"))
    )
    prints = market.funding.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_funding_events"))
    overview = market.symbols.select("symbol").join(bars, "symbol").join(prints, "symbol", "left")
    return overview.select(
        "symbol",
        "n_klines",
        F.coalesce("n_funding_events", F.lit(0).cast("bigint")).alias("n_funding_events"),
        "avg_kline_volume",
    ).orderBy("symbol")


def funding_pressure(views, start: TimeLike, end: TimeLike, min_events: int = 10, top_k: int = 10) -> DataFrame:
    """Q8: symbols by mean absolute rate."""
    by_symbol = (
        views.funding(start, end)
        .groupBy("symbol")
        .agg(F.avg(F.abs("rate")).alias("avg_abs_rate"), F.count(F.lit(1)).alias("n_events"))
    )
    return (
        by_symbol.filter(F.col("n_events") >= min_events)
        .orderBy(F.desc_nulls_first("avg_abs_rate"), "symbol")
        .limit(top_k)
    )


def _mean_vol(levels: DataFrame, column: str) -> DataFrame:
    return (
        levels.groupBy("symbol")
        .agg(F.avg(column).alias("avg_rv_30m"), F.count(F.lit(1)).alias("n_events"))
        .orderBy(F.desc_nulls_first("avg_rv_30m"), "symbol")
    )


def post_event_volatility(views, start: TimeLike, end: TimeLike) -> DataFrame:
    """Q9: mean volatility of the 30 minutes from the event on."""
    levels = metrics.volatility(
        views.events(start, end), views.returns(start, end, metrics.AFTER_30M), metrics.AFTER_30M, "rv_30m"
    )
    return _mean_vol(levels, "rv_30m")


def pre_event_volatility(views, start: TimeLike, end: TimeLike) -> DataFrame:
    """Q9 as served: mean volatility of the hour *before* the event, under the same column name."""
    return _mean_vol(views.hourly_vol(start, end), "rv_1h")


def _positive(markouts: DataFrame, column: str, threshold: float) -> DataFrame:
    return (
        markouts.filter(F.col(column) > threshold)
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("n_positive_moves"))
        .orderBy(F.desc("n_positive_moves"), "symbol")
    )


def positive_moves_30m(views, start: TimeLike, end: TimeLike, threshold: float = 0.0) -> DataFrame:
    """Q10: events whose 30-minute drift exceeds the threshold, per symbol."""
    events, returns = views.events(start, end), views.returns(start, end, metrics.FORWARD_30M)
    return _positive(metrics.drift(events, returns, metrics.FORWARD_30M, "car_30m"), "car_30m", threshold)


def positive_moves_60m(views, start: TimeLike, end: TimeLike, threshold: float = 0.0) -> DataFrame:
    """Q10 as served: the 60-minute drift."""
    return _positive(views.event_markouts(start, end), "markout_60m", threshold)


def list_symbols(market) -> DataFrame:
    """Q11."""
    return market.symbols.select("symbol").orderBy("symbol")


def row_counts(market) -> DataFrame:
    """Q12: rows per symbol of the four series, one row per (table_name, symbol)."""
    series = {
        "klines": market.klines,
        "funding": market.funding,
        "open_interest": market.open_interest,
        "premium_index": market.premium_index,
    }
    counted = [
        table.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "symbol", "n_rows")
        for name, table in series.items()
    ]
    result = counted[0]
    for other in counted[1:]:
        result = result.unionByName(other)
    return result
