"""Summaries of the question results: totals, extremes, labels, signals, ranks.

Inputs are question results: 24 hours, ten deciles, three regimes, one row per event or symbol.
A missing value counts as 0 in these summaries, and an empty input gives zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventide.functions import signals


def _zero(column: Column | str) -> Column:
    return F.coalesce(column, F.lit(0.0))


def _count(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("bigint")


def car_ranges(car: DataFrame) -> DataFrame:
    """Per event: the distance between the two extremes."""
    return car.withColumn("car_range", F.col("max_car") - F.col("min_car"))


def event_car_summary(car: DataFrame) -> DataFrame:
    """Means of the two extremes over all events, and their distance."""
    means = car.agg(
        _zero(F.avg(_zero("min_car"))).alias("avg_min_car"),
        _zero(F.avg(_zero("max_car"))).alias("avg_max_car"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return means.withColumn("avg_range", F.col("avg_max_car") - F.col("avg_min_car"))


def decile_summary(deciles: DataFrame) -> DataFrame:
    drift = _zero("avg_markout_60m")
    totals = deciles.agg(
        _count(F.sum("n_events")).alias("total_events"),
        _zero(F.max(drift)).alias("max_markout"),
        _zero(F.min(drift)).alias("min_markout"),
    )
    return totals.withColumn("spread", F.col("max_markout") - F.col("min_markout"))


def _intensity(column: str) -> Column:
    """Share of the largest absolute value; the frame holds one row per class, at most 24."""
    size = F.abs(_zero(column))
    return size / F.nullif(F.max(size).over(Window.partitionBy()), F.lit(0.0))


def decile_signals(deciles: DataFrame) -> DataFrame:
    drift = F.col("avg_markout_60m")
    return deciles.select(
        "rate_decile",
        signals.decile_label(F.col("rate_decile")).alias("decile_label"),
        "avg_markout_60m",
        "n_events",
        _intensity("avg_markout_60m").alias("intensity"),
        signals.three_way(drift, "Long", "Short").alias("signal"),
    )


def hourly_extremes(hours: DataFrame) -> DataFrame:
    """Per hour: intensity, and whether it is the best or the worst one (the earlier hour wins a tie)."""
    drift = _zero("avg_markout_60m")
    whole_day = Window.partitionBy()  # at most 24 rows
    best = F.max_by("funding_hour", F.struct(drift, -F.col("funding_hour"))).over(whole_day)
    worst = F.min_by("funding_hour", F.struct(drift, F.col("funding_hour"))).over(whole_day)
    return hours.select(
        "funding_hour",
        "avg_markout_60m",
        "n_events",
        _intensity("avg_markout_60m").alias("intensity"),
        (F.col("funding_hour") == best).alias("is_best"),
        (F.col("funding_hour") == worst).alias("is_worst"),
        F.sum("n_events").over(whole_day).alias("total_events"),
    )


def vol_regime_signals(regimes: DataFrame) -> DataFrame:
    whole = Window.partitionBy()  # three rows
    best = F.max_by("vol_regime", F.struct(_zero("avg_markout_60m"), -F.col("vol_regime"))).over(whole)
    return regimes.select(
        "vol_regime",
        signals.regime_label(F.col("vol_regime")).alias("regime_label"),
        "avg_markout_60m",
        "n_events",
        _intensity("avg_markout_60m").alias("intensity"),
        (F.col("vol_regime") == best).alias("is_best"),
        signals.three_way(F.col("avg_markout_60m"), "Trade", "Avoid").alias("signal"),
        F.sum("n_events").over(whole).alias("total_events"),
    )


def regime_signals(regimes: DataFrame) -> DataFrame:
    return regimes.withColumn("signal", signals.strength(F.col("avg_markout_60m")))


def regime_summary(regimes: DataFrame) -> DataFrame:
    drift = F.col("avg_markout_60m")
    totals = regimes.agg(
        _zero(F.avg(_zero(drift))).alias("avg_markout"),
        _count(F.sum("n_events")).alias("total_events"),
        F.count_if(drift > 0).alias("n_positive"),
        F.count(F.lit(1)).alias("_rows"),
    )
    return totals.withColumn("n_negative", F.col("_rows") - F.col("n_positive")).drop("_rows")


def dashboard_summary(overview: DataFrame) -> DataFrame:
    return overview.agg(
        _count(F.sum("n_klines")).alias("total_klines"),
        _count(F.sum("n_funding_events")).alias("total_funding_events"),
        _zero(F.avg(_zero("avg_kline_volume"))).alias("avg_volume"),
        F.count_if(F.col("n_klines") > 0).alias("active_symbols"),
    )


def data_quality_tier(overview: DataFrame) -> DataFrame:
    tier = signals.quality_tier(F.col("n_klines"), F.col("n_funding_events"))
    return overview.withColumn("data_quality", tier)


def leaderboard(result: DataFrame, measure: str, rows: int | None = None) -> DataFrame:
    """Symbols by ``measure``, their place, and their size in percent of the leader's; only the first ``rows`` if given."""
    order = [F.desc_nulls_first(measure), F.col("symbol").asc()]
    top = result if rows is None else result.orderBy(*order).limit(rows)
    # One row per symbol.
    place = Window.partitionBy().orderBy(*order)
    leader = F.first(measure).over(place)
    share = F.col(measure) / F.when(leader == 0, F.lit(1)).otherwise(F.coalesce(leader, F.lit(1))) * 100
    return top.withColumn("place", F.row_number().over(place).cast("bigint")).withColumn("pct_of_leader", share)
