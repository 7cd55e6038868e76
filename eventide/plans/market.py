"""The domain tables of one study, and the derived frames the questions read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from eventide.functions.times import TimeLike, clip, in_range, shift, whole_days
from eventide.operators import event_metrics as metrics
from eventide.operators.event_windows import Measure, Reach, window_stats
from eventide.operators.returns import log_returns, minute_returns


@dataclass(frozen=True)
class Market:
    symbols: DataFrame
    klines: DataFrame
    funding: DataFrame
    open_interest: DataFrame
    premium_index: DataFrame
    event_markers: DataFrame | None = None
    bar_days: DataFrame | None = None  # (symbol, day, n_bars) of all bars, where klines lie in folders by day

    def between(self, name: str, column: str, start: TimeLike | None, end: TimeLike | None) -> DataFrame:
        """Rows of a base table in a closed time range."""
        return clip(getattr(self, name), column, start, end)

    def minute_returns(self) -> DataFrame:
        return minute_returns(self.klines)


class LiveViews:
    """Derived frames computed from the base tables for the time range asked for.

    The range is applied to the events first, and the bars are then read only as far around it as
    the windows reach.
    """

    def __init__(self, market: Market):
        self.market = market

    def funding(self, start: TimeLike | None = None, end: TimeLike | None = None) -> DataFrame:
        return self.market.between("funding", "ts", start, end).select("symbol", "ts", "rate")

    def events(self, start=None, end=None, symbol: str | None = None) -> DataFrame:
        funding = self.funding(start, end)
        return metrics.as_events(funding if symbol is None else funding.filter(F.col("symbol") == symbol))

    def returns(self, start=None, end=None, reach: Reach = Reach(), symbol: str | None = None) -> DataFrame:
        """Log returns from ``reach.before`` ahead of the range to ``reach.after`` behind it."""
        klines, bar_days = self.market.between("klines", "open_time", None, shift(end, reach.after)), self.market.bar_days
        if symbol is not None:
            klines = klines.filter(F.col("symbol") == symbol)
            bar_days = None if bar_days is None else bar_days.filter(F.col("symbol") == symbol)
        return log_returns(klines, shift(start, -reach.before), shift(end, reach.after), bar_days)

    def stats(self, start, end, measures: list[Measure]) -> DataFrame:
        """One join for all measures: what a question asks about is a range of events, so its windows are met row by row."""
        reach = Reach.hull([m.reach for m in measures])
        return window_stats(self.events(start, end), self.returns(start, end, reach), measures, by_hours=False)

    def event_markouts(self, start=None, end=None) -> DataFrame:
        return self.markouts_of(self.events(start, end), start, end)

    def markouts_of(self, events: DataFrame, start=None, end=None) -> DataFrame:
        """The events that have a return in the hour after, with markout_60m and n_minutes."""
        return metrics.event_markouts(events, self.returns(start, end, metrics.FORWARD_60M))

    def event_car(self, start=None, end=None, symbol: str | None = None) -> DataFrame:
        returns = self.returns(start, end, metrics.CAR_WINDOW, symbol)
        return metrics.event_car_series(self.events(start, end, symbol), returns)

    def event_volatility(self, start=None, end=None, scope: str = "all") -> DataFrame:
        """``scope``: terciles among ``all`` events, then the range; or among the ``filtered`` ones."""
        first, last = (start, end) if scope == "filtered" else (None, None)
        levels = metrics.event_volatility_levels(
            self.events(first, last), self.returns(first, last, metrics.BEFORE_1D)
        )
        tiled = metrics.with_vol_regime(levels)
        return tiled.filter(in_range("event_ts", start, end))

    def vol_regime_events(self, start=None, end=None, scope: str = "all") -> DataFrame:
        """(symbol, event_ts, vol_regime, markout_60m): volatility and drift from one join with the bars."""
        first, last = (start, end) if scope == "filtered" else (None, None)
        stats = self.stats(
            first,
            last,
            [
                Measure("rv_1h", "stddev", metrics.BEFORE_1H),
                Measure("_rows_before", "rows", metrics.BEFORE_1H),
                Measure("markout_60m", "sum", metrics.FORWARD_60M),
                Measure("_rows_after", "rows", metrics.FORWARD_60M),
            ],
        )
        tiled = metrics.with_vol_regime(stats.filter(F.col("_rows_before") > 0))
        kept = tiled.filter(F.col("_rows_after") > 0).filter(in_range("event_ts", start, end))
        return kept.select("symbol", "event_ts", "vol_regime", "markout_60m")

    def hourly_vol(self, start=None, end=None) -> DataFrame:
        """(symbol, event_ts, rv_1h) for events with at least one return in the hour before."""
        return metrics.volatility(
            self.events(start, end), self.returns(start, end, metrics.BEFORE_1H), metrics.BEFORE_1H, "rv_1h"
        )

    def daily_vol(self, start=None, end=None) -> DataFrame:
        """(symbol, event_ts, rv_1d) for events with at least one return in the day before."""
        return metrics.volatility(
            self.events(start, end), self.returns(start, end, metrics.BEFORE_1D), metrics.BEFORE_1D, "rv_1d"
        )

    def funding_deciles(self, start=None, end=None, scope: str = "all") -> DataFrame:
        # A decile depends on its own day only, so whole days stand for the whole table.
        first, last = (start, end) if scope == "filtered" else whole_days(start, end)
        tiled = metrics.daily_deciles(self.funding(first, last))
        return tiled.filter(in_range("ts", start, end))

    def daily_rate_stats(self, start=None, end=None, scope: str = "all") -> DataFrame:
        first, last = (start, end) if scope == "filtered" else whole_days(start, end)
        return metrics.daily_rate_stats(self.funding(first, last))

    def rolling_oi(self, start=None, end=None, closed: bool = False) -> DataFrame:
        return metrics.rolling_oi(self.market.open_interest, closed, start, end)

    def rolling_oi_at(self, times: DataFrame, start=None, end=None, closed: bool = False) -> DataFrame:
        return metrics.rolling_oi_at(self.market.open_interest, times, closed, start, end)

    def symbol_daily_stats(self) -> DataFrame:
        return metrics.symbol_daily_stats(self.market.klines, self.market.funding)

    def fall_risk(self, start=None, end=None) -> DataFrame:
        """(symbol, event_ts, rv_1d, n_falls): volatility of the day before, negative returns in the half
        hour after, for events with at least one return in the day before."""
        stats = self.stats(
            start,
            end,
            [
                Measure("rv_1d", "stddev", metrics.BEFORE_1D),
                Measure("_rows_before", "rows", metrics.BEFORE_1D),
                Measure("n_falls", "negatives", metrics.FORWARD_30M),
            ],
        )
        return stats.filter(F.col("_rows_before") > 0).select("symbol", "event_ts", "rv_1d", "n_falls")
