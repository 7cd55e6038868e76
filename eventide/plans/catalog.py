"""Named views, so that the questions can also be asked in SQL through ``spark.sql``.

Parameters are bound, not pasted: ``spark.sql(text, args={"start": "2024-01-01", ...})`` with
``CAST(:start AS TIMESTAMP_NTZ)`` in the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventide.functions.times import TimeLike, naive_utc
from eventide.plans.market import LiveViews, Market
from eventide.plans.store import StoredViews


def views_of(market: Market, views: LiveViews | StoredViews | None = None) -> dict[str, DataFrame]:
    """Every base and derived table by its SQL name; ``views`` decides whether derived ones are
    computed or read from the store."""
    views = views or LiveViews(market)
    stored = isinstance(views, StoredViews)
    named = {
        "symbols": market.symbols,
        "klines": market.klines,
        "funding": market.funding,
        "open_interest": market.open_interest,
        "premium_index": market.premium_index,
        "minute_returns": views.store.read("minute_returns") if stored else market.minute_returns(),
        "mv_event_markouts": views.event_markouts(),
        "mv_event_car": views.event_car(),
        "mv_funding_deciles": views.funding_deciles(),
        "mv_event_volatility": views.event_volatility().withColumnRenamed("event_ts", "ts"),
        "mv_rolling_oi_stats": views.rolling_oi(),
        "mv_daily_rate_stats": views.daily_rate_stats(),
        "mv_symbol_daily_stats": views.symbol_daily_stats(),
    }
    if market.event_markers is not None:
        named["events"] = market.event_markers
    return {name: frame.drop("day") for name, frame in named.items()}


def register_views(market: Market, views: LiveViews | StoredViews | None = None, prefix: str = "") -> list[str]:
    """Create (or replace) a temporary view per table and return their names."""
    named = views_of(market, views)
    for name, frame in named.items():
        frame.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in named]


def time_arguments(**times: TimeLike) -> dict[str, str]:
    """Arguments for ``spark.sql``: zone-free UTC text of each time."""
    return {name: naive_utc(value).isoformat(sep=" ") for name, value in times.items()}
