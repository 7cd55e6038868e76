"""Declared layouts of the domain tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _layout(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


SYMBOLS = _layout(
    ("symbol", T.StringType(), False),
    ("base_asset", T.StringType(), True),
    ("quote_asset", T.StringType(), True),
)
KLINES = _layout(
    ("symbol", T.StringType(), False),
    ("open_time", T.TimestampNTZType(), False),
    ("open_price", T.DoubleType(), False),
    ("high_price", T.DoubleType(), False),
    ("low_price", T.DoubleType(), False),
    ("close_price", T.DoubleType(), False),
    ("volume", T.DoubleType(), False),
    ("number_of_trades", T.IntegerType(), False),
)
FUNDING = _layout(
    ("symbol", T.StringType(), False),
    ("ts", T.TimestampNTZType(), False),
    ("rate", T.DoubleType(), False),
)
OPEN_INTEREST = _layout(
    ("symbol", T.StringType(), False),
    ("ts", T.TimestampNTZType(), False),
    ("oi", T.DoubleType(), False),
)
PREMIUM_INDEX = _layout(
    ("symbol", T.StringType(), False),
    ("ts", T.TimestampNTZType(), False),
    ("open_val", T.DoubleType(), False),
    ("high_val", T.DoubleType(), False),
    ("low_val", T.DoubleType(), False),
    ("close_val", T.DoubleType(), False),
)
EVENT_MARKERS = _layout(
    ("symbol", T.StringType(), False),
    ("event_ts", T.TimestampNTZType(), False),
    ("kind", T.StringType(), False),
)

# The kinds an event marker may carry.
EVENT_KINDS = ("funding", "pseudo")

PRIMARY_KEYS = {
    "symbols": ["symbol"],
    "klines": ["symbol", "open_time"],
    "funding": ["symbol", "ts"],
    "open_interest": ["symbol", "ts"],
    "premium_index": ["symbol", "ts"],
    "event_markers": ["symbol", "event_ts"],
}

# Derived tables as stored: the column each is dated by, and its layout without the ``day`` folder column.
_KEYED = (("symbol", T.StringType(), True), ("event_ts", T.TimestampNTZType(), True))
_TIMED = (("symbol", T.StringType(), True), ("ts", T.TimestampNTZType(), True))
_DATED = (("symbol", T.StringType(), True), ("d", T.DateType(), True))


def _double(*names: str) -> tuple:
    return tuple((name, T.DoubleType(), True) for name in names)


def _long(*names: str) -> tuple:
    return tuple((name, T.LongType(), True) for name in names)


# ``symbols`` has no time; it lies in one folder.
STORED = {
    "symbols": (None, SYMBOLS),
    "event_markers": ("event_ts", EVENT_MARKERS),
    "klines": ("open_time", KLINES),
    "funding": ("ts", FUNDING),
    "open_interest": ("ts", OPEN_INTEREST),
    "premium_index": ("ts", PREMIUM_INDEX),
    "bar_days": ("d", _layout(*_DATED, *_long("n_bars"))),
    "bar_minutes": ("d", _layout(*_DATED, *_long("off_grid"), ("minutes", T.BinaryType(), True))),
    "return_sketches": ("d", _layout(*_DATED, *_long("n"), ("sketch", T.BinaryType(), True))),
    "minute_returns": ("ts", _layout(*_TIMED, *_double("r1m", "rv_30m"))),
    "event_markouts": ("event_ts", _layout(*_KEYED, *_double("rate", "markout_60m"), *_long("n_minutes"))),
    "event_car": ("event_ts", _layout(*_KEYED, ("ts", T.TimestampNTZType(), True), *_double("car"))),
    "funding_deciles": ("ts", _layout(*_TIMED, *_double("rate"), *_long("rate_decile"), ("event_date", T.DateType(), True))),
    "event_vol_levels": ("event_ts", _layout(*_KEYED, *_double("rv_1h", "rv_1d"))),
    "event_volatility": ("event_ts", _layout(*_KEYED, *_double("rv_1h", "rv_1d"), *_long("vol_regime"))),
    "rolling_oi": ("ts", _layout(*_TIMED, *_double("oi", "p90_oi_14d"))),
    "daily_rate_stats": ("d", _layout(*_DATED, *_double("p90_abs_rate", "avg_abs_rate"), *_long("n_events"))),
    "symbol_daily_stats": ("d", _layout(*_DATED, *_long("n_klines", "n_funding_events"), *_double("avg_volume"))),
}
