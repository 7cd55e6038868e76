"""SQL table functions of a time range.

A view has no parameters, and a range put on ``minute_returns`` from outside stays above its windows: all bars are read. These
functions take the range as arguments and put it where it cuts the scans: on the bars, on as much before them as the
previous bar needs, and on the events.

    register_functions(market, "study_")
    spark.sql("SELECT symbol, avg(markout_60m) FROM study_markouts_between(CAST(:first AS TIMESTAMP_NTZ), "
              "CAST(:last AS TIMESTAMP_NTZ)) GROUP BY symbol", args=catalog.time_arguments(first="2024-01-10", last="2024-01-12"))

A market derived from a log has the range on the log itself; one with bars in folders by day is cut by folder.
"""

from __future__ import annotations

from eventide.plans.market import Market
from eventide.sources.event_log import LogMarket

_RANGE = "(first_ts TIMESTAMP_NTZ, last_ts TIMESTAMP_NTZ)"
_KLINES = (
    "symbol STRING, open_time TIMESTAMP_NTZ, open_price DOUBLE, high_price DOUBLE, low_price DOUBLE, close_price DOUBLE, "
    "volume DOUBLE, number_of_trades INT"
)
_EARLIEST = "TIMESTAMP_NTZ '0001-01-01 00:00:00'"
_MICROSECOND = "INTERVAL '0.000001' SECOND"

# Every row of a bucket lies between the bucket's start and its end, so the range is also put on the log.
_LOG_KLINES = """
    SELECT * FROM (
        SELECT event_type, window(ts, '1 minute').start AS open_time, min_by(value, ts), max(value), min(value), max_by(value, ts), sum(value),
               CAST(count(*) AS INT)
        FROM {p}log WHERE value > 0 AND ts >= first_ts AND ts < last_ts + INTERVAL '1' MINUTE
        GROUP BY event_type, window(ts, '1 minute')
    ) WHERE open_time BETWEEN first_ts AND last_ts"""
_LOG_FUNDING = """
    SELECT * FROM (
        SELECT event_type, window(ts, '8 hours').start AS ts, (avg(value) - 50) / 100000 AS rate
        FROM {p}log WHERE ts >= first_ts AND ts < last_ts + INTERVAL '8' HOUR
        GROUP BY event_type, window(ts, '8 hours')
    ) WHERE ts BETWEEN first_ts AND last_ts"""
_TABLE_KLINES = """
    SELECT symbol, open_time, open_price, high_price, low_price, close_price, volume, number_of_trades
    FROM {p}klines WHERE open_time BETWEEN first_ts AND last_ts{day}"""
_TABLE_FUNDING = "SELECT symbol, ts, rate FROM {p}funding WHERE ts BETWEEN first_ts AND last_ts{day}"
_BY_DAY = " AND day BETWEEN to_date(first_ts) AND to_date(last_ts)"

# Of the bars before the range each symbol's last is enough. Windows run by symbol and day: a day's lead-in is the last
# bar of the day before that has any, and for the first day the one before the range.
_RETURNS = """
    WITH bars AS (
        SELECT symbol, to_date(open_time) AS day, open_time AS ts, close_price AS price FROM {p}klines_between(first_ts, last_ts)
    ), ends AS (
        SELECT symbol, day, max(ts) AS ts, max_by(price, ts) AS price FROM bars GROUP BY symbol, day
        UNION ALL
        SELECT symbol, DATE '0001-01-01', max(open_time), max_by(close_price, open_time)
        FROM {older} GROUP BY symbol
    ), led AS (
        SELECT symbol, day, ts, price, true AS owned FROM bars
        UNION ALL
        SELECT * FROM (SELECT symbol, lead(day) OVER (PARTITION BY symbol ORDER BY day) AS day, ts, price, false FROM ends) WHERE day IS NOT NULL
    )
    SELECT symbol, ts, r1m FROM (
        SELECT symbol, ts, owned, ln(price) - ln(lag(price) OVER (PARTITION BY symbol, day ORDER BY ts)) AS r1m FROM led
    ) WHERE owned"""
# The day of the range's start, and only the earlier days that hold some symbol's last bar before it, known when the query
# runs: a row per symbol.
_OLDER_BY_DAY = """(
            SELECT symbol, open_time, close_price FROM {p}klines WHERE day = to_date(first_ts) AND open_time < first_ts
            UNION ALL
            SELECT /*+ BROADCAST(d) */ k.symbol, k.open_time, k.close_price FROM {p}klines k JOIN (
                SELECT DISTINCT day FROM (
                    SELECT max(day) AS day FROM {p}bar_days WHERE day < to_date(first_ts) AND n_bars > 0 GROUP BY symbol
                )
            ) d ON k.day = d.day WHERE k.day < to_date(first_ts)
        )"""
_SLOT = "to_date({t}) + make_dt_interval(0, hour({t}))"
# Events meet the returns of the hours that their window touches, and there the exact test holds.
_MARKOUTS = """
    WITH slots AS (
        SELECT symbol, ts AS event_ts, rate, explode(sequence({slot_of_ts}, ts + INTERVAL '60' MINUTE, INTERVAL '1' HOUR)) AS slot
        FROM {p}funding_between(first_ts, last_ts)
    ), returns AS (
        SELECT symbol, ts, r1m, {slot_of_ts} AS slot FROM {p}returns_between(first_ts, last_ts + INTERVAL '60' MINUTE)
    )
    SELECT symbol, event_ts, rate, sum(r1m), count(r1m) FROM slots JOIN returns USING (symbol, slot)
    WHERE ts > event_ts AND ts <= event_ts + INTERVAL '60' MINUTE
    GROUP BY symbol, event_ts, rate"""
_CAR = """
    WITH slots AS (
        SELECT symbol, ts AS event_ts, explode(sequence({slot_of_from}, ts + INTERVAL '180' MINUTE, INTERVAL '1' HOUR)) AS slot
        FROM (SELECT *, ts - INTERVAL '60' MINUTE AS begin_ts FROM {p}funding_between(first_ts, last_ts))
    ), returns AS (
        SELECT symbol, ts, r1m, {slot_of_ts} AS slot FROM {p}returns_between(first_ts - INTERVAL '60' MINUTE, last_ts + INTERVAL '180' MINUTE)
    )
    SELECT symbol, event_ts, ts, sum(if(ts >= event_ts, r1m, 0)) OVER (PARTITION BY symbol, event_ts ORDER BY ts ROWS UNBOUNDED PRECEDING)
    FROM slots JOIN returns USING (symbol, slot)
    WHERE ts >= event_ts - INTERVAL '60' MINUTE AND ts <= event_ts + INTERVAL '180' MINUTE"""


def register_functions(market: Market, prefix: str = "") -> list[str]:
    """Create (or replace) the temporary table functions, and the views they read, and return the functions' names."""
    spark = market.klines.sparkSession
    from_log = isinstance(market, LogMarket) and market.log is not None and all(
        getattr(market, name) is market.derived[name] for name in ("klines", "funding")
    )
    if from_log:
        market.log.createOrReplaceTempView(f"{prefix}log")
        klines, funding = _LOG_KLINES, _LOG_FUNDING
    else:
        market.klines.createOrReplaceTempView(f"{prefix}klines")
        market.funding.createOrReplaceTempView(f"{prefix}funding")
        klines = _TABLE_KLINES.replace("{day}", _BY_DAY if "day" in market.klines.columns else "")
        funding = _TABLE_FUNDING.replace("{day}", _BY_DAY if "day" in market.funding.columns else "")
    older = f"{prefix}klines_between({_EARLIEST}, first_ts - {_MICROSECOND})"
    if not from_log and market.bar_days is not None and "day" in market.klines.columns:
        market.bar_days.createOrReplaceTempView(f"{prefix}bar_days")
        older = _OLDER_BY_DAY.format(p=prefix)
    bodies = {
        "klines_between": (_KLINES, klines),
        "funding_between": ("symbol STRING, ts TIMESTAMP_NTZ, rate DOUBLE", funding),
        "returns_between": ("symbol STRING, ts TIMESTAMP_NTZ, r1m DOUBLE", _RETURNS),
        "markouts_between": ("symbol STRING, event_ts TIMESTAMP_NTZ, rate DOUBLE, markout_60m DOUBLE, n_minutes BIGINT", _MARKOUTS),
        "car_between": ("symbol STRING, event_ts TIMESTAMP_NTZ, ts TIMESTAMP_NTZ, car DOUBLE", _CAR),
    }
    names = {"p": prefix, "older": older, "slot_of_ts": _SLOT.format(t="ts"), "slot_of_from": _SLOT.format(t="begin_ts")}
    for name, (columns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{_RANGE} RETURNS TABLE ({columns}) RETURN {body.format(**names)}")
    return [prefix + name for name in bodies]
