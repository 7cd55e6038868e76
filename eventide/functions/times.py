"""Time helpers on zone-free timestamps.

Everything here gives the same answer under any ``spark.sql.session.timeZone``; functions that
would silently convert to a zoned timestamp (``date_trunc``, ``unix_timestamp``) are avoided.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

TimeLike = str | date | datetime
DAY_SECONDS = 86_400


def naive_utc(value: TimeLike) -> datetime:
    """Python-side argument as zone-free UTC; a bare date means its midnight."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if not isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def in_range(column: str, start: TimeLike | None, end: TimeLike | None) -> Column:
    """Closed range test on a named column; an open end (None) does not restrict.

    A DATE column is widened to its midnight first, so a start later than midnight leaves
    that day out.
    """
    tests = [
        f"CAST({column} AS TIMESTAMP_NTZ) {sign} TIMESTAMP_NTZ '{naive_utc(bound).isoformat(sep=' ')}'"
        for sign, bound in ((">=", start), ("<=", end))
        if bound is not None
    ]
    return F.expr(" AND ".join(tests) or "TRUE")


def clip(df: DataFrame, column: str, start: TimeLike | None, end: TimeLike | None) -> DataFrame:
    """Rows in the closed range. A table stored by ``day`` is also restricted by that column, since a
    test on the timestamp alone would not skip any folder."""
    kept = df.filter(in_range(column, start, end))
    if "day" in df.columns and column != "day":
        kept = kept.filter(in_range("day", *whole_days(start, end)))
    return kept


def shift(value: TimeLike | None, delta: timedelta) -> datetime | None:
    return None if value is None else naive_utc(value) + delta


def whole_days(start: TimeLike | None, end: TimeLike | None) -> tuple[datetime | None, datetime | None]:
    """The range widened to all of its first and last day."""
    low = None if start is None else datetime.combine(naive_utc(start).date(), datetime.min.time())
    high = None if end is None else datetime.combine(naive_utc(end).date(), datetime.max.time())
    return low, high


def epoch_seconds(column: str) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp."""
    return F.expr(
        f"unix_date(to_date({column})) * {DAY_SECONDS}L + hour({column}) * 3600 + minute({column}) * 60 + second({column})"
    )


def span(delta: timedelta) -> Column:
    """Interval literal."""
    total = int(delta.total_seconds())
    return F.expr(f"INTERVAL '{total}' SECOND")


def floor_time(column: Column | str, width: str) -> Column:
    """Start of the fixed-width bucket the timestamp lies in, counted from 1970."""
    return F.window(column, width).start
