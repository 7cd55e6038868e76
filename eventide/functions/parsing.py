"""Lenient conversions from text: a value that does not convert becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted spellings of numbers and of full dates.
NUMBER_TEXT = r"^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
ISO_DATE_TEXT = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
SLASH_YEAR_FIRST = r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})"
SLASH_YEAR_LAST = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
# A time of day, then Z or a numeric offset at the end.
ZONED_TEXT = r"[0-9]:[0-9]{2}.*([zZ]|[+-][0-9]{2}:?[0-9]{2})$"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_symbol(text: Column | str) -> Column:
    """Upper case without surrounding white space; missing text becomes empty."""
    text = F.col(text) if isinstance(text, str) else text
    return strip(F.upper(F.coalesce(text, F.lit(""))))


def base_asset(symbol: Column) -> Column:
    """All but the last four characters."""
    return F.left(symbol, F.greatest(F.length(symbol) - 4, F.lit(0)))


def quote_asset(symbol: Column) -> Column:
    """The last four characters."""
    return F.right(symbol, F.lit(4))


def to_double(text: Column) -> Column:
    text = strip(text)
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def to_int(text: Column) -> Column:
    return strip(text).try_cast("int")


def to_timestamp(text: Column) -> Column:
    """ISO first, then the two slash forms (year first, month first); times with a UTC offset become UTC."""
    text = strip(text)
    text = F.regexp_replace(text, SLASH_YEAR_FIRST, "$1-$2-$3")
    text = F.regexp_replace(text, SLASH_YEAR_LAST, "$3-$1-$2")
    offset = F.regexp_replace(text, "([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    instant = F.timestamp_add("MICROSECOND", F.unix_micros(offset.try_cast("timestamp")), F.expr(EPOCH))
    zoned = F.when(text.rlike(ZONED_TEXT), instant).otherwise(text.try_cast("timestamp_ntz"))
    return F.when(text.rlike(ISO_DATE_TEXT), zoned)


def epoch_millis_to_timestamp(text: Column) -> Column:
    """Epoch milliseconds written as a number (a fraction is allowed) to a zone-free UTC timestamp."""
    micros = F.round(to_double(text) * 1000).try_cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
