import math
import random

import pytest
from conftest import at, minutes, rows
from pyspark.sql import Window, functions as F

from eventide.operators.returns import log_returns, minute_returns


def plain(klines):
    """The textbook per-symbol window."""
    whole = Window.partitionBy("symbol").orderBy("ts")
    bars = klines.select("symbol", F.col("open_time").alias("ts"), "close_price")
    returns = bars.withColumn("r1m", F.log("close_price") - F.log(F.lag("close_price").over(whole)))
    return returns.withColumn("rv_30m", F.stddev_samp("r1m").over(whole.rowsBetween(-30, 0))).drop("close_price")


def random_bars(seed, days, per_day):
    draw = random.Random(seed)
    found = []
    for symbol in ("AAAUSDT", "BBBUSDT", "CCCUSDT"):
        for day in range(days):
            for minute in sorted(draw.sample(range(1440), draw.randint(0, per_day))):
                found.append((symbol, minutes("2024-01-01", day * 1440 + minute)[0], draw.uniform(1, 100)))
    return found


@pytest.mark.parametrize("seed,days,per_day", [(1, 40, 3), (2, 5, 120), (3, 90, 1)])
def test_daily_chunks_equal_the_whole_window(make, seed, days, per_day):
    market = make(random_bars(seed, days, per_day))
    expected = rows(plain(market.klines), "symbol", "ts")
    found = rows(minute_returns(market.klines).drop("day"), "symbol", "ts")
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    for mine, other in zip(found, expected):
        assert (mine[3] is None) == (other[3] is None)
        assert mine[3] is None or mine[3] == pytest.approx(other[3], abs=1e-12)
    light = rows(log_returns(market.klines).drop("day"), "symbol", "ts")
    assert light == [r[:3] for r in expected]


@pytest.mark.parametrize("build", [log_returns, minute_returns])
def test_bounds_do_not_change_values(make, build):
    market = make(random_bars(7, 30, 4))
    start, end = at("2024-01-09 11:30:00"), at("2024-01-20 03:00:00")
    whole = rows(build(market.klines).filter(F.col("ts").between(F.lit("2024-01-09 11:30:00").cast("timestamp_ntz"),
                                                                 F.lit("2024-01-20 03:00:00").cast("timestamp_ntz"))),
                 "symbol", "ts")
    cut = rows(build(market.klines, start, end), "symbol", "ts")
    assert len(cut) > 50
    for mine, other in zip(cut, whole, strict=True):
        assert mine[:3] == other[:3]
        assert mine[3:] == pytest.approx(other[3:], abs=1e-12, nan_ok=True) or mine[3:] == other[3:]


def test_first_bar_is_null_and_a_gap_uses_the_previous_bar(make):
    times = minutes("2024-01-01", 0, 1, 181)
    market = make([("AAAUSDT", t, c) for t, c in zip(times, (100, 110, 99))])
    found = rows(minute_returns(market.klines).drop("day"), "ts")
    assert found[0][2:] == (None, None)
    assert found[1][2] == pytest.approx(math.log(1.1)) and found[1][3] is None
    assert found[2][2] == pytest.approx(math.log(0.9)) and found[2][3] is not None


def test_result_does_not_depend_on_the_session_zone(spark, make):
    market = make(random_bars(5, 6, 30))
    expected = rows(minute_returns(market.klines), "symbol", "ts")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows(minute_returns(market.klines), "symbol", "ts") == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
