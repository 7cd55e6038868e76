"""Table functions against the live views, and what their scans read."""

import random
import re

import pytest
from conftest import TESTDATA, at, minutes, rows

from eventide.plans.catalog import time_arguments
from eventide.plans.market import LiveViews
from eventide.plans.store import TableStore
from eventide.plans.table_functions import register_functions
from eventide.sources.event_log import load_market

FIRST, LAST = "2024-01-09 08:00:00", "2024-01-12 00:00:00"


def call(spark, name, first=FIRST, last=LAST):
    return spark.sql(
        f"SELECT * FROM {name}(CAST(:first AS TIMESTAMP_NTZ), CAST(:last AS TIMESTAMP_NTZ))", args=time_arguments(first=first, last=last)
    )


def close(left, right):
    assert len(left) == len(right) > 0
    for mine, other in zip(left, right):
        assert all(a == b or a == pytest.approx(b, abs=1e-12) for a, b in zip(mine, other, strict=True)), (mine, other)


def same_as_live(spark, market, prefix, first=FIRST, last=LAST):
    views = LiveViews(market)
    close(rows(call(spark, f"{prefix}markouts_between", first, last), "symbol", "event_ts"), rows(views.event_markouts(first, last), "symbol", "event_ts"))
    order = ("symbol", "event_ts", "ts")
    close(rows(call(spark, f"{prefix}car_between", first, last), *order), rows(views.event_car(first, last), *order))
    returns = views.returns(first, last).select("symbol", "ts", "r1m")
    close(rows(call(spark, f"{prefix}returns_between", first, last), "symbol", "ts"), rows(returns, "symbol", "ts"))


def sample(make):
    """AAA often, BBB seldom with gaps of days, CCC before the range only, DDD from within it."""
    draw = random.Random(3)
    closes = [("AAAUSDT", minutes("2024-01-06", m)[0], draw.uniform(50, 60)) for m in sorted(draw.sample(range(8 * 1440), 900))]
    closes += [("BBBUSDT", minutes("2024-01-01", 60 * h + 30)[0], 50 + h % 7) for h in (0, 5, 220, 231, 300)]
    closes += [("CCCUSDT", at("2024-01-02"), 5.0), ("DDDUSDT", at("2024-01-10 00:10"), 5.0), ("DDDUSDT", at("2024-01-10 00:20"), 6.0)]
    funding = [(s, minutes("2024-01-01", 480 * k)[0], draw.uniform(-1e-3, 1e-3)) for s in ("AAAUSDT", "BBBUSDT", "DDDUSDT") for k in range(40)]
    return make(closes, funding)


def test_equal_to_live_views(spark, make):
    market = sample(make)
    assert register_functions(market, "small_") == [f"small_{n}_between" for n in ("klines", "funding", "returns", "markouts", "car")]
    same_as_live(spark, market, "small_")
    same_as_live(spark, market, "small_", "2024-01-06 16:00:00", "2024-01-10 00:00:00")


def test_a_range_reaches_the_scan_of_the_log(spark):
    market = load_market(spark, f"{TESTDATA}/sf0.001")
    register_functions(market, "log_")
    same_as_live(spark, market, "log_")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = call(spark, "log_markouts_between")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text)
    ranged = [p for p in pushed if "GreaterThanOrEqual(ts,2024-01-09T08:00)" in p and "LessThan(ts,2024-01-12T" in p]
    assert len(pushed) >= 3 and len(ranged) == len(pushed) - 1  # but one, which looks for the last bars before the range
    assert any("LessThan(ts,2024-01-09T08:00:59.999999)" in p for p in pushed)


def test_a_range_chooses_the_folders_of_stored_bars(spark, make, tmp_path):
    market, store = sample(make), TableStore(spark, str(tmp_path))
    for name in ("klines", "funding", "open_interest", "premium_index"):
        store.write(name, getattr(market, name))
    stored = store.market(market.symbols)
    register_functions(stored, "stored_")
    same_as_live(spark, market, "stored_")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = call(spark, "stored_markouts_between")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    filters = re.findall(r"FileScan[^\n]*close_price[^\n]*PartitionFilters: \[(.*?)\], PushedFilters", text)
    assert len(filters) >= 2 and all("dynamicpruningexpression(day" in f or "= 2024-01-09" in f for f in filters), filters
    assert any("dynamicpruningexpression(day" in f for f in filters)
