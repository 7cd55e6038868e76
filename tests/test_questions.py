import math

import pytest
from conftest import at, minutes, rows

from eventide.plans import questions, summaries
from eventide.plans.market import LiveViews

START, END = "2024-01-01 00:00:00", "2024-01-31 23:59:59"


def path(symbol, start, closes, step=1):
    return [(symbol, t, c) for t, c in zip(minutes(start, *range(0, step * len(closes), step)), closes)]


def test_first_return_null_in_window_counts_as_event_but_not_in_mean(make):
    # The only bar after the event is the symbol's first bar: its return is NULL.
    market = make([("AAAUSDT", at("2024-01-01 08:10"), 10)] + path("BBBUSDT", "2024-01-01 07:59", [10, 11, 12]),
                  [("AAAUSDT", at("2024-01-01 08:00"), 1e-4), ("BBBUSDT", at("2024-01-01 08:00"), 2e-4)])
    found = {r.symbol: r for r in LiveViews(market).event_markouts().collect()}
    assert found["AAAUSDT"].markout_60m is None and found["AAAUSDT"].n_minutes == 0
    assert found["BBBUSDT"].markout_60m == pytest.approx(math.log(12 / 11))
    hours = rows(questions.hourly_markouts(LiveViews(market), START, END))
    assert hours == [(8, pytest.approx(math.log(12 / 11)), 2)]


def test_event_without_returns_is_absent(make):
    market = make(path("AAAUSDT", "2024-01-01 00:00", [10, 11]), [("AAAUSDT", at("2024-01-01 16:00"), 1e-4)])
    assert rows(questions.hourly_markouts(LiveViews(market), START, END)) == []


def test_car_counts_the_event_minute_and_ignores_what_was_before(make):
    market = make(path("AAAUSDT", "2024-01-01 07:58", [10, 20, 10, 5, 40]), [("AAAUSDT", at("2024-01-01 08:00"), 0.0)])
    series = [r.car for r in LiveViews(market).event_car().orderBy("ts").collect()]
    expected = [0, 0, math.log(0.5), math.log(0.25), math.log(2)]
    assert series == pytest.approx(expected)
    found = rows(questions.event_car(LiveViews(market), START, END))
    assert found[0][2:] == (pytest.approx(math.log(0.25)), pytest.approx(math.log(2)))
    summary = summaries.event_car_summary(questions.event_car(LiveViews(market), START, END)).first()
    assert summary.avg_range == pytest.approx(math.log(8)) and summary.n_events == 1


def test_late_filter_gives_the_same_path(make):
    closes = path("AAAUSDT", "2024-01-01 07:58", [10, 20, 10, 5, 40]) + path("BBBUSDT", "2024-01-01 07:58", [1, 2, 3])
    market = make(closes, [(s, at("2024-01-01 08:00"), 0.0) for s in ("AAAUSDT", "BBBUSDT")])
    views = LiveViews(market)
    assert rows(questions.event_car_late_filter(views, START, END, "AAAUSDT")) == rows(
        questions.event_car(views, START, END, "AAAUSDT"))


def test_date_only_end_is_midnight(make):
    events = [("AAAUSDT", at("2024-01-31 00:00"), 0.1), ("AAAUSDT", at("2024-01-31 08:00"), 0.2)]
    views = LiveViews(make([], events))
    assert views.funding("2024-01-01", "2024-01-31").count() == 1
    assert views.funding("2024-01-01", "2024-01-31 23:59:59").count() == 2
    assert views.funding("2024-01-01T00:00:00Z", "2024-01-31T09:00:00+01:00").count() == 2
    bars = make(path("AAAUSDT", "2024-01-31 08:00", [1, 2, 3]), events)
    assert rows(questions.symbol_overview(LiveViews(bars), "2024-01-01", "2024-01-31"))[0][:3] == ("AAAUSDT", 3, 2)
    # A start later than midnight leaves out that whole day of the daily table.
    assert rows(questions.symbol_overview(LiveViews(bars), "2024-01-31 00:00:01", "2024-02-01")) == []


def test_six_events_a_day_fill_six_deciles_and_ties_break_by_key(make):
    events = [(s, at(f"2024-01-01 {h:02d}:00"), 1e-4) for s in ("AAAUSDT", "BBBUSDT") for h in (0, 8, 16)]
    found = rows(LiveViews(make([], events)).funding_deciles().select("symbol", "ts", "rate_decile"), "rate_decile")
    assert [r[2] for r in found] == [1, 2, 3, 4, 5, 6]
    assert [r[:2] for r in found] == sorted(r[:2] for r in found)


def test_unknown_volatility_lies_in_the_highest_tercile(make):
    closes = []
    events = []
    for i, symbol in enumerate(("AAAUSDT", "BBBUSDT")):
        closes += path(symbol, "2024-01-01 07:00", [10 + (j % 2) * (i + 1) for j in range(90)])
        events.append((symbol, at("2024-01-01 08:00"), 0.0))
    closes += path("CCCUSDT", "2024-01-01 08:00", [10, 11, 12])  # one NULL return in the hour before
    events.append(("CCCUSDT", at("2024-01-01 08:00"), 0.0))
    market = make(closes, events)
    found = {r.symbol: (r.rv_1h, r.vol_regime) for r in LiveViews(market).event_volatility().collect()}
    assert found["CCCUSDT"] == (None, 3)
    assert found["AAAUSDT"][1] == 1 and found["BBBUSDT"][1] == 2


def test_scope_of_terciles(make):
    closes, events = [], []
    for day, swing in ((1, 5), (2, 4), (3, 3), (4, 2), (5, 1), (6, 6)):
        closes += path("AAAUSDT", f"2024-01-{day:02d} 07:00", [100 + (j % 2) * swing for j in range(130)])
        events.append(("AAAUSDT", at(f"2024-01-{day:02d} 08:00"), 0.0))
    views = LiveViews(make(closes, events))
    regimes = lambda scope: [r[0] for r in rows(questions.vol_regime_markouts(views, "2024-01-04", END, scope))]
    assert regimes("all") == [1, 3]  # two quiet days and the wildest one
    assert regimes("filtered") == [1, 2, 3]
    split = views.event_volatility().orderBy("event_ts").collect()
    assert [r.vol_regime for r in split] == [3, 2, 2, 1, 1, 3]


def test_daily_maximum_is_extreme_but_equal_values_are_not(make):
    times = [at(f"2024-01-20 {h:02d}:00") for h in (0, 8, 16)]
    funding = [("AAAUSDT", t, r) for t, r in zip(times, (1e-4, -3e-4, 2e-4))] + [("BBBUSDT", t, 1e-4) for t in times]
    oi = [(s, t, v) for s in ("AAAUSDT", "BBBUSDT") for t, v in zip(minutes("2024-01-10", *range(0, 15840, 480)), range(33))]
    closes = path("AAAUSDT", "2024-01-20 08:00", [10, 11, 12]) + path("BBBUSDT", "2024-01-20 08:00", [10, 11, 12])
    views = LiveViews(make(closes, funding, oi))
    assert rows(questions.regime_events(views, START, END)) == [("AAAUSDT", times[1])]
    found = rows(questions.extreme_regimes(views, START, END, min_events=1))
    assert found == [("AAAUSDT", pytest.approx(math.log(1.2)), 1)]
    assert rows(questions.extreme_regimes(views, START, END)) == []  # fewer than five events
    assert [r.signal for r in summaries.regime_signals(questions.extreme_regimes(views, START, END, 1)).collect()] == ["Strong Long"]


def test_one_event_that_is_not_ruled_out_saves_the_symbol(make):
    # AAA: calm and followed by a fall. BBB: wild, so its fall does not matter.
    closes = path("AAAUSDT", "2024-01-01 07:00", [100 + (j % 2) for j in range(90)])
    closes += path("BBBUSDT", "2024-01-01 07:00", [100 + 20 * (j % 2) for j in range(90)])
    events = [(s, at("2024-01-01 08:00"), 0.0) for s in ("AAAUSDT", "BBBUSDT")]
    assert rows(questions.low_vol_safe_symbols(LiveViews(make(closes, events)), START, END)) == [("BBBUSDT",)]
    # Another event of AAA with unknown volatility passes.
    closes += [("AAAUSDT", at("2023-12-30 08:00"), 100)]
    more = make(closes, events + [("AAAUSDT", at("2024-01-09 08:00"), 0.0), ("AAAUSDT", at("2024-01-01 06:59"), 0.0)])
    assert rows(questions.low_vol_safe_symbols(LiveViews(more), "2023-12-01", END)) == [("BBBUSDT",)]
    closes += [("AAAUSDT", at("2024-01-09 07:30"), 100)]
    passed = make(closes, events + [("AAAUSDT", at("2024-01-09 08:00"), 0.0)])
    assert rows(questions.low_vol_safe_symbols(LiveViews(passed), START, END)) == [("AAAUSDT",), ("BBBUSDT",)]


def test_overviews_with_one_side_missing(make):
    closes = path("AAAUSDT", "2024-01-02 00:00", [1, 2, 3]) + path("BBBUSDT", "2024-01-02 00:00", [1, 2])
    funding = [("BBBUSDT", at("2023-12-01 00:00"), 0.1), ("CCCUSDT", at("2024-01-02 00:00"), 0.1)]
    market = make(closes, funding)
    # From base tables: no bars, no symbol; funding of any date counts.
    assert rows(questions.symbol_overview_raw(market, START, END)) == [("AAAUSDT", 3, 0, 1.0), ("BBBUSDT", 2, 1, 1.0)]
    # From daily statistics: a symbol with prints only is present, with no volume.
    daily = rows(questions.symbol_overview(LiveViews(market), START, END))
    assert daily == [("AAAUSDT", 3, 0, 1.0), ("BBBUSDT", 2, 0, 1.0), ("CCCUSDT", 0, 1, None)]
    overview = questions.symbol_overview(LiveViews(market), START, END)
    tiers = {r.symbol: r.data_quality for r in summaries.data_quality_tier(overview).collect()}
    assert tiers == {"AAAUSDT": "partial", "BBBUSDT": "partial", "CCCUSDT": "missing"}
    assert rows(summaries.dashboard_summary(overview)) == [(5, 1, pytest.approx(2 / 3), 2)]


def test_volume_is_a_mean_of_daily_means(make, spark):
    market = make(path("AAAUSDT", "2024-01-01 23:58", [1, 2, 3]))
    from pyspark.sql import functions as F
    from dataclasses import replace
    shaped = replace(market, klines=market.klines.withColumn("volume", F.col("close_price")))
    assert rows(questions.symbol_overview(LiveViews(shaped), START, END))[0][3] == pytest.approx((1.5 + 3) / 2)
    assert rows(questions.symbol_overview_raw(shaped, START, END))[0][3] == pytest.approx(2)


def test_pre_and_post_event_volatility_differ(make):
    closes = path("AAAUSDT", "2024-01-01 07:30", [100 + (j % 2) for j in range(30)] + [100 + 9 * (j % 2) for j in range(60)])
    views = LiveViews(make(closes, [("AAAUSDT", at("2024-01-01 08:00"), 0.0)]))
    before = rows(questions.pre_event_volatility(views, START, END))[0]
    after = rows(questions.post_event_volatility(views, START, END))[0]
    assert before[2] == after[2] == 1 and 0 < before[1] < after[1]


def test_summaries_of_small_results(spark):
    deciles = spark.createDataFrame([(1, -0.002, 4), (5, 0.0004, 3), (10, 0.001, 5)], "rate_decile bigint, avg_markout_60m double, n_events bigint")
    assert rows(summaries.decile_summary(deciles)) == [(12, 0.001, -0.002, pytest.approx(0.003))]
    found = rows(summaries.decile_signals(deciles), "rate_decile")
    assert [(r[1], r[5]) for r in found] == [("Very Low", "Short"), ("Medium", "Neutral"), ("Very High", "Long")]
    assert [r[4] for r in found] == pytest.approx([1, 0.2, 0.5])
    hours = spark.createDataFrame([(0, 0.5, 1), (8, 0.5, 2), (16, None, 3)], "funding_hour bigint, avg_markout_60m double, n_events bigint")
    found = rows(summaries.hourly_extremes(hours), "funding_hour")
    assert [(r[4], r[5], r[6]) for r in found] == [(True, False, 6), (False, False, 6), (False, True, 6)]
    flat = spark.createDataFrame([(1, 0.0, 1), (2, 0.0, 2)], "vol_regime bigint, avg_markout_60m double, n_events bigint")
    found = rows(summaries.vol_regime_signals(flat), "vol_regime")
    assert [(r[1], r[4], r[5], r[6]) for r in found] == [
        ("Low Volatility", None, True, "Neutral"), ("Medium Volatility", None, False, "Neutral")]
    regimes = spark.createDataFrame([("A", 0.002, 5), ("B", 0.0005, 6), ("C", 0.0, 7), ("D", -0.002, 8)], "symbol string, avg_markout_60m double, n_events bigint")
    assert [r[3] for r in rows(summaries.regime_signals(regimes), "symbol")] == ["Strong Long", "Long", "Short", "Strong Short"]
    assert rows(summaries.regime_summary(regimes)) == [(pytest.approx(0.000125), 26, 2, 2)]
    assert rows(summaries.regime_summary(regimes.limit(0))) == [(0.0, 0, 0, 0)]
    board = spark.createDataFrame([(f"S{i:02d}", 100 - i) for i in range(30)], "symbol string, n bigint")
    assert len(rows(summaries.leaderboard(board, "n"))) == 30  # uncut unless asked
    top = rows(summaries.leaderboard(board, "n", rows=20), "place")
    assert len(top) == 20 and top[1] == ("S01", 99, 2, pytest.approx(99.0))


def test_comparison_of_timings(spark):
    from eventide.plans import timing
    measured = spark.createDataFrame([("a", 200.0, 50.0), ("b", 100.0, 100.0)], "query string, slow_ms double, fast_ms double")
    compared = timing.with_speedup(measured)
    assert [r[3:] for r in rows(compared, "query")] == [(75.0, 4.0), (0.0, 1.0)]
    assert rows(timing.comparison_totals(compared)) == [(300.0, 150.0, 37.5)]
    ran = timing.compare(spark, {"q": (lambda: measured, lambda: measured.limit(1))})
    assert ran.count() == 1 and ran.first().slow_ms > 0
