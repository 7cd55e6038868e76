import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import at, minutes, rows

from eventide.operators.trailing import trailing_percentile, trailing_percentile_at


def series(spark, seed, step, n):
    draw = random.Random(seed)
    data = []
    for symbol in ("A", "B"):
        for i in range(n):
            if draw.random() < 0.8:
                data.append((symbol, minutes("2023-12-20", i * step)[0], round(draw.uniform(0, 50), 1)))
    return data, spark.createDataFrame(data, "symbol string, ts timestamp_ntz, oi double")


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("reach", [timedelta(days=14), timedelta(hours=12)])
def test_equals_brute_force(spark, closed, reach):
    data, df = series(spark, 3, 240, 260)
    found = rows(trailing_percentile(df, "oi", 0.9, reach, closed), "symbol", "ts")
    assert len(found) == len(data)
    for symbol, ts, value, got in found:
        inside = [v for s, t, v in data if s == symbol and (t >= ts - reach if closed else t > ts - reach) and t <= ts]
        assert got == pytest.approx(np.quantile(inside, 0.9), abs=1e-9)


def test_bounds_do_not_change_values(spark):
    _, df = series(spark, 4, 240, 260)
    start, end = at("2024-01-09 11:30:00"), at("2024-01-20 03:00:00")
    whole = [r for r in rows(trailing_percentile(df, "oi", 0.9), "symbol", "ts") if start <= r[1] <= end]
    assert rows(trailing_percentile(df, "oi", 0.9, start=start, end=end), "symbol", "ts") == whole


def test_row_exactly_one_reach_ago(spark):
    times = [at("2024-01-01"), at("2024-01-15")]
    df = spark.createDataFrame([("A", t, v) for t, v in zip(times, (100.0, 1.0))], "symbol string, ts timestamp_ntz, oi double")
    assert [r[3] for r in rows(trailing_percentile(df, "oi", 0.5), "ts")] == [100.0, 1.0]
    assert [r[3] for r in rows(trailing_percentile(df, "oi", 0.5, closed=True), "ts")] == [100.0, 50.5]


def test_equal_values_are_never_above_their_percentile(spark):
    data = [("A", minutes("2024-01-01", 60 * i)[0], 0.1 + 0.2) for i in range(500)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, oi double")
    assert all(r[2] == r[3] for r in rows(trailing_percentile(df, "oi", 0.9)))


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("reach", [timedelta(days=14), timedelta(hours=12)])
def test_chosen_times_equal_sliding_along_all(spark, closed, reach):
    data, df = series(spark, 8, 240, 260)
    draw = random.Random(1)
    chosen = [r[:2] for r in data if draw.random() < 0.1] + [("A", at("2023-12-20 00:01")), ("C", at("2023-12-20"))]
    times = spark.createDataFrame(chosen, "symbol string, ts timestamp_ntz")
    every = {r[:2]: r for r in rows(trailing_percentile(df, "oi", 0.9, reach, closed))}
    found = rows(trailing_percentile_at(df, times, "oi", 0.9, reach, closed), "symbol", "ts")
    assert [r[:2] for r in found] == sorted(k for k in chosen if k in every)
    for row in found:
        assert row == every[row[:2]]


@pytest.mark.parametrize("share", [0.5, 0.9])
@pytest.mark.parametrize("closed", [False, True])
def test_equals_the_percentile_of_a_range_frame(spark, share, closed):
    """NaN above all, infinities kept, only NULL left out; the same bits as Spark's own aggregate over the frame."""
    draw = random.Random(2)
    special = [None, float("nan"), float("inf"), float("-inf")]
    data = [
        (s, minutes("2024-01-01", 60 * i)[0], draw.choice(special) if draw.random() < 0.3 else draw.uniform(0, 5))
        for s in "AB" for i in range(150)
    ]
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, oi double")
    reach = timedelta(hours=12)
    low = "INTERVAL '12' HOUR" if closed else "INTERVAL '43199.999999' SECOND"
    frame = f"percentile(oi, {share}) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {low} PRECEDING AND CURRENT ROW)"
    wanted = rows(df.selectExpr("symbol", "ts", "oi", f"{frame} AS p"), "symbol", "ts")
    assert list(map(repr, rows(trailing_percentile(df, "oi", share, reach, closed), "symbol", "ts"))) == list(map(repr, wanted))
    chosen = df.filter("minute(ts) = 0 AND hour(ts) % 5 = 0").select("symbol", "ts")
    at_times = rows(trailing_percentile_at(df, chosen, "oi", share, reach, closed), "symbol", "ts")
    assert list(map(repr, at_times)) == [repr(r) for r in wanted if r[1].hour % 5 == 0]
