"""Daily summaries that merge, and bucketed returns."""

import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import at, minutes, rows
from pyspark.sql import functions as F

from eventide.operators import event_metrics as metrics, mergeable
from eventide.plans.bucketed import attach, read_bucketed, write_bucketed
from eventide.plans.market import LiveViews
from eventide.plans.store import TableStore, refresh, refresh_summaries

BARS = "symbol string, open_time timestamp_ntz"


def test_bitmaps_count_different_times(spark):
    """Repeated bars, both ends of a day, times off the minute grid."""
    draw = random.Random(1)
    times = [at("2024-01-01"), at("2024-01-01 00:01"), at("2024-01-01 23:59"), at("2024-01-01 23:59:59.999999"), at("2024-01-02"), at("2024-01-02 00:00:30")]
    data = [("A", t) for t in times * 3] + [("B", minutes("2024-01-05", draw.randrange(4000))[0]) for _ in range(3000)]
    bars = spark.createDataFrame(data, BARS)
    wanted = rows(bars.groupBy("symbol").agg(F.countDistinct(F.to_date("open_time")), F.countDistinct("open_time")), "symbol")
    maps = mergeable.minute_bitmaps(bars)
    assert rows(mergeable.distinct_counts(maps), "symbol") == wanted
    halves = [mergeable.minute_bitmaps(bars.filter(f"hash(open_time) % 2 {sign} 0")) for sign in ("=", "<>")]
    assert rows(mergeable.distinct_counts(halves[0].unionByName(halves[1]).unionByName(maps)), "symbol") == wanted
    assert rows(mergeable.distinct_counts(maps.limit(0))) == []


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.99, 1.0])
def test_merged_sketches_keep_their_bound(spark, share):
    series = spark.range(60_000).selectExpr("concat('s', id % 2) AS symbol", "timestamp_ntz'2024-01-01' + make_dt_interval(id % 40) AS ts",
                                            "IF(id % 10 = 0, NULL, IF(id % 11 = 0, double('nan'), pow(rand(4), 3))) AS v").cache()
    sketches = mergeable.daily_sketches(series, "v")
    assert sketches.count() == 36  # four days have no value
    for row in mergeable.sketched_percentile(sketches, share, ["symbol"], "p").collect():
        values = np.sort([r.v for r in series.filter((F.col("symbol") == row.symbol) & F.col("v").isNotNull() & ~F.isnan("v")).collect()])
        low, high = np.searchsorted(values, row.p, "left") / len(values), np.searchsorted(values, row.p, "right") / len(values)
        assert row.n == len(values) and max(low - share, share - high) <= 2 * mergeable.rank_error(mergeable.DEFAULT_K)
    series.unpersist()
    assert mergeable.sketched_percentile(sketches.limit(0), share).collect()[0].percentile is None


def _sample(make, days=6):
    draw = random.Random(2)
    closes = [(s, minutes("2024-01-29", m)[0], draw.uniform(5, 6)) for s in ("AAAUSDT", "BBBUSDT") for m in range(0, days * 1440, 7)]
    return make(closes, [(s, minutes("2024-01-29", 480 * k)[0], 1e-4) for s in ("AAAUSDT", "BBBUSDT") for k in range(3 * days)])


def test_summaries_are_refreshed_by_day(spark, make, tmp_path):
    market, store = _sample(make), TableStore(spark, str(tmp_path))
    refresh(store, market)
    refresh_summaries(store, market)
    count = lambda: rows(mergeable.distinct_counts(store.read("bar_minutes")), "symbol")
    assert count() == rows(market.klines.groupBy("symbol").agg(F.countDistinct(F.to_date("open_time")), F.countDistinct("open_time")), "symbol")
    before = count()
    refresh_summaries(store, market, since="2024-02-01")
    assert count() == before
    assert store.read("return_sketches").agg(F.sum("n")).first()[0] == store.read("minute_returns").filter("r1m IS NOT NULL").count()


def test_bucketed_returns_are_not_shuffled(spark, make, tmp_path):
    market, path = _sample(make), str(tmp_path / "bucketed")
    views = LiveViews(market)
    returns = write_bucketed(market.minute_returns(), "bucketed_test", path, buckets=4)
    wanted = rows(metrics.event_markouts(views.events(), market.minute_returns()), "symbol", "event_ts")
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(name, value)
    try:
        found = metrics.event_markouts(views.events(), returns)
        text = found._jdf.queryExecution().executedPlan().toString()
        assert rows(found, "symbol", "event_ts") == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    join = text[text.index("SortMergeJoin") :]
    scan = next(line for line in join.splitlines() if "FileScan parquet" in line and "bucketed_test" in line)
    above = join[: join.index(scan)].splitlines()
    level = lambda line: len(line) - len(line.lstrip(" :+-*"))
    path_up, depth = [], level(scan)
    for line in reversed(above):
        if level(line) < depth:
            path_up.append(line)
            depth = level(line)
    assert "Bucketed: true" in scan and "SortMergeJoin" in path_up[-1] and not any("Exchange" in line for line in path_up), path_up
    spark.sql("DROP TABLE bucketed_test")
    again = attach(spark, "bucketed_again", path, 4)
    assert rows(metrics.event_markouts(views.events(), again), "symbol", "event_ts") == wanted
    some = read_bucketed(spark, "bucketed_again", "2024-02-01", "2024-02-02")
    assert {r.day for r in some.select("day").distinct().collect()} == {(at("2024-02-01") + timedelta(days=k)).date() for k in (0, 1)}
    assert "month" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    spark.sql("DROP TABLE bucketed_again")
