import random
import zipfile
from dataclasses import replace
from datetime import timedelta
from functools import reduce

import pytest
from conftest import at, minutes, rows
from pyspark.sql import functions as F

from eventide import schemas
from eventide.plans import questions, store as store_module
from eventide.plans.catalog import register_views, time_arguments
from eventide.plans.loading import load_files
from eventide.plans.market import LiveViews
from eventide.plans.store import DERIVED, StoredViews, TableStore, refresh

START, END = "2024-01-01 00:00:00", "2024-01-31 23:59:59"


def sample(days=20, seed=5):
    draw = random.Random(seed)
    closes, funding, oi = [], [], []
    for symbol in ("AAAUSDT", "BBBUSDT"):
        for day in range(days):
            for minute in sorted(draw.sample(range(1440), 200)):
                closes.append((symbol, minutes("2024-01-01", day * 1440 + minute)[0], draw.uniform(50, 60)))
            for hour in (0, 8, 16):
                funding.append((symbol, minutes("2024-01-01", day * 1440 + hour * 60)[0], draw.uniform(-1e-3, 1e-3)))
            for hour in range(0, 24, 4):
                oi.append((symbol, minutes("2024-01-01", day * 1440 + hour * 60)[0], draw.uniform(1, 2)))
    return closes, funding, oi


def close(left, right):
    assert len(left) == len(right)
    for mine, other in zip(left, right):
        for a, b in zip(mine, other, strict=True):
            assert a == b or a == pytest.approx(b, abs=1e-12)


@pytest.fixture(scope="module")
def tables():
    return sample()


def test_stored_questions_equal_live_ones(spark, make, tables, tmp_path):
    market = make(*tables)
    store = TableStore(spark, str(tmp_path))
    refresh(store, market)
    live, stored = LiveViews(market), StoredViews(store, market)
    asked = {
        "q1": lambda v: questions.event_car(v, START, "2024-01-12"),
        "q1 symbol": lambda v: questions.event_car(v, START, "2024-01-12", "BBBUSDT"),
        "q2": lambda v: questions.funding_deciles(v, "2024-01-03 08:00:00", "2024-01-12"),
        "q3": lambda v: questions.extreme_regimes(v, START, END, min_events=1),
        "q3 closed": lambda v: questions.extreme_regimes(v, START, END, min_events=1, closed=True, scope="filtered"),
        "q4": lambda v: questions.low_vol_safe_symbols(v, START, END),
        "q5": lambda v: questions.hourly_markouts(v, START, "2024-01-15"),
        "q6": lambda v: questions.vol_regime_markouts(v, "2024-01-05", END),
        "q6 filtered": lambda v: questions.vol_regime_markouts(v, "2024-01-05", END, scope="filtered"),
        "q7": lambda v: questions.symbol_overview(v, "2024-01-05", "2024-01-09"),
        "q8": lambda v: questions.funding_pressure(v, START, END),
        "q9": lambda v: questions.post_event_volatility(v, START, END),
        "q9 before": lambda v: questions.pre_event_volatility(v, START, END),
        "q10": lambda v: questions.positive_moves_30m(v, START, END),
        "q10 60m": lambda v: questions.positive_moves_60m(v, START, END, 0.01),
    }
    for name, ask in asked.items():
        found = rows(ask(stored))
        assert found or name == "q4", name
        close(found, rows(ask(live)))


def test_incremental_refresh_equals_a_full_one(spark, make, tables, tmp_path):
    closes, funding, oi = tables
    # CCC is quiet: its windows reach back over many days. DDD ended, EEE begins with the change.
    closes = closes + [("CCCUSDT", minutes("2024-01-01", day * 720)[0], 50 + day % 7) for day in range(40)]
    closes = closes + [("DDDUSDT", at("2024-01-03"), 5.0), ("EEEUSDT", at("2024-01-16"), 5.0)]
    cut = at("2024-01-15")
    before = make([r for r in closes if r[1] < cut], [r for r in funding if r[1] < cut], [r for r in oi if r[1] < cut])
    after = make(closes, funding, oi)
    grown, fresh = TableStore(spark, str(tmp_path / "grown")), TableStore(spark, str(tmp_path / "fresh"))
    refresh(grown, before)
    refresh(grown, after, since="2024-01-15")
    refresh(fresh, after)
    for name in DERIVED:
        keys = fresh.read(name).columns[:3] if name == "event_car" else fresh.read(name).columns[:2]
        close(rows(grown.read(name), *keys), rows(fresh.read(name), *keys))


def test_base_tables_and_inserts(spark, make, tables, tmp_path):
    market = make(*tables)
    store = TableStore(spark, str(tmp_path))
    for name in ("klines", "open_interest", "premium_index"):
        store.write(name, getattr(market, name))
    store.insert_ignore("funding", market.funding, schemas.PRIMARY_KEYS["funding"], [F.col("rate").asc()])
    assert store.read("funding").count() == market.funding.count()
    batch = spark.createDataFrame(
        [("AAAUSDT", at("2024-01-02 08:00"), 9.0, 2), ("AAAUSDT", at("2024-01-02 09:00"), 8.0, 2),
         ("AAAUSDT", at("2024-01-02 09:00"), 7.0, 1)], "symbol string, ts timestamp_ntz, rate double, load int")
    rows_before = store.read("funding").count()
    earliest = store.insert_ignore("funding", batch, schemas.PRIMARY_KEYS["funding"], [F.col("load").asc()])
    assert earliest == "2024-01-02 08:00:00"
    assert store.read("funding").count() == rows_before + 1
    kept = store.read("funding").filter(F.col("rate") > 1).collect()
    assert [(r.ts, r.rate) for r in kept] == [(at("2024-01-02 09:00"), 7.0)]
    store.insert_ignore("funding", batch.limit(0), ["symbol", "ts"], [F.col("load").asc()])
    stored_market = store.market(market.symbols)
    found = rows(questions.hourly_markouts(LiveViews(stored_market), START, END))
    close(found, rows(questions.hourly_markouts(LiveViews(replace(market, funding=stored_market.funding)), START, END)))


def test_ranges_skip_folders(spark, make, tables, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("klines", make(*tables).klines)
    market = replace(make(), klines=store.read("klines"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = LiveViews(market).returns(None, at("2024-01-03") + timedelta(hours=1))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = plan[plan.index("PartitionFilters"):]
    folders, rest = scan.split("PushedFilters", 1)
    assert "day#" in folders and "version#" in folders and "LessThanOrEqual(open_time" in rest.split("ReadSchema")[0]


def test_a_refresh_drops_what_is_gone(spark, make, tables, tmp_path):
    """Days and events that the base tables no longer have are gone from every table, as after a rebuild."""
    closes, funding, oi = tables
    whole = make(closes, funding, oi)
    cut, away = at("2024-01-10"), (at("2024-01-11"), at("2024-01-13"))
    left = [[r for r in t if not away[0] <= r[1] < away[1] and (r[1] < cut or r[0] != "BBBUSDT")] for t in tables]
    after = make(*left)
    grown, fresh = TableStore(spark, str(tmp_path / "grown")), TableStore(spark, str(tmp_path / "fresh"))
    refresh(grown, whole)
    refresh(grown, after, since="2024-01-10")
    refresh(fresh, after)
    for name in DERIVED:
        keys = fresh.read(name).columns[:3] if name == "event_car" else fresh.read(name).columns[:2]
        close(rows(grown.read(name), *keys), rows(fresh.read(name), *keys))
    found = rows(questions.symbol_overview(StoredViews(grown, after), START, END))
    close(found, rows(questions.symbol_overview(LiveViews(after), START, END)))


def test_a_failed_write_changes_nothing(spark, make, tables, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("funding", make(*tables).funding)
    before = rows(store.read("funding"), "symbol", "ts")
    reader = store.read("funding")
    broken = make(*tables).funding.withColumn("rate", F.expr("if(hour(ts) = 16 AND day(ts) = 9, raise_error('lost'), rate)"))
    for since in (None, at("2024-01-05").date()):
        with pytest.raises(Exception, match="lost"):
            store.write("funding", broken, since)
        assert rows(store.read("funding"), "symbol", "ts") == before
    store.write("funding", make(*tables).funding.filter("symbol = 'AAAUSDT'"))
    assert rows(reader, "symbol", "ts") == before  # planned before the write
    assert store.read("funding").select("symbol").distinct().count() == 1
    assert store.vacuum("funding") > 0
    assert store.read("funding").count() == sum(r[0] == "AAAUSDT" for r in before)


def test_sql_over_views_live_and_stored(spark, make, tables, tmp_path):
    market = make(*tables)
    store = TableStore(spark, str(tmp_path))
    refresh(store, market)
    asked = """
        SELECT hour(at) AS h, avg(drift) AS m, count(*) AS n
        FROM (SELECT f.ts AS at, sum(r.r1m) AS drift
              FROM {p}funding f JOIN {p}minute_returns r
                ON r.symbol = f.symbol AND r.ts > f.ts AND r.ts <= f.ts + INTERVAL '60' MINUTE
              WHERE f.ts BETWEEN CAST(:start AS TIMESTAMP_NTZ) AND CAST(:end AS TIMESTAMP_NTZ)
              GROUP BY f.symbol, f.ts)
        GROUP BY h ORDER BY h"""
    expected = rows(questions.hourly_markouts(LiveViews(market), START, "2024-01-09T00:00:00Z"))
    for prefix, views in (("live_", None), ("stored_", StoredViews(store, market))):
        names = register_views(market, views, prefix)
        assert f"{prefix}mv_symbol_daily_stats" in names
        args = time_arguments(start=START, end="2024-01-09T00:00:00Z")
        close(rows(spark.sql(asked.format(p=prefix), args=args)), expected)
        percentile = f"""SELECT symbol, DATE(ts) AS d, PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY ABS(rate)) AS p
                         FROM {prefix}funding GROUP BY symbol, DATE(ts) ORDER BY symbol, d"""
        kept = spark.table(f"{prefix}mv_daily_rate_stats").select("symbol", "d", "p90_abs_rate")
        close(rows(spark.sql(percentile)), rows(kept, "symbol", "d"))


def test_files_to_answers(spark, make, tables, tmp_path):
    closes, funding, oi = tables
    market = make(*tables)
    folder = tmp_path / "klines"
    folder.mkdir()
    for symbol in ("AAAUSDT", "BBBUSDT"):
        lines = ["open_time,o,h,l,c,v,x,q,n,a,b,d"]
        for name, time, price in closes:
            if name == symbol:
                epoch = int((time - at("1970-01-01")).total_seconds() * 1000)
                lines.append(f"{epoch},{price!r},{price!r},{price!r},{price!r},1.0,0,0,1,0,0,0")
        lines += [lines[1].replace(",1.0,", ",9.0,"), "bad"]  # a repeated key, and a bad line
        with zipfile.ZipFile(folder / f"{symbol.lower()}-1m-2024-01.zip", "w") as packed:
            packed.writestr("bars.csv", "\n".join(lines))
    paths = {}
    for name, table, column in (("funding", funding, "rate"), ("open_interest", oi, "oi")):
        paths[name] = str(tmp_path / f"{name}.csv")
        with open(paths[name], "w") as out:
            out.write(f"symbol,ts,{column}\n")
            out.writelines(f"{s},{t},{v!r}\n" for s, t, v in table)
            if name == "funding":
                out.write("ZZZUSDT,2024-01-01 00:00:00,0.1\n")  # a symbol nobody named
    store = TableStore(spark, str(tmp_path / "tables"))
    for attempt in range(2):  # loading again changes nothing
        loaded = load_files(store, ["aaausdt\t", "BBBUSDT"], str(folder), paths)
        assert loaded.since == str(min(r[1] for r in closes + funding + oi))
        assert sorted((r.table_name, r.n_good, r.n_bad) for r in loaded.report.collect()) == [
            ("funding", len(funding), 1),
            ("klines", sum(r[0] == "AAAUSDT" for r in closes) + 1, 1),
            ("klines", sum(r[0] == "BBBUSDT" for r in closes) + 1, 1),
            ("open_interest", len(oi), 0),
        ]
        assert store.read("klines").count() == len(closes)
    store.write("premium_index", market.premium_index)
    loaded = store.market()
    assert rows(loaded.event_markers, "symbol", "event_ts") == sorted((s, t, "funding") for s, t, _ in funding)
    assert rows(loaded.symbols, "symbol") == [("AAAUSDT", "AAA", "USDT"), ("BBBUSDT", "BBB", "USDT")]
    close(rows(questions.extreme_regimes(LiveViews(loaded), START, END, 1)), rows(questions.extreme_regimes(LiveViews(market), START, END, 1)))
    close(rows(questions.symbol_overview_raw(loaded, START, END)), rows(questions.symbol_overview_raw(market, START, END)))


def _loads(make, days):
    """One small batch of bars and prints a day, each with a row of the day before that is there already."""
    closes = [("AAAUSDT", minutes("2024-01-01", 1440 * d + m)[0], 10.0 + d + m) for d in range(days) for m in (0, 7, 1439)]
    funding = [("AAAUSDT", minutes("2024-01-01", 1440 * d)[0], d * 1e-4) for d in range(days)]
    for d in range(days):
        window = lambda rows: [r for r in rows if at("2024-01-01") + timedelta(days=d - 1) < r[1] < at("2024-01-01") + timedelta(days=d + 1)]  # noqa: E731, B023
        yield make(window(closes), window(funding))


def test_daily_loads_keep_few_versions(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_LIVE", 4)
    store, most = TableStore(spark, str(tmp_path)), 0
    markets = list(_loads(make, 14))
    for market in markets:
        for name, time in (("klines", "open_time"), ("funding", "ts")):
            store.insert_ignore(name, getattr(market, name), schemas.PRIMARY_KEYS[name], [F.col(time).asc()])
            most = max(most, len(store._versions(name)), len(store._versions("bar_days")))
    assert most <= 4
    whole = reduce(lambda a, b: a.unionByName(b), [m.klines for m in markets]).distinct()
    assert rows(store.read("klines").select(*whole.columns), "open_time") == rows(whole, "open_time")
    assert store.read("funding").count() == 14
    counted = rows(store.bar_days(), "day")
    assert counted == rows(whole.groupBy("symbol", F.to_date("open_time").alias("day")).agg(F.count("*").alias("n")), "day")
    # Days replaced after the merges, and the folders that no longer count.
    store.write("funding", store.read("funding").filter("ts < TIMESTAMP_NTZ '2024-01-12'").withColumn("rate", F.col("rate") * 2), since=at("2024-01-10").date())
    kept = [r.rate for r in store.read("funding").orderBy("ts").collect()]
    assert kept == pytest.approx([d * 1e-4 * (1 if d < 9 else 2) for d in range(11)])
    store.vacuum("funding")
    assert [r.rate for r in store.read("funding").orderBy("ts").collect()] == kept


def test_a_write_of_bars_that_breaks_off_leaves_no_counts(spark, make, tmp_path, monkeypatch):
    store, (first, second, third) = TableStore(spark, str(tmp_path)), _loads(make, 3)
    load = lambda market: store.insert_ignore("klines", market.klines, schemas.PRIMARY_KEYS["klines"], [F.col("open_time").asc()])
    load(first)
    assert rows(store.bar_days()) == [("AAAUSDT", at("2024-01-01").date(), 3)]
    with monkeypatch.context() as broken:
        broken.setattr(store, "_count_days", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            load(second)
    assert store.bar_days() is None and store.read("klines").count() == 6
    load(third)
    assert [r.n_bars for r in store.bar_days().orderBy("day").collect()] == [3, 3, 3]


def test_live_questions_are_the_same_with_and_without_counts(spark, make, tables, tmp_path):
    """Gaps, a symbol that ended long before, one that begins in the range."""
    closes, funding, oi = tables
    closes = closes + [("CCCUSDT", minutes("2024-01-01", day * 4321)[0], 50 + day % 7) for day in range(6)]
    closes = closes + [("DDDUSDT", at("2024-01-03"), 5.0), ("EEEUSDT", at("2024-01-11 00:05"), 5.0), ("EEEUSDT", at("2024-01-11 00:09"), 6.0)]
    funding = funding + [(s, at("2024-01-11"), 1e-4) for s in ("CCCUSDT", "DDDUSDT", "EEEUSDT")]
    market, store = make(closes, funding, oi), TableStore(spark, str(tmp_path))
    for name in ("klines", "funding", "open_interest", "premium_index"):
        store.write(name, getattr(market, name))
    for first, last in (("2024-01-11", "2024-01-14"), ("2024-01-05 13:00:00", "2024-01-06"), ("2024-01-01", "2024-01-02")):
        counted, whole = (LiveViews(store.market(market.symbols, **o)) for o in ({}, {"bar_days": None}))
        assert counted.market.bar_days is not None
        close(rows(counted.event_markouts(first, last), "symbol", "event_ts"), rows(whole.event_markouts(first, last), "symbol", "event_ts"))
        close(rows(counted.returns(first, last), "symbol", "ts"), rows(LiveViews(market).returns(first, last), "symbol", "ts"))
