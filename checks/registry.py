"""One registered query per operator or question: (spark, folder) -> DataFrame.

Floating-point results are rounded, because the order of summation differs between engines. Means of
values with few decimals are rounded finely enough that they do not fall half-way between two results.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventide.functions import parsing
from eventide.functions.times import epoch_seconds, floor_time, in_range, span
from eventide.operators import event_metrics as metrics, mergeable
from eventide.operators.event_windows import Measure, Reach, window_stats, without_window_rows
from eventide.plans import questions, summaries
from eventide.plans.bucketed import write_bucketed
from eventide.plans.catalog import register_views, time_arguments
from eventide.plans.market import LiveViews, Market
from eventide.plans.store import DERIVED, StoredViews, TableStore, refresh, refresh_summaries
from eventide.plans.table_functions import register_functions
from eventide.schemas import EVENT_KINDS, PRIMARY_KEYS
from eventide.session import input_state, shared_folder, tune, with_scratch
from eventide.sources import ingest, quality
from eventide.sources.event_log import load_market, market_from_log

START, END = "2024-01-01 00:00:00", "2024-01-31 23:59:59"
SHORT_RANGE = ("2024-01-15 00:00:00", "2024-01-15 08:00:00")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def over_market(build: Callable[[Market], DataFrame]):
    """Register a query that needs the domain tables."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(load_market(with_scratch(spark), folder))

    QUERIES[build.__name__] = run
    return build


def over_folder(build: Callable[[SparkSession, str], DataFrame]):
    """Register a query that needs other tables of the folder."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(with_scratch(spark), folder)

    QUERIES[build.__name__] = run
    return build


RATE_DIGITS, MEAN_DIGITS = 14, 9


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- projections, filters, scalar functions -------------------------------------------------

@over_market
def project_rename_filter(market: Market) -> DataFrame:
    bars = market.klines.filter(F.col("symbol") == "click")
    return bars.select("symbol", F.col("open_time").alias("ts"), F.col("close_price").alias("price"))


@over_market
def filter_time_bounds(market: Market) -> DataFrame:
    forms = {
        "timestamp_full_end": in_range("ts", "2024-01-02 00:00:00", "2024-01-30 23:59:59"),
        "timestamp_date_end": in_range("ts", "2024-01-02", "2024-01-30"),
        "timestamp_zoned_end": in_range("ts", "2024-01-02T00:00:00Z", "2024-01-30T23:59:59Z"),
        "date_full_end": in_range("d", "2024-01-02 00:00:00", "2024-01-30 23:59:59"),
        "date_date_end": in_range("d", "2024-01-02", "2024-01-30"),
        "date_late_start": in_range("d", "2024-01-02 08:00:00", "2024-01-30"),
    }
    counts = market.funding.withColumn("d", F.to_date("ts")).agg(*[F.count_if(test).alias(name) for name, test in forms.items()])
    return counts.unpivot([], list(forms), "form", "n_rows")


@over_market
def window_bounds(market: Market) -> DataFrame:
    minutes = lambda n: timedelta(minutes=n)
    forms = {
        "forward_open_closed_60m": metrics.FORWARD_60M,
        "forward_closed_60m": Reach(after=minutes(60)),
        "forward_open_closed_30m": metrics.FORWARD_30M,
        "forward_closed_30m": metrics.AFTER_30M,
        "backward_closed_60m": metrics.BEFORE_1H,
        "backward_open_closed_60m": Reach(before=minutes(60), closed_left=False),
        "backward_closed_1d": metrics.BEFORE_1D,
        "two_sided_60m_180m": metrics.CAR_WINDOW,
    }
    views = LiveViews(market)
    per_event = window_stats(
        views.events(), views.returns(), [Measure(name, "rows", reach) for name, reach in forms.items()]
    )
    totals = per_event.agg(*[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in forms])
    return totals.unpivot([], list(forms), "form", "n_rows")


@over_market
def filter_vs_group_stat(market: Market) -> DataFrame:
    return questions.regime_events(LiveViews(market), START, END)


@over_market
def having_topk(market: Market) -> DataFrame:
    moves = LiveViews(market).returns().groupBy("symbol").agg(
        F.avg(F.abs("r1m")).alias("avg_abs_return"), F.count(F.lit(1)).alias("n_bars")
    )
    top = moves.filter(F.col("n_bars") >= 100).orderBy(F.desc_nulls_first("avg_abs_return"), "symbol").limit(3)
    return rounded(top, 9, "avg_abs_return")


@over_market
def late_filter_car(market: Market) -> DataFrame:
    return rounded(questions.event_car_late_filter(LiveViews(market), START, END, "click"), 9, "min_car", "max_car")


def _damaged_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as text; what happened in certain seconds carries the damage a loader meets."""
    log = spark.read.parquet(f"{folder}/events.parquet")
    number, time = F.col("value").cast("string"), F.col("ts").cast("string")
    second = F.second("ts")
    return log.select(
        "event_id",
        F.when(second == 0, "").when(second == 1, F.concat(F.lit("  "), F.initcap("event_type"), F.lit(" ")))
        .otherwise(F.col("event_type")).alias("symbol"),
        F.when(second == 10, "not a time").when(second == 11, F.translate(time, "-", "/"))
        .when(second == 12, F.concat(time, F.lit("Z"))).otherwise(time).alias("ts"),
        F.when(second == 20, "n/a").when(second == 21, F.concat(F.lit(" "), number, F.lit(" ")))
        .when(second == 22, "1.2.3").when(second == 23, F.concat(number, F.lit("d")))
        .when(second == 24, F.concat(F.lit("-"), number)).otherwise(number).alias("value"),
        F.when(second == 30, "12.0").when(second == 31, " 7 ").when(second == 32, "-3")
        .otherwise(F.col("user_id").cast("string")).alias("trades"),
        F.concat(
            (epoch_seconds("ts") * 1000).cast("string"),
            F.when(second == 40, ".5").when(second == 41, "x").otherwise(""),
        ).alias("epoch_ms"),
    )


def _cleaned_log(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = _damaged_log(spark, folder).select(
        "event_id",
        parsing.clean_symbol("symbol").alias("symbol"),
        parsing.to_timestamp(F.col("ts")).alias("ts"),
        parsing.to_double(F.col("value")).alias("value"),
        parsing.to_int(F.col("trades")).cast("bigint").alias("trades"),
        parsing.epoch_millis_to_timestamp(F.col("epoch_ms")).alias("open_time"),
    )
    complete = (F.col("symbol") != "") & F.col("ts").isNotNull() & F.col("open_time").isNotNull()
    positive = F.coalesce((F.col("value") >= 0) & (F.col("trades") >= 0), F.lit(False))
    return cleaned.withColumn("is_valid", complete & positive)


@over_folder
def clean_cast(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned_log(spark, folder)


@over_folder
def ingest_quality(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.quality_counts(_cleaned_log(spark, folder), "symbol")


@over_market
def kline_line_parse(market: Market) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    lines = market.klines.select(
        "symbol",
        F.lit(1).cast("bigint").alias("line_no"),
        F.concat_ws(
            ",",
            F.when(F.minute("open_time") == 7, "soon").otherwise((epoch_seconds("open_time") * 1000).cast("string")),
            text("open_price"), text("high_price"),
            F.when(F.minute("open_time") == 11, "").otherwise(text("low_price")),
            text("close_price"),
            F.when(F.minute("open_time") == 13, F.concat(F.lit("-"), text("volume"))).otherwise(text("volume")),
            F.lit("0"), F.lit("0"),
            F.when(F.minute("open_time") == 17, "1.0").otherwise(text("number_of_trades")),
            F.lit("0"), F.lit("0"), F.lit("0"),
        ).alias("line"),
    )
    parsed = ingest.parse_kline_lines(lines).drop("line_no")
    return rounded(parsed.withColumn("number_of_trades", F.col("number_of_trades").cast("bigint")), 6, "volume")


@over_folder
def scalar_time_math(spark: SparkSession, folder: str) -> DataFrame:
    log = spark.read.parquet(f"{folder}/events.parquet")
    noon = F.to_date("ts").cast("timestamp_ntz") + span(timedelta(hours=12))
    return log.select(
        "event_id",
        F.round(F.when(F.col("value") > 0, F.log("value")), 9).alias("ln_value"),
        F.round(F.abs(F.col("value") - 50), 6).alias("abs_dev"),
        F.to_date("ts").alias("d"),
        F.hour("ts").cast("bigint").alias("h"),
        (F.col("ts") - span(timedelta(minutes=60))).alias("hour_before"),
        (F.col("ts") + span(timedelta(minutes=180))).alias("hours_after"),
        F.when(F.col("ts") >= noon, F.col("value")).otherwise(F.lit(0.0)).alias("after_noon"),
        F.coalesce(F.nullif("value", F.lit(0.0)), F.lit(-1.0)).alias("value_or_default"),
        F.upper(F.trim("event_type")).alias("name"),
        parsing.base_asset(F.col("event_type")).alias("base_asset"),
        parsing.quote_asset(F.col("event_type")).alias("quote_asset"),
    )


@over_folder
def clamp(spark: SparkSession, folder: str) -> DataFrame:
    log = spark.read.parquet(f"{folder}/events.parquet")
    return log.select("event_id", parsing.clamp(F.col("value"), 10.0, 100.0).alias("clamped"))


@over_market
def time_grid(market: Market) -> DataFrame:
    bounds = market.klines.groupBy("symbol").agg(
        F.min(F.to_date("open_time")).cast("timestamp_ntz").alias("start_ts"), F.max("open_time").alias("end_ts")
    )
    return ingest.time_grid(bounds, "8 hours")


@over_market
def boost_at_events(market: Market) -> DataFrame:
    return rounded(ingest.boost_at_events(market.open_interest, market.funding, "oi", 1.125), 6, "oi")


# ---- ingestion and integrity ----------------------------------------------------------------

@over_folder
def symbol_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.symbol_dimension(_damaged_log(spark, folder).select("symbol"))


@over_folder
def upsert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows become 5-minute snapshots; the target already holds the ones of error events."""
    log = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", F.col("event_type").alias("symbol"), floor_time("ts", "5 minutes").alias("ts"), "value"
    )
    target = log.filter(F.col("symbol") == "error")
    return ingest.insert_ignore(log, target, ["symbol", "ts"], [F.col("event_id").asc()])


@over_market
def csv_round_trip(market: Market) -> DataFrame:
    """Funding prints written as CSV into a fresh folder, read back as text, cleaned and typed."""
    spark = market.funding.sparkSession
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    ingest.write_csv(market.funding, path)
    read = ingest.valid_rows(ingest.load_funding(spark, path)).drop("arrival")
    return rounded(read, RATE_DIGITS, "rate")


@over_market
def csv_open_interest(market: Market) -> DataFrame:
    spark = market.open_interest.sparkSession
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    ingest.write_csv(market.open_interest, path)
    return rounded(ingest.valid_rows(ingest.load_open_interest(spark, path)).drop("arrival"), 6, "oi")


@over_market
def csv_premium(market: Market) -> DataFrame:
    spark = market.premium_index.sparkSession
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    ingest.write_csv(market.premium_index, path)
    read = ingest.valid_rows(ingest.load_premium_index(spark, path)).drop("arrival")
    return rounded(read, 9, "open_val", "high_val", "low_val", "close_val")


@over_market
def archive_round_trip(market: Market) -> DataFrame:
    """Bars written as zip archives, one per symbol and day with a header line and a broken line, and loaded again."""
    spark = market.klines.sparkSession
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    text = lambda c: F.col(c).cast("string")
    lines = market.klines.select(
        "symbol", F.to_date("open_time").cast("string").alias("day"), "open_time",
        F.concat_ws(
            ",", (epoch_seconds("open_time") * 1000).cast("string"), text("open_price"), text("high_price"), text("low_price"),
            text("close_price"), text("volume"), F.lit("0,0"), text("number_of_trades"), F.lit("0,0,0"),
        ).alias("line"),
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        files, root = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        symbol, day = group["symbol"].iloc[0], group["day"].iloc[0]
        content = "\n".join(["open_time,open,high,low,close,volume", *group.sort_values("open_time")["line"], "no bar", ""])
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("bars.csv", content)
        with files.open_output_stream(f"{root}/{symbol}-1m-{day}.zip") as out:
            out.write(packed.getvalue())
        return pd.DataFrame({"n": [len(group)]})

    lines.groupBy("symbol", "day").applyInPandas(pack, "n bigint").agg(F.sum("n")).collect()
    symbols = [r["symbol"] for r in market.symbols.collect()]
    read = ingest.valid_rows(ingest.load_klines(spark, folder, symbols)).drop("path", "line_no")
    return rounded(read.withColumn("number_of_trades", F.col("number_of_trades").cast("bigint")), 6, "volume")


def _given(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


@over_folder
def check_pk(spark: SparkSession, folder: str) -> DataFrame:
    given = _given(spark, folder, "customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events")
    market = load_market(spark, folder)
    return quality.key_report({
        "customer": (given["customer"], ["c_custkey"]),
        "orders": (given["orders"], ["o_orderkey"]),
        "lineitem": (given["lineitem"], ["l_orderkey", "l_linenumber"]),
        "part": (given["part"], ["p_partkey"]),
        "supplier": (given["supplier"], ["s_suppkey"]),
        "nation": (given["nation"], ["n_nationkey"]),
        "region": (given["region"], ["r_regionkey"]),
        "events": (given["events"].withColumn("minute", floor_time("ts", "1 minute")), ["event_type", "minute"]),
        "klines": (market.klines, PRIMARY_KEYS["klines"]),
        "funding": (market.funding, PRIMARY_KEYS["funding"]),
    })


@over_folder
def check_fk(spark: SparkSession, folder: str) -> DataFrame:
    given = _given(spark, folder, "customer", "orders", "lineitem", "part", "supplier", "nation", "region")
    market = load_market(spark, folder)
    traded = market.symbols.filter(F.col("quote_asset") != F.col("symbol"))
    return quality.reference_report({
        "orders.o_custkey": (given["orders"], "o_custkey", given["customer"], "c_custkey"),
        "lineitem.l_orderkey": (given["lineitem"], "l_orderkey", given["orders"], "o_orderkey"),
        "lineitem.l_partkey": (given["lineitem"], "l_partkey", given["part"], "p_partkey"),
        "lineitem.l_suppkey": (given["lineitem"], "l_suppkey", given["supplier"], "s_suppkey"),
        "customer.c_nationkey": (given["customer"], "c_nationkey", given["nation"], "n_nationkey"),
        "supplier.s_nationkey": (given["supplier"], "s_nationkey", given["nation"], "n_nationkey"),
        "nation.n_regionkey": (given["nation"], "n_regionkey", given["region"], "r_regionkey"),
        "part.p_partkey": (given["part"], "p_partkey", given["lineitem"], "l_partkey"),
        "funding.symbol": (market.funding, "symbol", market.symbols, "symbol"),
        "klines.symbol": (market.klines, "symbol", traded, "symbol"),
    })


@over_market
def check_not_null(market: Market) -> DataFrame:
    tables = {
        "klines": (market.klines, market.klines.columns),
        "funding": (market.funding, market.funding.columns),
        "open_interest": (market.open_interest, market.open_interest.columns),
        "minute_returns": (market.minute_returns().drop("day"), ["symbol", "ts", "r1m", "rv_30m"]),
    }
    kinds = quality.outside_domain(market.event_markers, "kind", EVENT_KINDS).agg(
        F.lit("event_markers").alias("table_name"), F.lit("kind").alias("column_name"), F.count(F.lit(1)).alias("n_null")
    )
    return quality.null_report(tables).unionByName(kinds)


@over_market
def row_counts(market: Market) -> DataFrame:
    return questions.row_counts(market)


@over_market
def list_symbols(market: Market) -> DataFrame:
    return questions.list_symbols(market)


# ---- event windows, joins, measures ---------------------------------------------------------

@over_market
def minute_returns(market: Market) -> DataFrame:
    return rounded(market.minute_returns().drop("day"), 9, "r1m", "rv_30m")


@over_market
def event_markout_60m(market: Market) -> DataFrame:
    return rounded(rounded(LiveViews(market).event_markouts(), RATE_DIGITS, "rate"), 9, "markout_60m")


@over_market
def event_markout_30m(market: Market) -> DataFrame:
    views = LiveViews(market)
    drift = metrics.drift(views.events(), views.returns(), metrics.FORWARD_30M, "markout_30m")
    return rounded(rounded(drift, RATE_DIGITS, "rate"), 9, "markout_30m")


@over_market
def event_window_join(market: Market) -> DataFrame:
    views = LiveViews(market)
    return rounded(metrics.event_window_returns(views.events(), views.returns()), 9, "r1m", "post_ret")


@over_market
def event_car_series(market: Market) -> DataFrame:
    return rounded(LiveViews(market).event_car(), 9, "car")


@over_market
def event_vol_1h(market: Market) -> DataFrame:
    return rounded(LiveViews(market).hourly_vol(), 9, "rv_1h")


@over_market
def event_vol_1d(market: Market) -> DataFrame:
    return rounded(LiveViews(market).daily_vol(), 9, "rv_1d")


@over_market
def event_vol_post_30m(market: Market) -> DataFrame:
    views = LiveViews(market)
    return rounded(metrics.volatility(views.events(), views.returns(), metrics.AFTER_30M, "rv_30m"), 9, "rv_30m")


@over_market
def join_left_vol(market: Market) -> DataFrame:
    views = LiveViews(market)
    return rounded(views.hourly_vol().join(views.daily_vol(), ["symbol", "event_ts"], "left"), 9, "rv_1h", "rv_1d")


@over_market
def event_volatility(market: Market) -> DataFrame:
    return rounded(LiveViews(market).event_volatility(), 9, "rv_1h", "rv_1d")


@over_market
def join_equi_event(market: Market) -> DataFrame:
    views = LiveViews(market)
    snapshot = market.open_interest.select("symbol", F.col("ts").alias("event_ts"), "oi")
    joined = views.event_markouts().join(snapshot, ["symbol", "event_ts"])
    return rounded(rounded(joined.select("symbol", "event_ts", "markout_60m", "oi"), 9, "markout_60m"), 6, "oi")


@over_market
def join_equi_day(market: Market) -> DataFrame:
    views = LiveViews(market)
    stats = views.daily_rate_stats().select("symbol", "d", "p90_abs_rate")
    joined = views.funding().withColumn("d", F.to_date("ts")).join(stats, ["symbol", "d"])
    return rounded(joined, RATE_DIGITS, "rate", "p90_abs_rate")


@over_market
def join_anti_window(market: Market) -> DataFrame:
    views = LiveViews(market)
    falls = views.returns().filter(F.col("r1m") < 0)
    return without_window_rows(views.events().select("symbol", "event_ts"), falls, metrics.FORWARD_30M)


@over_market
def join_cross_scalar(market: Market) -> DataFrame:
    views = LiveViews(market)
    median = questions.median_daily_vol(views, START, END)
    joined = views.daily_vol(START, END).crossJoin(F.broadcast(median))
    flagged = joined.withColumn("is_low_vol", F.col("rv_1d") < F.col("med_rv"))
    return rounded(flagged, 9, "rv_1d", "med_rv")


@over_market
def median_rv(market: Market) -> DataFrame:
    return rounded(questions.median_daily_vol(LiveViews(market), START, END), 9, "med_rv")


@over_market
def funding_deciles_daily(market: Market) -> DataFrame:
    return rounded(LiveViews(market).funding_deciles(), RATE_DIGITS, "rate")


@over_market
def daily_rate_stats(market: Market) -> DataFrame:
    return rounded(LiveViews(market).daily_rate_stats(), RATE_DIGITS, "p90_abs_rate", "avg_abs_rate")


@over_market
def rolling_oi_p90(market: Market) -> DataFrame:
    return rounded(LiveViews(market).rolling_oi(), 6, "oi", "p90_oi_14d")


@over_market
def rolling_oi_p90_closed(market: Market) -> DataFrame:
    return rounded(LiveViews(market).rolling_oi(closed=True), 6, "oi", "p90_oi_14d")


@over_market
def symbol_daily_stats(market: Market) -> DataFrame:
    return rounded(LiveViews(market).symbol_daily_stats(), MEAN_DIGITS, "avg_volume")


@over_market
def agg_count_distinct(market: Market) -> DataFrame:
    bars = market.klines
    return bars.groupBy("symbol").agg(
        F.countDistinct(F.to_date("open_time")).alias("n_days"), F.countDistinct("open_time").alias("n_klines")
    )


@over_folder
def stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Refresh every stored table into a fresh folder and report what can be read back."""
    market = load_market(spark, folder)
    store = TableStore(spark, f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}")
    refresh(store, market)
    counted = [
        store.read(name).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("day").alias("n_days"))
        .select(F.lit(name).alias("table_name"), "n_rows", "n_days")
        for name in DERIVED
    ]
    return reduce(DataFrame.unionByName, counted)


STORED_START, STORED_END = "2024-01-03 08:00:00", "2024-01-12"  # cut rows on both sides; the end is a midnight
SINCE = "2024-01-20"
_STORES: dict[tuple, TableStore] = {}


def _store(spark: SparkSession, folder: str, market: Market, since: bool) -> TableStore:
    """All stored tables, refreshed once per state of the folder's log; with ``since``, grown from an earlier state.

    The earlier state lacks the rows from ``SINCE`` on and has others in their place, on days that vanish.
    """
    key = (spark.sparkContext.applicationId, folder, input_state(spark, f"{folder}/events.parquet"), since)
    if key not in _STORES:
        store = TableStore(spark, f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}")
        if since:
            log = spark.read.parquet(f"{folder}/events.parquet")
            later = F.col("ts") >= F.lit(SINCE).cast("timestamp_ntz")
            moved = F.when(later, F.col("ts") + F.expr("INTERVAL '9' DAY")).otherwise(F.col("ts"))
            refresh(store, market_from_log(log.withColumn("ts", moved)))
        refresh(store, market, since=SINCE if since else None)
        _STORES[key] = store
    return _STORES[key]


def over_store(name: str, build: Callable[[StoredViews], DataFrame], since: bool = False) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        market = load_market(with_scratch(spark), folder)
        return build(StoredViews(_store(spark, folder, market, since), market))

    QUERIES[name] = run


STORED_DIGITS = {
    "r1m": 9, "rv_30m": 9, "rate": RATE_DIGITS, "markout_60m": 9, "car": 9, "rv_1h": 9, "rv_1d": 9, "oi": 6, "p90_oi_14d": 6,
    "p90_abs_rate": RATE_DIGITS, "avg_abs_rate": RATE_DIGITS, "avg_volume": MEAN_DIGITS,
}


def _stored_values(views: StoredViews, name: str) -> DataFrame:
    table = views.store.read(name).drop("day")
    return table.withColumns({c: F.round(c, digits) for c, digits in STORED_DIGITS.items() if c in table.columns})


for _name in DERIVED:
    over_store(f"stored_{_name}", lambda v, n=_name: _stored_values(v, n))
    over_store(f"stored_since_{_name}", lambda v, n=_name: _stored_values(v, n), since=True)

over_store("q1_stored", lambda v: rounded(questions.event_car(v, STORED_START, STORED_END), 9, "min_car", "max_car"))
over_store("q2_stored", lambda v: rounded(questions.funding_deciles(v, STORED_START, STORED_END), 9, "avg_markout_60m"))
over_store("q3_stored", lambda v: rounded(questions.extreme_regimes(v, STORED_START, END, min_events=1), 9, "avg_markout_60m"))
over_store("q4_stored", lambda v: questions.low_vol_safe_symbols(v, *SHORT_RANGE))
over_store("q5_stored", lambda v: rounded(questions.hourly_markouts(v, STORED_START, STORED_END), 9, "avg_markout_60m"))
over_store("q6_stored", lambda v: rounded(questions.vol_regime_markouts(v, STORED_START, STORED_END), 9, "avg_markout_60m"))
over_store("q7_stored", lambda v: rounded(questions.symbol_overview(v, STORED_START, STORED_END), MEAN_DIGITS, "avg_kline_volume"))


def _with_summaries(views: StoredViews) -> TableStore:
    if not views.store.exists("return_sketches"):
        refresh_summaries(views.store, views.market)
    return views.store


over_store("stored_count_distinct", lambda v: mergeable.distinct_counts(_with_summaries(v).read("bar_minutes")))


def _sketch_check(views: StoredViews) -> DataFrame:
    """Whether the sketched percentile of each symbol's returns has the rank it should, by counting the returns around it."""
    store, share = _with_summaries(views), 0.9
    found = mergeable.sketched_percentile(store.read("return_sketches"), share, ["symbol"], "p")
    returns = store.read("minute_returns").filter("r1m IS NOT NULL").select("symbol", "r1m")
    ranks = returns.join(found, "symbol").groupBy("symbol", "n").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("r1m") < F.col("p")).alias("below"), F.count_if(F.col("r1m") <= F.col("p")).alias("upto")
    )
    off = F.greatest(F.col("below") / F.col("n_rows") - share, share - F.col("upto") / F.col("n_rows"))
    within = (off <= 2 * mergeable.rank_error(mergeable.DEFAULT_K)) & (F.col("n") == F.col("n_rows"))
    return ranks.select("symbol", "n_rows", within.alias("is_within_bound"))


over_store("sketched_percentile", _sketch_check)


def _markouts_bucketed(views: StoredViews) -> DataFrame:
    """Markouts from a bucketed copy of the stored returns: only the events are shuffled."""
    spark = views.store.spark
    tune(spark)
    name = uuid.uuid4().hex
    returns = write_bucketed(views.store.read("minute_returns"), f"returns_{name}", f"{shared_folder(spark)}/bucketed-{name}", buckets=8)
    return rounded(rounded(metrics.event_markouts(views.events(), returns), RATE_DIGITS, "rate"), 9, "markout_60m")


over_store("markouts_bucketed", _markouts_bucketed)


@over_market
def sql_over_views(market: Market) -> DataFrame:
    """Top volatility and total return by symbol and day, in SQL over the registered views with bound parameters."""
    register_views(market, prefix="study_")
    found = market.funding.sparkSession.sql(
        """
        SELECT r.symbol, to_date(r.ts) AS d, s.n_klines, max(r.rv_30m) AS top_rv, sum(r.r1m) AS day_return
        FROM study_minute_returns r JOIN study_mv_symbol_daily_stats s ON s.symbol = r.symbol AND s.d = to_date(r.ts)
        WHERE r.ts BETWEEN CAST(:start AS TIMESTAMP_NTZ) AND CAST(:end AS TIMESTAMP_NTZ) AND s.n_funding_events > 0
        GROUP BY r.symbol, to_date(r.ts), s.n_klines
        HAVING count(r.r1m) >= :min_rows
        """,
        args={**time_arguments(start=START, end="2024-01-12"), "min_rows": 5},
    )
    return rounded(found, 9, "top_rv", "day_return")


def _by_function(market: Market, function: str) -> DataFrame:
    register_functions(market, "ranged_")
    return market.funding.sparkSession.sql(
        f"SELECT * FROM ranged_{function}(CAST(:first AS TIMESTAMP_NTZ), CAST(:last AS TIMESTAMP_NTZ))",
        args=time_arguments(first=STORED_START, last=STORED_END),
    )


@over_market
def markouts_by_function(market: Market) -> DataFrame:
    """Markouts of a range, in SQL by a table function that takes the range."""
    return rounded(rounded(_by_function(market, "markouts_between"), RATE_DIGITS, "rate"), 9, "markout_60m")


@over_market
def car_by_function(market: Market) -> DataFrame:
    return rounded(_by_function(market, "car_between"), 9, "car")


# ---- questions ------------------------------------------------------------------------------

@over_market
def event_car(market: Market) -> DataFrame:
    return rounded(questions.event_car(LiveViews(market), START, END), 9, "min_car", "max_car")


@over_market
def funding_deciles(market: Market) -> DataFrame:
    return rounded(questions.funding_deciles(LiveViews(market), START, END), 9, "avg_markout_60m")


@over_market
def extreme_regimes(market: Market) -> DataFrame:
    found = questions.extreme_regimes(LiveViews(market), START, END, min_events=1)
    return rounded(found, 9, "avg_markout_60m")


@over_market
def extreme_regimes_closed(market: Market) -> DataFrame:
    found = questions.extreme_regimes(LiveViews(market), START, END, min_events=1, closed=True, scope="filtered")
    return rounded(found, 9, "avg_markout_60m")


@over_market
def low_vol_safe_symbols(market: Market) -> DataFrame:
    return questions.low_vol_safe_symbols(LiveViews(market), START, END)


@over_market
def low_vol_safe_symbols_short(market: Market) -> DataFrame:
    """A range short enough that some symbols have no event that saves them."""
    return questions.low_vol_safe_symbols(LiveViews(market), *SHORT_RANGE)


@over_market
def hourly_markouts(market: Market) -> DataFrame:
    return rounded(questions.hourly_markouts(LiveViews(market), START, END), 9, "avg_markout_60m")


@over_market
def vol_regime_markouts(market: Market) -> DataFrame:
    return rounded(questions.vol_regime_markouts(LiveViews(market), START, END), 9, "avg_markout_60m")


@over_market
def vol_regime_markouts_filtered(market: Market) -> DataFrame:
    # A range that leaves events out: only then do the two scopes differ.
    found = questions.vol_regime_markouts(LiveViews(market), "2024-01-08", END, scope="filtered")
    return rounded(found, 9, "avg_markout_60m")


@over_market
def symbol_overview(market: Market) -> DataFrame:
    return rounded(questions.symbol_overview(LiveViews(market), START, END), MEAN_DIGITS, "avg_kline_volume")


@over_market
def symbol_overview_raw(market: Market) -> DataFrame:
    return rounded(questions.symbol_overview_raw(market, START, END), MEAN_DIGITS, "avg_kline_volume")


@over_market
def funding_pressure(market: Market) -> DataFrame:
    return rounded(questions.funding_pressure(LiveViews(market), START, END), RATE_DIGITS, "avg_abs_rate")


@over_market
def post_event_volatility(market: Market) -> DataFrame:
    return rounded(questions.post_event_volatility(LiveViews(market), START, END), 9, "avg_rv_30m")


@over_market
def pre_event_volatility(market: Market) -> DataFrame:
    return rounded(questions.pre_event_volatility(LiveViews(market), START, END), 9, "avg_rv_30m")


@over_market
def positive_moves_30m(market: Market) -> DataFrame:
    return questions.positive_moves_30m(LiveViews(market), START, END)


@over_market
def positive_moves_60m(market: Market) -> DataFrame:
    return questions.positive_moves_60m(LiveViews(market), START, END, threshold=0.1)


# ---- summaries ------------------------------------------------------------------------------

@over_market
def event_car_ranges(market: Market) -> DataFrame:
    ranges = summaries.car_ranges(questions.event_car(LiveViews(market), START, END))
    return rounded(ranges, 9, "min_car", "max_car", "car_range")


@over_market
def event_car_summary(market: Market) -> DataFrame:
    summary = summaries.event_car_summary(questions.event_car(LiveViews(market), START, END))
    return rounded(summary, 9, "avg_min_car", "avg_max_car", "avg_range")


@over_market
def decile_summary(market: Market) -> DataFrame:
    summary = summaries.decile_summary(questions.funding_deciles(LiveViews(market), START, END))
    return rounded(summary, 9, "max_markout", "min_markout", "spread")


@over_market
def decile_signals(market: Market) -> DataFrame:
    labelled = summaries.decile_signals(questions.funding_deciles(LiveViews(market), START, END))
    return rounded(labelled, 9, "avg_markout_60m", "intensity")


@over_market
def hourly_extremes(market: Market) -> DataFrame:
    marked = summaries.hourly_extremes(questions.hourly_markouts(LiveViews(market), START, END))
    return rounded(marked, 9, "avg_markout_60m", "intensity")


@over_market
def vol_regime_signals(market: Market) -> DataFrame:
    marked = summaries.vol_regime_signals(questions.vol_regime_markouts(LiveViews(market), START, END))
    return rounded(marked, 9, "avg_markout_60m", "intensity")


@over_market
def regime_summary(market: Market) -> DataFrame:
    found = questions.extreme_regimes(LiveViews(market), START, END, min_events=1)
    return rounded(summaries.regime_summary(found), 9, "avg_markout")


@over_market
def regime_signals(market: Market) -> DataFrame:
    found = questions.extreme_regimes(LiveViews(market), START, END, min_events=1)
    return rounded(summaries.regime_signals(found), 9, "avg_markout_60m")


@over_market
def dashboard_summary(market: Market) -> DataFrame:
    overview = questions.symbol_overview(LiveViews(market), START, END)
    return rounded(summaries.dashboard_summary(overview), MEAN_DIGITS, "avg_volume")


@over_market
def data_quality_tier(market: Market) -> DataFrame:
    overview = questions.symbol_overview(LiveViews(market), START, END)
    return rounded(summaries.data_quality_tier(overview), MEAN_DIGITS, "avg_kline_volume")


@over_market
def leaderboard_rank(market: Market) -> DataFrame:
    moves = questions.positive_moves_60m(LiveViews(market), START, END)
    return rounded(summaries.leaderboard(moves, "n_positive_moves"), 6, "pct_of_leader")


@over_market
def leaderboard_top(market: Market) -> DataFrame:
    moves = questions.positive_moves_60m(LiveViews(market), START, END)
    return rounded(summaries.leaderboard(moves, "n_positive_moves", rows=3), 6, "pct_of_leader")
