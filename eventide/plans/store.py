"""Derived tables kept as parquet, refreshed by batch jobs, and the views that read them.

Every table lies in one folder per day, sorted by symbol and time inside its files: a date range skips
folders, a symbol skips row groups. Rows are rebalanced by day before the write: adaptive execution
gives a day with most of the rows to several tasks and merges quiet days, and unlike a range partitioning
it does not compute the rows twice to sample them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from eventide.functions.times import TimeLike, clip, naive_utc, shift
from eventide.operators import event_metrics as metrics, mergeable
from eventide.operators.event_windows import Measure, Reach, window_stats
from eventide.operators.returns import VOL_PRECEDING, minute_returns
from eventide.plans.market import LiveViews, Market
from eventide.schemas import STORED
from eventide.session import table_bytes
from eventide.sources.ingest import insert_ignore

# Order of a refresh: a table comes after the ones it is built from.
DERIVED = (
    "minute_returns",
    "event_markouts",
    "event_car",
    "funding_deciles",
    "event_vol_levels",
    "event_volatility",
    "rolling_oi",
    "daily_rate_stats",
    "symbol_daily_stats",
)

BAR_DAYS = "bar_days"  # bars per symbol and day, kept with every write of klines
MOST_LIVE = 16  # versions of a table that count at once, before the newer ones are merged


class TableStore:
    """Parquet tables under one root folder that all executors share.

    A write adds a folder ``version=...`` with one folder per day and then, by one rename, a new state of the
    table: the versions that count and the day before which each does. Readers take the last state when they are
    planned, so they see a table as it was before a write or after it, and a write that fails changes nothing.
    One writer per table at a time.

    Appending adds a version, so a table's newer versions are merged into one as soon as more than ``MOST_LIVE`` count: all
    that are outweighed by those after them, so each row is rewritten about as often as its table doubles.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _states(self, name: str) -> list[str]:
        files, folder = self._files(f"{self.path(name)}/_state")
        if not files.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def exists(self, name: str) -> bool:
        return bool(self._states(name)) and bool(self._versions(name))

    def _versions(self, name: str) -> list[dict]:
        states = self._states(name)
        if not states:
            raise FileNotFoundError(f"no table {name} under {self.root}")
        files, place = self._files(f"{self.path(name)}/_state/{states[-1]}")
        stream = files.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, versions: list[dict]) -> None:
        states = self._states(name)
        number = int(states[-1].split(".")[0]) + 1 if states else 0
        files, draft = self._files(f"{self.path(name)}/_state/.{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(bytearray(json.dumps(versions).encode()))
        stream.close()
        target = self._files(f"{self.path(name)}/_state/{number:08d}.json")[1]
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"another writer changed {name}")

    def read(self, name: str) -> DataFrame:
        """The table with its ``day`` column; the layout is declared, so no file is opened to plan a query."""
        return self._rows_of(name, self._versions(name))

    def _rows_of(self, name: str, versions: list[dict]) -> DataFrame:
        folders = [T.StructField("version", T.StringType()), T.StructField("day", T.DateType())]
        table = self.spark.read.schema(T.StructType([*STORED[name][1].fields, *folders])).parquet(self.path(name))
        counts = F.lit(False)
        for entry in versions:
            valid = F.col("version") == entry["version"]
            if entry["before"] is not None:
                valid = valid & (F.col("day") < F.lit(entry["before"]).cast("date"))
            counts = counts | valid
        return table.filter(counts).drop("version")

    def _put(self, name: str, dated: DataFrame) -> str:
        """Rows with their ``day`` as a new version, which does not count yet."""
        time, layout = STORED[name]
        order = ["day", "symbol", *([time] if time else []), *(["ts"] if name == "event_car" else [])]
        laid_out = dated.select(*layout.fieldNames(), "day").hint("rebalance", "day").sortWithinPartitions(*order)
        version = f"v{uuid.uuid4().hex}"
        laid_out.write.partitionBy("day").parquet(f"{self.path(name)}/version={version}")
        return version

    def write(self, name: str, rows: DataFrame, since: date | None = None, append: bool = False) -> None:
        """Replace the table, or with ``since`` all its days from then on, also those that have no rows any more."""
        time, layout = STORED[name]
        day = F.to_date(time) if time else F.lit("1970-01-01").cast("date")
        dated = rows.select(*layout.fieldNames(), day.alias("day"))
        kept = self._versions(name) if (since is not None or append) and self.exists(name) else []
        if since is not None:
            dated = dated.filter(F.col("day") >= F.lit(since.isoformat()).cast("date"))
            kept = [e | {"before": min(e["before"] or "9999-12-31", since.isoformat())} for e in kept]
        version = self._put(name, dated)
        counted = self._withdraw_counts() if name == "klines" else []
        self._commit(name, [*kept, {"version": version, "before": None}])
        if name == "klines":
            self._count_days(version, counted, since, append)
        self._merge_versions(name)

    def _withdraw_counts(self) -> list[dict]:
        """From here until they are renewed no counts are there, so a write that breaks off leaves none that are wrong."""
        counted = self._versions(BAR_DAYS) if self.exists(BAR_DAYS) else []
        if counted:
            self._commit(BAR_DAYS, [])
        return counted

    def _count_days(self, version: str, counted: list[dict], since: date | None, append: bool) -> None:
        """Bars of every symbol and day that the version touches; of all days where none are counted yet."""
        bars = self.read("klines")
        if counted and append:
            files, folder = self._files(f"{self.path('klines')}/version={version}")
            days = [s.getPath().getName().removeprefix("day=") for s in files.listStatus(folder) if "day=" in s.getPath().getName()]
            bars = bars.filter(F.col("day").isin([date.fromisoformat(d) for d in days]))
        elif counted and since is not None:
            bars = bars.filter(F.col("day") >= F.lit(since.isoformat()).cast("date"))
            counted = [e | {"before": min(e["before"] or "9999-12-31", since.isoformat())} for e in counted]
        else:
            counted = []
        counts = bars.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n_bars")).withColumn("d", F.col("day"))
        self._commit(BAR_DAYS, [*counted, {"version": self._put(BAR_DAYS, counts), "before": None}])
        self._merge_versions(BAR_DAYS)

    def bar_days(self) -> DataFrame | None:
        """(symbol, day, n_bars) of all stored bars; days counted again have their newest, largest count."""
        if not self.exists(BAR_DAYS):
            return None
        return self.read(BAR_DAYS).groupBy("symbol", "day").agg(F.max("n_bars").alias("n_bars"))

    def _merge_versions(self, name: str) -> None:
        versions = self._versions(name)
        if len(versions) <= MOST_LIVE:
            return
        sizes = [table_bytes(self.spark, f"{self.path(name)}/version={e['version']}") for e in versions]
        first = next((i for i in range(len(sizes) - 1) if sizes[i] <= sum(sizes[i + 1 :])), len(sizes) - 2)
        merged = self._put(name, self._rows_of(name, versions[first:]))
        self._commit(name, [*versions[:first], {"version": merged, "before": None}])

    def vacuum(self, name: str) -> int:
        """Delete the versions and states that no longer count; no reader planned earlier may still run."""
        live, states = {e["version"] for e in self._versions(name)}, self._states(name)
        files, folder = self._files(self.path(name))
        gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().removeprefix("version=") not in {*live, "_state"}]
        gone += [self._files(f"{self.path(name)}/_state/{state}")[1] for state in states[:-1]]
        for path in gone:
            files.delete(path, True)
        return len(gone)

    def insert_ignore(self, name: str, batch: DataFrame, key: Sequence[str], arrival: Sequence[Column]) -> str | None:
        """Append the rows whose key is new, the first to arrive if a key repeats within the batch.

        Returns the earliest time in the batch, which is what :func:`refresh` needs to know as ``since``.
        Only the days the batch spans are read back. A table not there yet is created.
        """
        time = STORED[name][0]
        present = self.read(name) if self.exists(name) else None
        if time is None:
            self.write(name, insert_ignore(batch, present, key, arrival), append=True)
            return None
        first, last = batch.agg(F.min(time).cast("string"), F.max(time).cast("string")).first()
        if first is None:
            return None
        present = None if present is None else clip(present, time, first, last)
        self.write(name, insert_ignore(batch, present, key, arrival), append=True)
        return first

    def market(self, symbols: DataFrame | None = None, **options) -> Market:
        """The base tables of this store; ``symbols`` may be given from elsewhere, markers are there if stored."""
        base = ("klines", "funding", "open_interest", "premium_index")
        symbols = self.read("symbols").drop("day") if symbols is None else symbols
        if "event_markers" not in options and self.exists("event_markers"):
            options["event_markers"] = self.read("event_markers").drop("day")
        options.setdefault("bar_days", self.bar_days())
        return Market(symbols, *[self.read(name) for name in base], **options)


def bars_with_lead_in(store: TableStore, klines: DataFrame, start: datetime) -> DataFrame:
    """Bars from ``start`` on, and the days before it that hold the last rows their windows look back to.

    Which days these are is read off the stored daily counts, per symbol: usually the day before, but
    as far back as a gap in the data demands. No other history is scanned.
    """
    day = F.col("day") if "day" in klines.columns else F.to_date("open_time")
    klines = klines.withColumn("day", day)
    first_day = F.lit(start.date().isoformat()).cast("date")
    recent = klines.filter(F.col("day") >= first_day)
    newer = Window.partitionBy("symbol").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    counted = store.read("symbol_daily_stats").filter((F.col("d") < first_day) & (F.col("n_klines") > 0))
    needed = (
        counted.join(recent.select("symbol").distinct(), "symbol", "left_semi")
        .withColumn("_after", F.coalesce(F.sum("n_klines").over(newer), F.lit(0)))
        .filter(F.col("_after") <= VOL_PRECEDING)
        .select("symbol", F.col("d").alias("day"))
    )
    earliest = needed.agg(F.min("day").cast("string")).first()[0]
    if earliest is None:
        return recent
    before = klines.filter((F.col("day") >= F.lit(earliest).cast("date")) & (F.col("day") < first_day))
    return recent.unionByName(before.join(needed, ["symbol", "day"], "left_semi").select(*recent.columns))


def refresh(store: TableStore, market: Market, since: TimeLike | None = None) -> None:
    """Rebuild the derived tables in order of dependency.

    With ``since``, base rows before that day are taken as unchanged, and only days whose windows
    can reach a changed row are rewritten. Terciles depend on all events, so those are always
    rebuilt, from the stored volatility levels and not from the bars. Tables that do not depend on
    each other are written side by side, so that the last tasks of one do not hold up the others.
    """
    day = None if since is None else naive_utc(since).date()
    start = None if day is None else datetime.combine(day, datetime.min.time())
    live, stored = LiveViews(market), StoredViews(store, market)
    klines = market.klines if start is None else bars_with_lead_in(store, market.klines, start)

    def around_events(name: str, build: Callable[[DataFrame, DataFrame], DataFrame], reach: Reach) -> None:
        """Events whose window ends after the change begin the window's length earlier."""
        begin = None if start is None else datetime.combine((start - reach.after).date(), datetime.min.time())
        table = build(live.events(begin), stored.returns(begin, None, reach))
        store.write(name, table, None if begin is None else begin.date())

    def regimes() -> None:
        levels = store.read("event_vol_levels").drop("day")
        store.write("event_volatility", metrics.with_vol_regime(levels))

    def daily() -> None:
        recent = clip(market.klines, "open_time", start, None)
        store.write("symbol_daily_stats", metrics.symbol_daily_stats(recent, live.funding(start)), day)

    steps = (
        (
            lambda: store.write("minute_returns", minute_returns(klines, start), day),
            lambda: store.write("funding_deciles", live.funding_deciles(start), day),
            lambda: store.write("rolling_oi", live.rolling_oi(start), day),
            lambda: store.write("daily_rate_stats", live.daily_rate_stats(start), day),
        ),
        (
            lambda: around_events("event_markouts", metrics.event_markouts, metrics.FORWARD_60M),
            lambda: around_events("event_car", metrics.event_car_series, metrics.CAR_WINDOW),
            lambda: around_events("event_vol_levels", metrics.event_volatility_levels, metrics.BEFORE_1D),
            daily,  # the lead-in of the first step reads its earlier state
        ),
        (regimes,),
    )
    with ThreadPoolExecutor(max_workers=4) as pool:
        for step in steps:
            for done in [pool.submit(inheritable_thread_target(store.spark)(write)) for write in step]:
                done.result()


def refresh_summaries(store: TableStore, market: Market, since: TimeLike | None = None) -> None:
    """Daily bitmaps of the bars and daily sketches of the stored returns; with ``since``, of the days from then on."""
    day = None if since is None else naive_utc(since).date()
    start = None if day is None else datetime.combine(day, datetime.min.time())
    store.write("bar_minutes", mergeable.minute_bitmaps(clip(market.klines, "open_time", start, None)), day)
    returns = clip(store.read("minute_returns"), "ts", start, None)
    store.write("return_sketches", mergeable.daily_sketches(returns, "r1m"), day)


class StoredViews:
    """The frames of :class:`LiveViews`, read from the store; as fresh as the last refresh."""

    def __init__(self, store: TableStore, market: Market):
        self.store, self.market = store, market

    def _ranged(self, name: str, start, end) -> DataFrame:
        return clip(self.store.read(name), STORED[name][0], start, end).drop("day")

    def funding(self, start: TimeLike | None = None, end: TimeLike | None = None) -> DataFrame:
        return clip(self.market.funding, "ts", start, end).select("symbol", "ts", "rate")

    def events(self, start=None, end=None, symbol: str | None = None) -> DataFrame:
        funding = self.funding(start, end)
        return metrics.as_events(funding if symbol is None else funding.filter(F.col("symbol") == symbol))

    def returns(self, start=None, end=None, reach: Reach = Reach(), symbol: str | None = None) -> DataFrame:
        ranged = clip(self.store.read("minute_returns"), "ts", shift(start, -reach.before), shift(end, reach.after))
        if symbol is not None:
            ranged = ranged.filter(F.col("symbol") == symbol)
        return ranged.select("symbol", "day", "ts", "r1m")

    def event_markouts(self, start=None, end=None) -> DataFrame:
        return self._ranged("event_markouts", start, end)

    def markouts_of(self, events: DataFrame, start=None, end=None) -> DataFrame:
        markouts = self.event_markouts(start, end).select("symbol", "event_ts", "markout_60m", "n_minutes")
        return events.join(markouts, ["symbol", "event_ts"])

    def event_car(self, start=None, end=None, symbol: str | None = None) -> DataFrame:
        paths = self._ranged("event_car", start, end)
        return paths if symbol is None else paths.filter(F.col("symbol") == symbol)

    def event_volatility(self, start=None, end=None, scope: str = "all") -> DataFrame:
        if scope == "filtered":
            levels = self._ranged("event_vol_levels", start, end)
            return metrics.with_vol_regime(levels)
        return self._ranged("event_volatility", start, end)

    def vol_regime_events(self, start=None, end=None, scope: str = "all") -> DataFrame:
        events = self.event_volatility(start, end, scope).select("symbol", "event_ts", "vol_regime")
        return self.markouts_of(events, start, end).drop("n_minutes")

    def hourly_vol(self, start=None, end=None) -> DataFrame:
        return self._ranged("event_vol_levels", start, end).select("symbol", "event_ts", "rv_1h")

    def daily_vol(self, start=None, end=None) -> DataFrame:
        """As stored: only events with a return in the last *hour* are present."""
        return self._ranged("event_vol_levels", start, end).select("symbol", "event_ts", "rv_1d")

    def funding_deciles(self, start=None, end=None, scope: str = "all") -> DataFrame:
        if scope == "filtered":
            return LiveViews(self.market).funding_deciles(start, end, scope)
        return self._ranged("funding_deciles", start, end)

    def daily_rate_stats(self, start=None, end=None, scope: str = "all") -> DataFrame:
        if scope == "filtered":
            return LiveViews(self.market).daily_rate_stats(start, end, scope)
        days = (None if t is None else naive_utc(t).date() for t in (start, end))
        return self._ranged("daily_rate_stats", *days)

    def rolling_oi(self, start=None, end=None, closed: bool = False) -> DataFrame:
        if closed:
            return LiveViews(self.market).rolling_oi(start, end, closed)
        return self._ranged("rolling_oi", start, end)

    def rolling_oi_at(self, times: DataFrame, start=None, end=None, closed: bool = False) -> DataFrame:
        if closed:
            return LiveViews(self.market).rolling_oi_at(times, start, end, closed)
        return self.rolling_oi(start, end).join(times, ["symbol", "ts"], "left_semi")

    def symbol_daily_stats(self) -> DataFrame:
        return self.store.read("symbol_daily_stats")

    def fall_risk(self, start=None, end=None) -> DataFrame:
        levels = self.daily_vol(start, end)
        reach = metrics.FORWARD_30M
        falls = self.returns(start, end, reach).filter(F.col("r1m") < 0)
        counted = window_stats(levels.select("symbol", "event_ts"), falls, [Measure("n_falls", "rows", reach)])
        return levels.join(counted, ["symbol", "event_ts"], "left").fillna(0, ["n_falls"])
