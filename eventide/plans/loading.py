"""Loading raw files into the base tables of a store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from eventide.plans.store import TableStore
from eventide.schemas import PRIMARY_KEYS
from eventide.session import shared_folder
from eventide.sources import ingest

_CSV_LOADERS = {
    "funding": ingest.load_funding,
    "open_interest": ingest.load_open_interest,
    "premium_index": ingest.load_premium_index,
}


@dataclass(frozen=True)
class Loaded:
    """What a load did: counts per table and source, and the earliest time it may have changed, for ``refresh``."""

    report: DataFrame  # table_name, source, n_good, n_bad
    since: str | None


def load_table(store: TableStore, name: str, flagged: DataFrame, arrival: Sequence[Column], *report_by: str) -> Loaded:
    """Add the valid rows of known symbols to the table, first write wins; other rows are counted as bad.

    The parsed rows are checkpointed, so that files are unpacked and parsed once for counting and
    writing together.
    """
    shared_folder(store.spark)
    known = store.read("symbols").select(F.col("symbol").alias("_known"))
    checked = flagged.join(known, F.col("symbol") == F.col("_known"), "left").withColumn(
        "is_valid", F.col("is_valid") & F.col("_known").isNotNull()
    )
    parsed = checked.drop("_known").checkpoint()
    since = store.insert_ignore(name, ingest.valid_rows(parsed), PRIMARY_KEYS[name], arrival)
    counts = ingest.quality_counts(parsed, *report_by)
    source = F.col(report_by[0]) if report_by else F.lit(None).cast("string")
    return Loaded(counts.select(F.lit(name).alias("table_name"), source.alias("source"), "n_good", "n_bad"), since)


def load_markers(store: TableStore) -> None:
    """Every stored funding print as an event marker of its kind; markers that are there stay."""
    funding = store.read("funding").select("symbol", F.col("ts").alias("event_ts"), F.lit("funding").alias("kind"))
    store.insert_ignore("event_markers", funding, PRIMARY_KEYS["event_markers"], [F.col("kind").asc()])


def load_files(store: TableStore, symbols: Sequence[str], archives: str, csv_paths: Mapping[str, str]) -> Loaded:
    """Symbols, kline archives, the CSV tables named in ``csv_paths`` and the event markers of funding prints.

    The report has one row per archive and per CSV table. Of rows with the same key, the first line of
    the first file by name is kept; rows of a symbol that is not stored are refused.
    """
    spark = store.spark
    dimension = ingest.symbol_dimension(spark.createDataFrame([(s,) for s in symbols], "symbol string"))
    store.insert_ignore("symbols", dimension, PRIMARY_KEYS["symbols"], [F.col("symbol").asc()])
    flagged = ingest.load_klines(spark, archives, symbols)
    loads = [load_table(store, "klines", flagged, [F.col("path").asc(), F.col("line_no").asc()], "path")]
    for name, path in csv_paths.items():
        loads.append(load_table(store, name, _CSV_LOADERS[name](spark, path), [F.col("arrival").asc()]))
    if "funding" in csv_paths:
        load_markers(store)
    report = reduce(DataFrame.unionByName, [load.report for load in loads])
    return Loaded(report, min((load.since for load in loads if load.since is not None), default=None))
