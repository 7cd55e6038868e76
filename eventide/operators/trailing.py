"""Exact percentile over a trailing time range.

Spark's RANGE frame answers this, but it rebuilds the percentile of the whole frame for every row:
4 032 values per row for 14 days of 5-minute snapshots. Here the values of a symbol are kept as sorted runs of equal time
spans, a whole number of which make up the range. A trailing range holds whole runs, merged once for all rows of a run,
and the ends of two more: the row's own run up to the row, and the oldest run after the time where the range begins.
What a run keeps of its order when times are cut off is still sorted, and the percentile's neighbours lie within as many
places of the merged runs as the two ends have values. So each row merges two short runs with a short slice.

Short runs make the ends cheap, long ones the merges: with 112 runs a range (three hours of 14 days) 5-minute rows take least.

All of it is expressions of the JVM. Runs are gathered per (symbol, run), copied to the block of their own range and to the next
one, and meet there: a group spans two ranges of time at most, and the rows of one range are bounded where (symbol, ts)
is unique, as the loads of this library keep it.

NULL values are left out, NaN counts as larger than all numbers, infinities are numbers: the percentile
that Spark's aggregate gives over the same frame, by the same formula.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from eventide.functions.times import TimeLike, clip, floor_time, in_range, shift, span
from eventide.operators.ranking import interpolate

TRAILING = timedelta(days=14)
MOST_RUNS = 112


def _run_length(reach: timedelta) -> int:
    """Seconds of a run: the range holds a whole number of them."""
    seconds = int(reach.total_seconds())
    return next(seconds // n for n in range(MOST_RUNS, 0, -1) if seconds % n == 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though used more than once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nth_of_runs(whole: Column, ends: Column, share: float) -> Column:
    """Percentile of the values in one long sorted run and two short ones (``ends.now``, ``ends.old``)."""
    short = F.size(ends["now"]) + F.size(ends["old"])
    count = F.size(whole) + short
    position = (count - 1) * F.lit(share)

    def chosen(at: Column) -> Column:
        # Values before ``skip`` cannot be the wanted ones: even with all short values before them they come too early.
        skip = F.greatest(at["floor"] - at["short"], F.lit(0)).cast("int")
        near = F.sort_array(F.concat(F.slice(whole, skip + 1, at["short"] + 2), ends["now"], ends["old"]))
        pair = _let(near, lambda n: F.struct(F.get(n, at["floor"].cast("int") - skip).alias("low"), F.get(n, at["ceil"].cast("int") - skip).alias("high")))
        between = lambda p: F.when(p["low"] == p["high"], p["low"]).otherwise(
            interpolate(p["low"], p["high"], at["position"], at["floor"], at["ceil"])
        )
        return _let(pair, between)

    at = F.struct(
        position.alias("position"), F.floor(position).alias("floor"), F.ceil(position).alias("ceil"), short.alias("short")
    )
    return F.when(count > 0, _let(at, chosen))


def _rolled(
    series: DataFrame, value: str, share: float, reach: timedelta, closed: bool, start: TimeLike | None, end: TimeLike | None, name: str,
    times: DataFrame | None,
) -> DataFrame:
    length = _run_length(reach)
    rows = clip(series, "ts", shift(start, -reach), end).select("symbol", "ts", F.col(value).cast("double").alias("_value"))
    asked = in_range("ts", start, end)
    if times is not None:
        marked = times.select("symbol", "ts").distinct().withColumn("_marked", F.lit(True))
        rows = rows.join(marked, ["symbol", "ts"], "left")
        asked = asked & F.coalesce("_marked", F.lit(False))
    sorted_run = F.sort_array(F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("_value", "ts"))))
    runs = (
        rows.withColumn("_run", floor_time("ts", f"{length} seconds"))
        .groupBy("symbol", "_run")
        .agg(sorted_run.alias("_sorted"), F.collect_list(F.when(asked, F.struct("ts", "_value"))).alias("_asked"))
        .withColumn("_own", floor_time("_run", f"{int(reach.total_seconds())} seconds"))
        .withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + span(reach))))
    )
    if times is not None:  # blocks that nobody asks for are left out before the runs meet
        blocks = clip(times, "ts", start, end).select("symbol", floor_time("ts", f"{int(reach.total_seconds())} seconds").alias("_block"))
        runs = runs.join(blocks.distinct(), ["symbol", "_block"], "left_semi")
    run = F.struct(
        F.col("_run").alias("run"), F.col("_sorted._value").alias("values"), F.col("_sorted.ts").alias("times"),
        F.when(F.col("_own") == F.col("_block"), F.col("_asked")).otherwise(F.array()).alias("asked"),
    )
    blocks = runs.groupBy("symbol", "_block").agg(F.collect_list(run).alias("_runs"))
    each = blocks.select("symbol", "_runs", F.explode(F.filter("_runs", lambda r: F.size(r["asked"]) > 0)).alias("_here"))
    here, reach_back = F.col("_here.run"), F.col("_here.run") - span(reach)
    whole = F.flatten(F.transform(F.filter("_runs", lambda r: (r["run"] > reach_back) & (r["run"] < here)), lambda r: r["values"]))
    ready = each.select(
        "symbol", "_here", F.sort_array(whole).alias("_whole"),
        F.get(F.filter("_runs", lambda r: r["run"] == reach_back), F.lit(0)).alias("_oldest"),
    ).withColumn("_oldest", F.struct(
        F.coalesce("_oldest.values", F.array().cast("array<double>")).alias("values"), F.col("_oldest.times").alias("times")
    ))

    def answer(row: Column) -> Column:
        begin = row["ts"] - span(reach)
        after = (lambda t: t >= begin) if closed else (lambda t: t > begin)
        ends = F.struct(
            F.filter("_here.values", lambda v, i: F.get(F.col("_here.times"), i) <= row["ts"]).alias("now"),
            F.filter("_oldest.values", lambda v, i: after(F.get(F.col("_oldest.times"), i))).alias("old"),
        )
        return F.struct(row["ts"].alias("ts"), row["_value"].alias(value), _let(ends, lambda e: _nth_of_runs(F.col("_whole"), e, share)).alias(name))

    # The merged runs are a column below the generator, so they are not computed again for every row.
    return ready.select("symbol", F.explode(F.transform("_here.asked", answer)).alias("_row")).select("symbol", "_row.*")


def trailing_percentile(
    series: DataFrame,
    value: str,
    share: float,
    reach: timedelta = TRAILING,
    closed: bool = False,
    start: TimeLike | None = None,
    end: TimeLike | None = None,
    name: str = "trailing",
) -> DataFrame:
    """(symbol, ts, value, name): percentile of ``value`` over (ts - reach, ts] per row.

    ``closed`` also takes in the row exactly ``reach`` ago. With bounds, only rows of that time
    range are returned; earlier ones are read just as far back as the range needs.
    """
    return _rolled(series, value, share, reach, closed, start, end, name, None)


def trailing_percentile_at(
    series: DataFrame,
    times: DataFrame,
    value: str,
    share: float,
    reach: timedelta = TRAILING,
    closed: bool = False,
    start: TimeLike | None = None,
    end: TimeLike | None = None,
    name: str = "trailing",
) -> DataFrame:
    """:func:`trailing_percentile` for the rows at ``times`` (symbol, ts) only: no other row is answered."""
    return _rolled(series, value, share, reach, closed, start, end, name, times)
