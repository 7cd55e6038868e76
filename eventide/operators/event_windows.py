"""Joining events to the stretch of a series around them.

An interval join on ``symbol`` alone compares every event of a symbol with every one of its
rows. Time is cut into slots about as long as the window; a series row lies in one slot, an event
is copied to the few slots its window touches, and the join key becomes (symbol, day, slot) with
the exact time test left as a residual condition.

Statistics over windows of many hours do not need the pairs at all. The series is summed up once per symbol and hour
(count, sum, mean, squared deviation), a window takes the hours that lie wholly inside it as they are, and only
the rows of its first and last hour are met one by one. Partial results merge without loss: means and squared deviations
by the pairwise update, so that equal values still have no deviation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from eventide.functions.times import DAY_SECONDS, floor_time, span

# Slot widths that divide a day, so a slot never crosses midnight.
_WIDTHS = (900, 1800, 3600, 7200, 10_800, 14_400, 21_600, 43_200, DAY_SECONDS)


@dataclass(frozen=True)
class Reach:
    """How far a window extends around the event, and which of its ends belong to it."""

    before: timedelta = timedelta(0)
    after: timedelta = timedelta(0)
    closed_left: bool = True
    closed_right: bool = True

    def bounds(self, name: str) -> dict[str, Column]:
        """First and last instant per event, as columns computed once per event and not once per pair."""
        at = F.col("event_ts")
        return {f"{name}_from": at - span(self.before), f"{name}_to": at + span(self.after)}

    def holds(self, ts: str, name: str) -> Column:
        """Whether ``ts`` lies between the bounds of that name."""
        left, right = ">=" if self.closed_left else ">", "<=" if self.closed_right else "<"
        return F.expr(f"{ts} {left} {name}_from AND {ts} {right} {name}_to")

    @property
    def length(self) -> timedelta:
        return self.before + self.after

    @staticmethod
    def hull(reaches: Sequence[Reach]) -> Reach:
        """Smallest closed window that covers all of them."""
        return Reach(max(r.before for r in reaches), max(r.after for r in reaches))


@dataclass(frozen=True)
class Measure:
    """One aggregate of the series value over one window."""

    name: str
    kind: str  # sum, count (non-null values), rows, negatives, stddev
    reach: Reach


def slot_width(reach: Reach) -> int:
    """Shortest listed width that holds the window; a longer window touches several whole days."""
    length = reach.length.total_seconds()
    return next((width for width in _WIDTHS if width >= length), DAY_SECONDS)


def window_pairs(events: DataFrame, series: DataFrame, reach: Reach) -> DataFrame:
    """Inner join of events (symbol, event_ts, ...) with the series rows (symbol, ts, ...) in reach.

    A series that already carries ``day`` and is partitioned by (symbol, day) is not shuffled
    again. Event sets small enough are broadcast by Spark's own size check.
    """
    width = slot_width(reach)
    slots = F.sequence(floor_time("_hull_from", f"{width} seconds"), F.col("_hull_to"), span(timedelta(seconds=width)))
    spread = (
        events.withColumns(reach.bounds("_hull"))
        .withColumn("_slot", F.explode(slots))
        .withColumn("day", F.to_date("_slot"))
    )
    if "day" not in series.columns:
        series = series.withColumn("day", F.to_date("ts"))
    slotted = series.withColumn("_slot", floor_time("ts", f"{width} seconds"))
    joined = spread.join(slotted, ["symbol", "day", "_slot"])
    return joined.filter(reach.holds("ts", "_hull")).drop("day", "_slot", "_hull_from", "_hull_to")


def without_window_rows(events: DataFrame, series: DataFrame, reach: Reach) -> DataFrame:
    """Anti join: the events (symbol, event_ts, ...) with no series row in reach."""
    hit = window_pairs(events.select("symbol", "event_ts"), series.select("symbol", "ts"), reach)
    return events.join(hit.select("symbol", "event_ts"), ["symbol", "event_ts"], "left_anti")


def window_stats(
    events: DataFrame, series: DataFrame, measures: Sequence[Measure], value: str = "r1m", by_hours: bool = True
) -> DataFrame:
    """Aggregates per event over any number of windows, in one pass and one grouping.

    Every event column is kept and grouped on. Events with no row in any window are absent;
    use a ``rows`` measure to test the windows one by one. Without ``by_hours`` long windows too are met row by row, which
    takes fewer steps where few events are asked about.
    """
    reaches = list(dict.fromkeys(m.reach for m in measures))
    narrow = series.select(*[c for c in ("symbol", "day", "ts", value) if c in series.columns])
    if by_hours and any(r.length >= BY_HOURS for r in reaches):
        return _stats_by_hours(events, narrow, measures, reaches, value)
    hull = reaches[0] if len(reaches) == 1 else Reach.hull(reaches)
    # The join tests the hull; windows narrower than it are told apart by their own bounds.
    names = {reach: f"_w{i}" for i, reach in enumerate(reaches) if reach != hull}
    bounds = {column: bound for reach, name in names.items() for column, bound in reach.bounds(name).items()}
    pairs = window_pairs(events.withColumns(bounds), narrow, hull)

    def inside(reach: Reach) -> Column | None:
        return reach.holds("ts", names[reach]) if reach in names else None

    return pairs.groupBy(*events.columns).agg(*[_over_rows(m, F.col(value), inside(m.reach)).alias(m.name) for m in measures])


def _over_rows(measure: Measure, value: Column, inside: Column | None) -> Column:
    """A measure over single rows, of which those count that lie ``inside`` (None: all)."""
    chosen = value if inside is None else F.when(inside, value)
    inside = F.lit(True) if inside is None else inside
    if measure.kind == "sum":
        return F.sum(chosen)
    if measure.kind == "count":
        return F.count(chosen)
    if measure.kind == "rows":
        return F.count_if(inside)
    if measure.kind == "negatives":
        return F.count_if(inside & (value < 0))
    if measure.kind == "stddev":
        return F.stddev_samp(chosen)
    raise ValueError(f"unknown measure kind {measure.kind!r}")


# ---- long windows: whole hours and the rows at their ends -----------------------------------

BY_HOURS = timedelta(hours=6)  # windows from here on
_HOUR = timedelta(hours=1)
_HOUR_SECONDS = "3600 seconds"


def _mean(value: Column) -> Column:
    """The average, and of equal values exactly their value: hours that agree must not seem to differ."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.avg(value))


def hour_sums(slotted: DataFrame, value: str) -> DataFrame:
    """(symbol, day, _slot, _rows, _n, _sum, _mean, _m2, _negatives) per hour; a series partitioned by (symbol, day) stays so."""
    v = F.col(value)
    return slotted.groupBy("symbol", "day", "_slot").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(v).alias("_n"), F.sum(v).alias("_sum"), _mean(v).alias("_mean"),
        (F.var_pop(v) * F.count(v)).alias("_m2"), F.count_if(v < 0).alias("_negatives"),
    )


def _merged(total: Column, part: Column) -> Column:
    """Count, mean and squared deviation of two sets of values together."""
    n = total["n"] + part["n"]
    delta = part["mean"] - total["mean"]
    return F.struct(
        n.alias("n"), (total["mean"] + delta * part["n"] / n).alias("mean"),
        (total["m2"] + part["m2"] + delta * delta * total["n"] * part["n"] / n).alias("m2"),
    )


def _stats_by_hours(events: DataFrame, series: DataFrame, measures: Sequence[Measure], reaches: list[Reach], value: str) -> DataFrame:
    names = {reach: f"_w{i}" for i, reach in enumerate(reaches)}
    long = [r for r in reaches if r.length >= BY_HOURS]
    if "day" not in series.columns:
        series = series.withColumn("day", F.to_date("ts"))
    slotted = series.withColumn("_slot", floor_time("ts", _HOUR_SECONDS))
    bounded = events.withColumns({c: bound for reach, name in names.items() for c, bound in reach.bounds(name).items()})
    for reach, w in names.items():
        bounded = bounded.withColumn(f"{w}_first", floor_time(f"{w}_from", _HOUR_SECONDS))
        if reach in long:  # the hours from _begin up to _end lie wholly inside
            starts = F.col(f"{w}_first") == F.col(f"{w}_from") if reach.closed_left else F.lit(False)
            bounded = bounded.withColumn(f"{w}_begin", F.when(starts, F.col(f"{w}_first")).otherwise(F.col(f"{w}_first") + span(_HOUR)))
            bounded = bounded.withColumn(f"{w}_end", floor_time(f"{w}_to", _HOUR_SECONDS))

    def hours(first: str, last: Column) -> Column:
        return F.when(F.col(first) <= last, F.sequence(F.col(first), last, span(_HOUR))).otherwise(F.array().cast("array<timestamp_ntz>"))

    def spread(slots: list[Column]) -> DataFrame:
        return bounded.withColumn("_slot", F.explode(F.array_distinct(F.concat(*slots)))).withColumn("day", F.to_date("_slot"))

    ends = [F.array(f"{w}_first", f"{w}_end") if reach in long else hours(f"{w}_first", F.col(f"{w}_to")) for reach, w in names.items()]
    rows = spread(ends).join(slotted, ["symbol", "day", "_slot"])
    whole = spread([hours(f"{names[r]}_begin", F.col(f"{names[r]}_end") - span(_HOUR)) for r in long]).join(
        hour_sums(slotted, value), ["symbol", "day", "_slot"]
    )

    def inside_row(reach: Reach) -> Column:
        w = names[reach]
        held = reach.holds("ts", w)
        return held & F.expr(f"NOT (ts >= {w}_begin AND ts < {w}_end)") if reach in long else held

    def inside_hour(reach: Reach) -> Column:
        w = names[reach]
        return F.expr(f"_slot >= {w}_begin AND _slot < {w}_end") if reach in long else F.lit(False)

    flags = {reach: f"{w}_in" for reach, w in names.items()}
    sums = {"_rows": "bigint", "_n": "bigint", "_sum": "double", "_mean": "double", "_m2": "double", "_negatives": "bigint"}
    rows = rows.select(
        *events.columns, *[inside_row(r).alias(f) for r, f in flags.items()], F.col(value).cast("double").alias("_value"),
        F.lit(None).cast("timestamp_ntz").alias("_hour"), *[F.lit(None).cast(kind).alias(c) for c, kind in sums.items()],
    )
    whole = whole.select(
        *events.columns, *[inside_hour(r).alias(f) for r, f in flags.items()], F.lit(None).cast("double").alias("_value"),
        F.col("_slot").alias("_hour"), *[F.col(c).cast(kind).alias(c) for c, kind in sums.items()],
    )
    met = rows.unionByName(whole).filter(" OR ".join(flags.values()))
    single = F.col("_hour").isNull()
    aggregates: dict[str, Column] = {}
    results: list[Column] = []
    for m in measures:
        inside = F.col(flags[m.reach])
        if m.reach not in long or m.kind != "stddev":
            if m.reach not in long:
                aggregates[m.name] = _over_rows(m, F.col("_value"), inside)
            elif m.kind == "sum":
                aggregates[m.name] = F.sum(F.when(inside, F.when(single, F.col("_value")).otherwise(F.col("_sum"))))
            else:
                of_row = {"count": F.col("_value").isNotNull(), "rows": F.lit(True), "negatives": F.coalesce(F.col("_value") < 0, F.lit(False))}
                of_hour = {"count": "_n", "rows": "_rows", "negatives": "_negatives"}
                one = F.when(single, of_row[m.kind].cast("bigint")).otherwise(F.col(of_hour[m.kind]))
                aggregates[m.name] = F.coalesce(F.sum(F.when(inside, one)), F.lit(0))
            results.append(F.col(m.name))
            continue
        at_ends = F.when(inside & single, F.col("_value"))
        aggregates[f"{m.name}_ends"] = F.struct(
            F.count(at_ends).alias("n"), F.coalesce(_mean(at_ends), F.lit(0.0)).alias("mean"),
            F.coalesce(F.var_pop(at_ends) * F.count(at_ends), F.lit(0.0)).alias("m2"),
        )
        hour = F.struct("_hour", F.col("_n").alias("n"), F.col("_mean").alias("mean"), F.col("_m2").alias("m2"))
        aggregates[f"{m.name}_hours"] = F.sort_array(F.collect_list(F.when(inside & ~single & (F.col("_n") > 0), hour)))
        both = F.aggregate(f"{m.name}_hours", F.col(f"{m.name}_ends"), _merged, lambda t: F.when(t["n"] > 1, F.sqrt(t["m2"] / (t["n"] - 1))))
        results.append(both.alias(m.name))
    grouped = met.groupBy(*events.columns).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(*events.columns, *results)
