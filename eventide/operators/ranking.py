"""Tiles and exact percentiles, by group or over all rows.

Groups here are bounded by the calendar: a day holds at most one print per symbol and point of its time grid, a symbol and
day at most one per point. They use Spark's own window and aggregate functions.

Over all rows nothing bounds the group, so it is never sorted. A wanted position is found by counting twice. The first pass
is a quantile sketch: a bounded summary that tells between which two values the position must lie, to within a few
ten-thousandths of the rows. The second counts everything outside these ranges as a whole and the values inside one by one;
their running count holds the exact value. So of n rows the counts of a thousandth or so meet in one task, and equal values,
however many, as one count. Where equal values straddle the border between two tiles, they are counted by the columns
that break the tie too, and only the rows which the last of these tells apart are numbered. Tiles and percentiles are then a
comparison of each row with a few cuts. Nothing is stored, and building a result starts no job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 10_000  # the sketch is off by at most a ten-thousandth of the rows
MARGIN = 4 / ACCURACY
FEW = 20_000  # up to so many rows the margin is less than a few of them, and all are counted one by one


def interpolate(low, high, position, floor, ceil):
    """Value between two neighbours, as Spark's own percentile computes it; for columns and numbers alike."""
    return (ceil - position) * low + (position - floor) * high


def _proxy(value: Column) -> Column:
    """What the sketch sees: NaN and NULL as infinity, which they follow."""
    return F.when(value.isNull() | F.isnan(value), F.lit(float("inf"))).otherwise(value)


def _kind(value: Column) -> Column:
    """0 for numbers, 1 for NaN, 2 for NULL: their order among equal proxies."""
    return F.when(value.isNull(), F.lit(2)).when(F.isnan(value), F.lit(1)).otherwise(F.lit(0))


def values_at(
    df: DataFrame, value: str, shares: Sequence[float], positions: Callable[[Column], Column], ties: Sequence[str] = ()
) -> DataFrame:
    """(_k, _total, _value, ties..., _before): the row at each wanted position (from 0) of the order by ``value`` (NaN and
    then NULL last) and ``ties``, and how many rows come before the first with the same of these.

    ``positions`` turns the number of rows into an array of positions near ``shares`` of them; those beyond the last row give
    nothing.
    """
    number = F.col(value).cast("double")
    rows = df.select(number.alias("_value"), _proxy(number).alias("_u"), *[F.col(c).alias(f"_tie_{c}") for c in ties])
    bounds = [min(max(share + side * MARGIN, 0.0), 1.0) for share in sorted(shares) for side in (-1, 1)]
    sketch = F.percentile_approx("_u", F.array(*[F.lit(b) for b in bounds]), F.lit(ACCURACY))
    summary = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_total"), sketch.alias("_bounds")))  # one row
    u, bound = F.col("_u"), lambda i: F.get("_bounds", F.lit(i))
    between = [(bound(2 * i) <= u) & (u <= bound(2 * i + 1)) for i in range(len(shares))]
    beyond = sum(((bound(2 * i + 1) < u).cast("int") for i in range(len(shares))), F.lit(0))
    placed = rows.crossJoin(summary).withColumn("_inside", (F.col("_total") <= FEW) | F.greatest(*between, F.lit(False)))
    own = ["_value", *[f"_tie_{c}" for c in ties]]
    counts = (
        placed.withColumn("_gap", F.when(~F.col("_inside"), beyond))
        .withColumns({c: F.when(F.col("_inside"), F.col(c)) for c in own})
        .withColumn("_order", F.when(F.col("_inside"), _kind(F.col("_value"))).otherwise(F.lit(0)))
        .groupBy("_total", "_inside", "_gap", "_order", *own).agg(F.count(F.lit(1)).alias("_n"), F.min("_u").alias("_u"))
    )
    run = Window.partitionBy().orderBy("_u", "_order", *own).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    held = F.filter(positions(F.col("_total")), lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")))
    sure = F.when(F.col("_inside"), held).otherwise(
        F.when(F.size(held) > 0, F.raise_error(F.lit("a position lies outside its range"))).otherwise(held)
    )
    return ranked.select(F.explode(sure).alias("_k"), "_total", *own, "_before")


def _shared(df: DataFrame) -> DataFrame:
    """Rows that several steps of one plan read, computed once: dealt out by all their columns, none of which a step can
    then leave out, so that its copy of the plan up to here is like the others and Spark reuses the exchange."""
    return df.repartition(F.xxhash64(*df.columns))


def _borders(total: Column, tiles: int) -> Column:
    """Position of the first row of every tile but the first."""
    small = F.floor(total / tiles)
    return F.transform(F.sequence(F.lit(1), F.lit(tiles - 1)), lambda j: j * small + F.least(j, total % tiles))


def tile(df: DataFrame, tiles: int, value: str, ties: Sequence[str], keys: Sequence[str] = (), name: str = "tile") -> DataFrame:
    """NTILE by ``value`` (NULLs last) and then ``ties``, which tell all rows apart: sizes differ by at most one, larger
    tiles first; fewer rows than tiles leave tiles out.

    Groups of ``keys`` must be bounded; without keys all rows are one group of any size.
    """
    order = [F.col(value).asc_nulls_last(), *[F.col(c).asc() for c in ties]]
    if keys:
        return df.withColumn(name, F.ntile(tiles).over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    *groups, last = ties
    df = _shared(df)
    cuts = values_at(df, value, [j / tiles for j in range(1, tiles)], lambda total: _borders(total, tiles), groups)

    def place(number: Column, tie: Callable[[str], Column]) -> list[Column]:
        """Fields that compare one after the other: NULL last, NaN as the largest number."""
        return [number.isNull().alias("no_value"), F.coalesce(number, F.lit(0.0)).alias("value"), *[tie(c).alias(c) for c in groups]]

    of_cut = F.struct(*place(F.col("_value"), lambda c: F.col(f"_tie_{c}")))
    listed = cuts.agg(F.collect_list(F.struct(of_cut.alias("place"), "_k", "_before")).alias("_cuts"))  # one row, a cut per border
    own = place(F.col(value).cast("double"), F.col)
    rows = df.crossJoin(F.broadcast(listed)).withColumn("_own", F.struct(*own))
    # Rows that only the last tie column tells apart from a cut, such as the times of one symbol, are numbered; all others are
    # groups of their own.
    tied = F.exists("_cuts", lambda cut: cut["place"] == F.col("_own"))
    alike = Window.partitionBy("_own", F.when(~tied, F.col(last))).orderBy(last)
    numbered = rows.withColumn("_number", F.row_number().over(alike))
    passed = F.size(F.filter("_cuts", lambda cut: (cut["place"] < F.col("_own")) | (
        (cut["place"] == F.col("_own")) & (cut["_before"] + F.col("_number") > cut["_k"])
    )))
    return numbered.withColumn(name, (passed + 1).cast("bigint")).drop("_cuts", "_own", "_number")


def _overall_percentile(df: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """One row; NULL if there is no value."""
    position = lambda total: (total - 1) * F.lit(share)
    both = lambda total: F.array_distinct(F.array(F.floor(position(total)), F.ceil(position(total))))
    found = values_at(df.filter(F.col(value).isNotNull()), value, [share], both).withColumn("_at", position(F.col("_total")))
    at_end = lambda side: F.max(F.when(F.col("_k") == side("_at"), F.col("_value")))
    ends = found.agg(at_end(F.floor).alias("_low"), at_end(F.ceil).alias("_high"), F.max("_at").alias("_at"))
    low, high, at = F.col("_low"), F.col("_high"), F.col("_at")
    return ends.select(F.when(low == high, low).otherwise(interpolate(low, high, at, F.floor(at), F.ceil(at))).alias(name))


def exact_percentile(
    df: DataFrame, value: str, share: float, keys: Sequence[str] = (), name: str = "percentile", extra: Sequence[Column] = ()
) -> DataFrame:
    """Continuous percentile with linear interpolation, NULLs left out, NaN above all numbers.

    By ``keys``, whose groups must be bounded, next to any ``extra`` aggregates; or one row over all rows.
    """
    if keys:
        return df.groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias(name), *extra)
    return _overall_percentile(df, value, share, name)


def with_percentile(df: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """Add the overall percentile of ``value`` to every row."""
    df = _shared(df)
    return df.crossJoin(F.broadcast(_overall_percentile(df, value, share, name)))  # a single row
