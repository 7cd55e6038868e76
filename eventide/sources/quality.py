"""Integrity checks that a relational store would enforce by constraint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def duplicate_keys(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count ``n_rows``."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def key_report(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(table_name, n_duplicate_keys, n_extra_rows) for several tables."""
    return _stack(
        duplicate_keys(table, key).agg(
            F.count(F.lit(1)).alias("n_duplicate_keys"),
            F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).cast("bigint").alias("n_extra_rows"),
        ).select(F.lit(name).alias("table_name"), "n_duplicate_keys", "n_extra_rows")
        for name, (table, key) in tables.items()
    )


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, n_rows): non-NULL references without a parent.

    References are counted per value first (map-side), so a hot value meets the parent as one row.
    """
    references = (
        child.filter(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).alias("key"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return references.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def reference_report(links: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(reference, n_orphan_keys, n_orphan_rows) for several foreign keys."""
    return _stack(
        orphans(*link).agg(
            F.count(F.lit(1)).alias("n_orphan_keys"),
            F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_orphan_rows"),
        ).select(F.lit(name).alias("reference"), "n_orphan_keys", "n_orphan_rows")
        for name, link in links.items()
    )


def null_counts(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_null): one pass over the table for all columns."""
    counts = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "n_null")


def null_report(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(table_name, column_name, n_null) for several tables."""
    return _stack(
        null_counts(table, columns).select(F.lit(name).alias("table_name"), "column_name", "n_null")
        for name, (table, columns) in tables.items()
    )


def outside_domain(table: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is not one of the allowed ones (NULL counts as outside)."""
    return table.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def _stack(frames) -> DataFrame:
    frames = list(frames)
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
