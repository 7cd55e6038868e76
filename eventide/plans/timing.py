"""Timed runs, and the comparison of a question's raw form with its stored form."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


def run_ms(build: Callable[[], DataFrame]) -> float:
    """Milliseconds to plan and fully compute a query; the rows go nowhere."""
    begun = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - begun) * 1000


def compare(spark: SparkSession, pairs: Mapping[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]]) -> DataFrame:
    """(query, slow_ms, fast_ms, improvement_pct, speedup), each form once untimed before. Clears the session's cache."""
    measured = []
    for name, (slow, fast) in pairs.items():
        times = []
        for form in (slow, fast, slow, fast):
            spark.catalog.clearCache()  # rows that a global rank persisted must not serve the next run
            times.append(run_ms(form))
        measured.append((name, *times[2:]))
    return with_speedup(spark.createDataFrame(measured, "query string, slow_ms double, fast_ms double"))


def with_speedup(measured: DataFrame) -> DataFrame:
    slow, fast = F.col("slow_ms"), F.col("fast_ms")
    return measured.select(
        "*", ((slow - fast) / slow * 100).alias("improvement_pct"), (slow / fast).alias("speedup")
    )


def comparison_totals(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.sum("slow_ms").alias("total_slow_ms"),
        F.sum("fast_ms").alias("total_fast_ms"),
        F.avg("improvement_pct").alias("avg_improvement_pct"),
    )
