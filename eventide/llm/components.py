"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Links (a, b) with a > b. Each node ties its larger neighbours, or itself and its smaller ones, to the smallest of all."""
    if larger:
        near = links.select(F.col("b").alias("u"), F.col("a").alias("v")).unionAll(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    smallest = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(smallest, "u")
    moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if larger:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.unionAll(smallest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (columns a, b; null-free): label is the smallest node reachable.

    The number of rounds grows with the logarithm of a component's size. Each round is written to the shared folder;
    nothing but two numbers a round comes to the driver.
    """
    ordered = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, seen = written(ordered.distinct(), "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if mark == seen:
            break
        seen = mark
        if mark[0] == 0:
            break
        now = written(_stars(_stars(now, larger=True), larger=False), "links")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
