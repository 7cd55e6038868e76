import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from eventide.operators import ranking

SCHEMA = "g string, k int, v double"


def sample(spark, n=3000, seed=1):
    """One group and one value each hold over a third of all rows; some values are NULL."""
    draw = random.Random(seed)
    data = []
    for k in range(n):
        group = "hot" if draw.random() < 0.5 else draw.choice("abcdefgh")
        value = 7.0 if draw.random() < 0.4 else (None if draw.random() < 0.1 else draw.uniform(-5, 20))
        data.append((group, k, value))
    return spark.createDataFrame(data, SCHEMA).repartition(5)


ORDER = lambda: [F.col("v").asc_nulls_last(), F.col("k").asc()]


@pytest.mark.parametrize("keys", [(), ("g",)])
@pytest.mark.parametrize("tiles", [3, 10])
def test_tiles_equal_ntile(spark, keys, tiles):
    df = sample(spark)
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*ORDER())
    expected = rows(df.select("k", F.ntile(tiles).over(window).cast("bigint")), "k")
    assert rows(ranking.tile(df, tiles, "v", ["k"], keys, "tile").select("k", "tile"), "k") == expected


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_fewer_rows_than_tiles(spark, keys):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(6)], SCHEMA)
    assert [r[0] for r in rows(ranking.tile(df, 10, "v", ["k"], keys, "tile").select("tile"), "tile")] == [1, 2, 3, 4, 5, 6]
    assert ranking.tile(df.limit(0), 10, "v", ["k"], keys, "tile").count() == 0


def test_nulls_go_to_the_last_tile(spark):
    df = spark.createDataFrame([("a", i, None if i < 2 else float(i)) for i in range(6)], SCHEMA)
    tiled = dict(rows(ranking.tile(df, 3, "v", ["k"], (), "tile").select("k", "tile")))
    assert tiled == {2: 1, 3: 1, 4: 2, 5: 2, 0: 3, 1: 3}


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_all_percentiles_are_the_same_bit_for_bit(spark, share):
    """By group, over all rows and added to the rows: one formula, that of Spark's own function."""
    draw = random.Random(6)
    special = [float("inf"), float("-inf"), float("nan"), None]
    for seed in range(6):
        values = [draw.uniform(-1, 1) * 10 ** draw.randrange(-4, 5) for _ in range(draw.randrange(1, 300))]
        values += special[: seed if seed < 5 else 0]
        df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], SCHEMA).repartition(3)
        by_group = ranking.exact_percentile(df, "v", share, ["g"], "p").collect()[0].p
        own = df.agg(F.percentile("v", F.lit(share))).collect()[0][0]
        overall = ranking.exact_percentile(df, "v", share, (), "p").collect()
        added = {repr(r.p) for r in ranking.with_percentile(df, "v", share, "p").collect()}
        assert [repr(by_group)] == [repr(own)] == [repr(r.p) for r in overall] and added == {repr(own)}


def test_percentiles_next_to_other_aggregates(spark):
    df = sample(spark, seed=4)
    local = df.toPandas().dropna()
    found = ranking.exact_percentile(df, "v", 0.9, ["g"], "p", [F.count(F.lit(1)).alias("n")]).collect()
    for row in found:
        assert row.p == pytest.approx(np.quantile(local[local.g == row.g].v, 0.9), abs=1e-12)
    assert sum(r.n for r in found) == 3000


def test_percentile_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", 1, None)], SCHEMA)
    assert rows(ranking.exact_percentile(df, "v", 0.5, ["g"], "p")) == [("a", None)]
    assert rows(ranking.exact_percentile(df, "v", 0.5, (), "p")) == [(None,)]
    assert rows(ranking.exact_percentile(df.limit(0), "v", 0.5, (), "p")) == [(None,)]


@pytest.mark.parametrize("tiles", [2, 3, 7])
def test_borders_inside_equal_values(spark, tiles):
    """Ties of values, NaN and NULL over several tie columns, one of them hot."""
    draw = random.Random(tiles)
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -1e300, 2.5]
    data = [("hot" if draw.random() < 0.5 else draw.choice("abc"), k, draw.choice(values)) for k in range(700)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    order = Window.partitionBy().orderBy(F.col("v").asc_nulls_last(), "g", "k")
    expected = rows(df.select("k", F.ntile(tiles).over(order).cast("bigint")), "k")
    assert rows(ranking.tile(df, tiles, "v", ["g", "k"], (), "tile").select("k", "tile"), "k") == expected


def test_values_at_positions(spark):
    draw = random.Random(9)
    values = sorted(draw.choice([draw.gauss(0, 1), draw.uniform(1e-3, 1.001e-3), 4.0]) for _ in range(2000))
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], SCHEMA).repartition(7)
    asked = [0, 1, 600, 1000, 1999, 2000]
    found = rows(ranking.values_at(df, "v", [0.5], lambda total: F.array(*[F.lit(k).cast("bigint") for k in asked])), "_k")
    assert found == [(k, 2000, values[k], values.index(values[k])) for k in asked if k < 2000]


@pytest.mark.parametrize("shape", ["even", "ties", "nulls", "narrow"])
def test_many_rows_are_cut_by_the_sketch(spark, shape):
    """More rows than are counted one by one: most are outside the ranges, and the values are still exact."""
    value = {
        "even": "rand(1)", "ties": "IF(rand(1) < 0.4, 7D, rand(2) * 20 - 5)", "nulls": "IF(rand(1) < 0.5, NULL, IF(rand(2) < 0.3, double('nan'), rand(3)))",
        "narrow": "1 + rand(1) * 1e-9",
    }[shape]
    df = spark.range(0, 90_000, 1, 6).selectExpr("concat('s', hash(id) % 7) AS g", "CAST(id AS int) AS k", f"{value} AS v").cache()
    order = Window.partitionBy().orderBy(F.col("v").asc_nulls_last(), "g", "k")
    expected = df.select("k", F.ntile(3).over(order).cast("bigint").alias("t"))
    tiled = ranking.tile(df, 3, "v", ["g", "k"], (), "tile").select("k", "tile")
    assert expected.exceptAll(tiled).count() == 0
    own = df.agg(F.percentile("v", F.lit(0.5))).collect()[0][0]
    assert repr(ranking.exact_percentile(df, "v", 0.5, (), "p").collect()[0].p) == repr(own)
    df.unpersist()


def test_nothing_is_sorted_or_stored(spark):
    df = sample(spark)
    for result in (ranking.tile(df, 3, "v", ["k"]), ranking.with_percentile(df, "v", 0.5, "p")):
        text = result._jdf.queryExecution().optimizedPlan().toString()
        lines = [line.lstrip("+-: ") for line in text.splitlines()]
        assert "InMemoryRelation" not in text and not any(line.startswith("Sort ") for line in lines)
        assert all("xxhash64" in line for line in lines if line.startswith("RepartitionByExpression"))
