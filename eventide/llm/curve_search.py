"""Nearest neighbours by inner product, from windows of shifted space-filling curves.

Every distinct vector is projected at random to a few dimensions and put on a Hilbert curve, in several orderings with
different projections and shifts. Spark range-partitions and ranks each ordering; ranks are cut into blocks. A query
looks at the blocks up to ``w`` away from its own in every ordering, each block gives its best candidates with their inner
products in double precision, and the merged candidates of all orderings are ranked again. Largest inner products become
nearest points by one more coordinate that brings all candidates to the same length.

The width ``w`` is fitted, not set: for at most ``SAMPLE`` queries the true neighbours are found by brute force over all
rows, their distances in blocks are looked up, and the smallest width that reaches ``recall`` of them is used. All rows
are indexed and all queries are answered whatever the sample. Equal vectors are one class that keeps its k + 1 smallest
ids, which is all a result of k can need, so a vector that many rows share costs no more than one.

Vectors that are null, zero, hold null or non-finite components or have not the most common length take no part, nor do null
ids. Rows that repeat an id with the same vector count once; a query never finds its own id. Ties go to the smaller id. An empty table
gives an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import numbered, with_rank, written

ORDERINGS, DIMENSIONS, KEY_BITS = 4, 6, 10
BLOCK = 2048
SAMPLE = 256
SPAN_BLOCKS = 64  # longest run of blocks that one task reads for its queries
QUERIES = 8192  # queries that a task holds, about
SEED = 20240607


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits (rows: points)."""
    axes = [c.astype(np.int64) for c in cells.T]
    n = len(axes)
    for level in range(bits - 1, 0, -1):  # undo the rotations of the larger cubes
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            inverted = (axes[i] & bit) != 0
            swapped = np.where(inverted, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(inverted, axes[0] ^ low, axes[0]) ^ swapped
            axes[i] = axes[i] ^ swapped if i else axes[0]
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def curve_keys(vectors: np.ndarray, lift: np.ndarray, longest: float, ordering: int) -> np.ndarray:
    """Keys of vectors extended by the coordinate ``lift`` to the length ``longest``."""
    size = vectors.shape[1] + 1
    random = np.random.default_rng(SEED + ordering)
    axes = np.linalg.qr(random.standard_normal((size, min(size, DIMENSIONS))))[0]
    places = (vectors @ axes[:-1] + lift[:, None] * axes[-1]) / longest
    unit = np.clip(0.5 + places * np.sqrt(size) / 8, 0, 1)  # four deviations of evenly spread directions to each side
    shifted = (unit + random.random(axes.shape[1])) / 2
    return hilbert(np.minimum((shifted * (1 << KEY_BITS)).astype(np.int64), (1 << KEY_BITS) - 1), KEY_BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _classes(vectors: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """Written tables of distinct vectors (class, vec, ids, asked) and of queries (class, query_id)."""
    sound = F.expr("forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)")
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")
    ).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(sound)
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).withColumn("size", F.size("vec"))
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).select(F.col("size").alias("_size"))
    rows = rows.join(F.broadcast(usual), F.col("size") == F.col("_size"), "left_semi").drop("size").distinct()
    held = rows.withColumn("asked", F.coalesce(is_query, F.lit(False)))
    order = Window.partitionBy("vec").orderBy("vec_id")
    first = held.select("vec", "vec_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    listed = first.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    # The smallest id names a class.
    classes = written(listed.select(F.get("ids", F.lit(0)).alias("class"), "vec", "ids"), "vector-classes")
    asked = held.filter("asked").select("vec", F.col("vec_id").alias("query_id")).join(classes.select("vec", "class"), "vec")
    return classes, written(asked.select("class", "query_id"), "vector-queries")


def _ordered(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """All distinct vectors (kind 0) and queries (kind 1) with their block in each ordering."""
    asked = queries.select(F.col("class").alias("_class")).distinct()
    both = classes.select("class", "vec", F.lit(0).alias("kind")).unionAll(
        classes.join(asked, F.col("class") == F.col("_class"), "left_semi").select("class", "vec", F.lit(1).alias("kind"))
    )
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    longest = classes.agg(F.max(length)).collect()[0][0] or 1.0

    def place(batches):
        for batch in batches:
            vectors, kind = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            if not len(vectors):
                continue
            lengths = np.linalg.norm(vectors, axis=1)
            scaled = np.where(kind[:, None] == 1, vectors * (longest / lengths)[:, None], vectors)
            lift = np.where(kind == 1, 0, np.sqrt(np.maximum(longest**2 - lengths**2, 0)))
            for ordering in range(ORDERINGS):
                keys = curve_keys(scaled, lift, longest, ordering)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(len(keys), ordering, np.int32)), pa.array(keys)], names=[*batch.schema.names, "ordering", "key"]
                )

    keyed = both.mapInArrow(place, "class bigint, vec array<double>, kind int, ordering int, key bigint")
    order = [F.col("ordering"), F.col("key"), F.col("class"), F.col("kind")]
    ranked = with_rank(numbered(keyed, order, "curves"), "ordering")
    return written(ranked.select("class", "vec", "kind", "ordering", F.floor(F.col("rank") / BLOCK).cast("int").alias("block")), "blocks")


def _best(scores: np.ndarray, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k + 1 largest scores: classes and scores. The smaller class comes first among equals at the edge."""
    n = scores.shape[1]
    if n > k + 1:
        at = np.argpartition(-scores, k, axis=1)[:, : k + 1]
        edge = np.take_along_axis(scores, at, 1).min(1)
        for row in np.flatnonzero((scores >= edge[:, None]).sum(1) > k + 1):
            at[row] = np.lexsort((classes, -scores[row]))[: k + 1]
    else:
        at = np.broadcast_to(np.arange(n), scores.shape)
    return classes[at], np.take_along_axis(scores, at, 1)


def _found(asked: np.ndarray, classes: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(asked, classes.shape[1])), pa.array(classes.ravel()), pa.array(scores.ravel())], names=["asked", "class", "score"]
    )


FOUND = "asked bigint, class bigint, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    """Best k + 1 classes of each query, counted once. Scores of one pair differ in the last bit at most."""
    once = found.groupBy("asked", "class").agg(F.max("score").alias("score"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "class")
    return once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")


def _truth(blocks: DataFrame, k: int) -> DataFrame:
    """True neighbours (asked, class) of the sampled queries, by brute force over all vectors."""
    spark = blocks.sparkSession
    one = blocks.filter("ordering = 0")
    sample = one.filter("kind = 1").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("class", "vec").collect()
    ids, matrix = np.asarray([r["class"] for r in sample], np.int64), np.asarray([r["vec"] for r in sample], float)
    shared = spark.sparkContext.broadcast((ids, matrix))

    def compare(batches):
        ids, matrix = shared.value
        for batch in batches:
            if batch.num_rows and len(ids):
                yield _found(ids, *_best(matrix @ _matrix(batch.column(1)).T, batch.column(0).to_numpy(), k))

    return _top(one.filter("kind = 0").select("class", "vec").mapInArrow(compare, FOUND), k)


def fit_width(blocks: DataFrame, k: int, recall: float) -> int:
    """Smallest width in blocks that finds the wanted share of the sampled queries' true neighbours."""
    truth = _truth(blocks, k)
    own = blocks.filter("kind = 1").select(F.col("class").alias("asked"), "ordering", F.col("block").alias("own"))
    places = blocks.filter("kind = 0").select("class", "ordering", "block")
    apart = truth.join(own, "asked").join(places, ["class", "ordering"]).groupBy("asked", "class").agg(
        F.min(F.abs(F.col("block") - F.col("own"))).alias("apart")
    ).groupBy("apart").count().orderBy("apart").collect()  # a row per distance in blocks, of at most SAMPLE * (k + 1) pairs
    total, done = sum(r["count"] for r in apart), 0
    for row in apart:
        done += row["count"]
        if done >= recall * total:
            return row["apart"]
    return 0


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of batches whose first ``keys`` columns agree."""
    for batch in batches:
        if batch.num_rows:
            columns = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)], 1)
            cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield tuple(columns[a]), batch.slice(a, b - a)


class _Asked:
    """Queries that meet a span of blocks, and the best candidates seen so far."""

    def __init__(self, k: int):
        self.k, self.names, self.blocks, self.parts, self.matrix = k, [], [], [], None

    def add(self, block: int, names: np.ndarray, vectors: np.ndarray) -> None:
        self.names.append(names)
        self.blocks.append(np.full(len(names), block))
        self.parts.append(vectors)

    def meet(self, block: int, width: int, classes: np.ndarray, vectors: np.ndarray) -> None:
        if not self.names:
            return
        if self.matrix is None:
            self.matrix, self.at = np.concatenate(self.parts), np.concatenate(self.blocks)
            self.found = np.full((len(self.matrix), self.k + 1), -1, np.int64)
            self.scores = np.full(self.found.shape, -np.inf)
        near = np.flatnonzero(np.abs(self.at - block) <= width)
        for rows in np.array_split(near, -(-len(near) // 1024)) if len(near) else []:
            best, scores = _best(self.matrix[rows] @ vectors.T, classes, self.k)
            best, scores = np.concatenate((self.found[rows], best), 1), np.concatenate((self.scores[rows], scores), 1)
            order = np.lexsort((best, -scores), axis=1)[:, : self.k + 1]
            self.found[rows], self.scores[rows] = np.take_along_axis(best, order, 1), np.take_along_axis(scores, order, 1)

    def result(self) -> pa.RecordBatch | None:
        if self.matrix is None:
            return None
        asked = np.repeat(np.concatenate(self.names), self.k + 1)
        held = self.found.ravel() >= 0
        return pa.RecordBatch.from_arrays(
            [pa.array(asked[held]), pa.array(self.found.ravel()[held]), pa.array(self.scores.ravel()[held])], names=["asked", "class", "score"]
        )


def window_candidates(blocks: DataFrame, width: int, k: int) -> DataFrame:
    """Best candidates (asked, class, score) of each query in its windows.

    A task takes a span of neighbouring blocks, about as long as a window, and a share of the queries whose windows
    reach into it. It keeps those queries and their best candidates and reads the blocks one after the other, so a
    query gives k + 1 rows for each span it meets, not for each block.
    """
    span = min(2 * width + 1, SPAN_BLOCKS)
    asked = blocks.filter("kind = 1").select("ordering", "block", "kind", "class", "vec")
    met = F.sequence(F.floor((F.col("block") - width) / span), F.floor((F.col("block") + width) / span))
    most = asked.select("ordering", F.explode(met).alias("span")).groupBy("ordering", "span").count().agg(F.max("count")).collect()[0][0] or 0
    salts = max(1, -(-most // QUERIES))
    queries = asked.withColumn("span", F.explode(met)).withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(salts)).cast("int"))
    offered = blocks.filter("kind = 0").select(
        "ordering", "block", "kind", "class", "vec", F.floor(F.col("block") / span).alias("span"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    group = ["ordering", "span", "salt"]
    both = queries.unionByName(offered).withColumn("offered", 1 - F.col("kind")).select(*group, "offered", "block", "class", "vec")
    dealt = both.repartition(*group).sortWithinPartitions(*group, "offered", "block")

    def compare(batches):
        current, held = None, _Asked(k)
        for (*key, is_offered, block), run in _runs(batches, 5):
            if key != current:
                if (found := held.result()) is not None:
                    yield found
                current, held = key, _Asked(k)
            names, vectors = run.column(5).to_numpy(), _matrix(run.column(6))
            if is_offered:
                held.meet(block, width, names, vectors)
            else:
                held.add(block, names, vectors)
        if (found := held.result()) is not None:
            yield found

    return dealt.mapInArrow(compare, FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for every query."""
    classes, queries = _classes(vectors, is_query, k)
    blocks = _ordered(classes, queries)
    width = fit_width(blocks, k, recall)
    found = written(_top(window_candidates(blocks, width, k), k), "neighbours")
    listed = found.join(classes.select("class", "ids"), "class").select("asked", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    # k + 1 rows for each distinct query: one of them may be the query itself.
    short = listed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")
    met = queries.join(short, queries["class"] == short["asked"]).filter(F.col("query_id") != F.col("vec_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
