"""Packing of tokenized documents into sequences of a fixed length, planned by non-negative least squares.

Every document is cut into whole windows and one rest, so only the number of pieces of each length matters. All ways to
fill a window exactly with at most three pieces are enumerated; least squares with non-negative repeat counts fits
them to the histogram of lengths. Counts are rounded down to what the histogram holds, and the pieces left over are
packed greedily, longest first with the longest that still fits. The plan depends on the histogram alone (at most one
row per length), so it is solved on the driver and sent to all tasks; pieces find their place by their rank among those
of the same length.

Nulls: a null text counts as empty, a null doc_id stays null. Repeated rows are packed separately. No documents, no
sequences. A very long text gives many windows; it is encoded in parts of a bounded length. Pieces of equal length take
their places in order of document id and start; those of repeated rows are alike. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import numbered, with_rank, written
from .tokenizing import BpeEncoder, loaded

PIECES = "doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint"
STEPS = 400


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: whole windows from the start, then the rest; ``ids`` (binary, 32-bit) if asked for."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    end, step = np.asarray([end_id], "<u4").tobytes(), 4 * window

    def cut(batches):
        encoder = loaded(BpeEncoder, tokenizer)
        for batch in batches:
            found = []
            texts = (cell.as_py() for cell in batch.column(1))
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encoder.encode_many(texts)):
                ids = encoded.astype("<u4").tobytes() + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    row = (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                    found.append((*row, piece) if with_ids else row)
            columns = list(zip(*found)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.mapInArrow(cut, schema)


def fillings(window: int, lengths: np.ndarray) -> np.ndarray:
    """All ways to fill the window exactly with one, two or three of the lengths, as rows of lengths padded with 0."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    single = [[window, 0, 0]] if have[window] else []
    a = np.arange(1, window // 2 + 1)
    a = a[have[a] & have[window - a]]
    pairs = np.stack([window - a, a, np.zeros_like(a)], 1)
    b, c = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    b, c = b[b >= c], c[b >= c]
    rest = window - b - c
    keep = rest >= b
    b, c, rest = b[keep], c[keep], rest[keep]
    keep = have[b] & have[c] & have[rest]
    triples = np.stack([rest[keep], b[keep], c[keep]], 1)
    return np.concatenate([np.asarray(single, np.int64).reshape(-1, 3), pairs, triples])


def repeat_counts(ways: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: counts x with uses(x) close to the histogram."""
    if not len(ways):
        return np.zeros(0)
    flat, size = ways.ravel(), len(histogram)

    def uses(x: np.ndarray) -> np.ndarray:
        used = np.bincount(flat, np.repeat(x, 3), size)
        used[0] = 0
        return used

    def back(residual: np.ndarray) -> np.ndarray:
        return residual[ways].sum(1)

    vector = np.ones(len(ways))
    for _ in range(20):  # largest eigenvalue by power iteration
        vector = back(uses(vector))
        norm = np.linalg.norm(vector)
        vector /= norm
    target = histogram.astype(float)
    target[0] = 0
    x = ahead = np.zeros(len(ways))
    momentum = 1.0
    for _ in range(STEPS):
        gradient = back(uses(ahead) - target)
        following = np.maximum(0, ahead - gradient / (1.05 * norm))
        next_momentum = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = following + (momentum - 1) / next_momentum * (following - x)
        x, momentum = following, next_momentum
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) using every piece of the histogram exactly once."""
    left = [int(n) for n in histogram]
    chosen: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], most: int | None = None) -> int:
        times = min(left[n] // lengths.count(n) for n in set(lengths))
        times = times if most is None else min(times, most)
        if times > 0:
            for n in lengths:
                left[n] -= times
            chosen.append((lengths, times))
        return times

    use((window,))
    ways = fillings(window, np.flatnonzero(left))
    x = repeat_counts(ways, np.asarray(left))
    for k in np.argsort(-x, kind="stable"):
        if x[k] + 1e-6 < 1:
            break
        use(tuple(int(n) for n in ways[k] if n), int(x[k] + 1e-6))
    while any(left):
        taken: list[int] = []
        space, longest = window, window
        while True:
            longest = next((n for n in range(min(space, longest), 0, -1) if left[n] > taken.count(n)), 0)
            if not longest:
                break
            taken.append(longest)
            space -= longest
        use(tuple(taken))
    return chosen


def places(chosen: list[tuple[tuple[int, ...], int]], window: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: last rank + 1, first sequence and offset of each run of places, in rank order."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in chosen:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((times, sequence, offset))
            offset += n
        sequence += times
    return {
        n: (np.cumsum([r[0] for r in found]), np.asarray([r[1] for r in found]), np.asarray([r[2] for r in found]))
        for n, found in runs.items()
    }


def pack(pieces: DataFrame, window: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with doc_id, start and length; other columns stay."""
    spark = pieces.sparkSession
    # Ranges are sampled, which reads the pieces twice: they are written first, so that texts are encoded once.
    ordered = numbered(written(pieces, "cut-pieces"), [F.col("length"), F.col("doc_id"), F.col("start")], "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for row in ordered.groupBy("length").count().collect():  # one row per length, at most ``window``
        histogram[row["length"]] = row["count"]
    found = spark.sparkContext.broadcast(places(plan(histogram, window), window))
    ranked = with_rank(ordered, "length").drop("part", "pos")
    kept = [c for c in ranked.columns if c != "rank"]
    at_length, at_rank = kept.index("length"), ranked.columns.index("rank")

    def place(batches):
        for batch in batches:
            lengths = batch.column(at_length).to_numpy(zero_copy_only=False)
            ranks = batch.column(at_rank).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                ends, first, at = found.value[int(n)]
                run = np.searchsorted(ends, ranks[rows], "right")
                before = np.where(run > 0, ends[run - 1], 0)
                sequence[rows], offset[rows] = first[run] + ranks[rows] - before, at[run]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 1024, with_ids: bool = False) -> DataFrame:
    return pack(cut_pieces(docs, tokenizer, end_id, window, with_ids), window)


def sequences(packed: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary, 32-bit) and n_ids before padding.

    A sequence is padded to the window unless its length is a power of two. Needs pieces ``with_ids``.
    """
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    n = F.expr("cast(aggregate(pieces, 0L, (n, p) -> n + octet_length(p.ids)) div 4 as bigint)")
    body = F.expr("aggregate(pieces, cast('' as binary), (all, p) -> concat(all, p.ids))")
    pad = F.expr(f"unhex(repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({window} - n_ids as int)))")
    filled = joined.select("sequence_id", body.alias("ids"), n.alias("n_ids"))
    power = F.expr("(n_ids & (n_ids - 1)) = 0")
    return filled.withColumn("ids", F.when(power, F.col("ids")).otherwise(F.concat("ids", pad)))
