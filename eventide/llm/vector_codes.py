"""Vector codes by product quantisation with whole numbers, nearest entries found by slicing and intersecting bit masks.

Vectors become whole numbers and are cut into equal parts. Each part position has a codebook; rounds of assignment and
floored means refine it. The nearest entry of a part is found exactly: per dimension the entries' coordinates are sorted,
and a mask of the entries (one bit each, in 64-bit words) is kept for every prefix of that order. A radius selects a range
in each dimension by binary search, the range's mask is the difference of two prefix masks, and the masks of all dimensions
ANDed leave the entries inside a box around the part. No entry outside is as near as the radius, so if the nearest inside
is, it is the answer; otherwise the radius grows to that distance (or doubles, if the box is empty) and the box is cut again.
The first radius is typical of the codebook: a quarter more than the median over its entries of the distance to the next other
one, so that most parts need one box. Distances
are whole numbers, ties go to the lower index, so results depend on neither batches nor radii.

Codebooks start as the vectors with the smallest ids and are the only thing that is collected: entries times dimensions.

Nulls: null vectors and those with a null or non-finite component take no part; a null id sorts last, null labels count as
one label. Repeated rows count each time; rows with equal ids start codebooks in the order of their vectors. With fewer rows than
entries codebooks are shorter; without rows there is no result. Vectors of unequal length are filled up with zeros, also to a
multiple of the parts. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small, written
from .vectors import matrix, whole_vectors

ROWS_AT_ONCE = 4096
DENSE = 1 / 8  # share of the entries left by the masks from which one matrix product costs less than single distances
EXACT = float(1 << 53)  # whole numbers below are exact as float64


@dataclass
class Boxes:
    """The entries of one codebook, and for each dimension their sorted coordinates and the masks of its prefixes."""

    entries: np.ndarray
    coordinates: np.ndarray
    prefixes: np.ndarray
    radius: int

    @classmethod
    def of(cls, entries: np.ndarray) -> Boxes:
        n, width = entries.shape
        words = -(-n // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        bit = np.zeros((n, words), np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        prefixes = np.zeros((width, n + 1, words), np.uint64)
        for d in range(width):
            prefixes[d, 1:] = np.bitwise_or.accumulate(bit[order[:, d]], axis=0)
        ways = [np.delete(np.square(entries - e).sum(1), i).min() for i, e in enumerate(entries)] if n > 1 and width else [0]
        return cls(entries, np.ascontiguousarray(np.sort(entries, axis=0).T), prefixes, int(1.25 * np.median(np.sqrt(ways))))

    def inside(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries no farther than the radius in any dimension, for each row."""
        left = np.broadcast_to(self.prefixes[0, -1], (len(x), self.prefixes.shape[2])).copy()
        for d, (coordinates, prefix) in enumerate(zip(self.coordinates, self.prefixes)):
            low = np.searchsorted(coordinates, x[:, d] - radius, "left")
            high = np.searchsorted(coordinates, x[:, d] + radius, "right")
            left &= prefix[high] & ~prefix[low]
        return left

    def _best(self, x: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest index of the nearest entry in each row's mask, and the squared distance; every mask has an entry."""
        n = len(self.entries)
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, count=n, bitorder="little").astype(bool)
        if bits.sum() > DENSE * bits.size:
            most = max(int(np.abs(x).max()), int(np.abs(self.entries).max()), 1)
            kind = np.float64 if 4.0 * most * most * x.shape[1] < EXACT else np.int64
            a, b = x.astype(kind), self.entries.astype(kind)
            far = ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
            far[~bits] = np.iinfo(np.int64).max
            best = far.argmin(1)
            return best, far[np.arange(len(x)), best]
        row, entry = np.nonzero(bits)
        far = np.square(x[row] - self.entries[entry]).sum(1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(far, first)
        ties = np.flatnonzero(far == least[row])
        return entry[ties[np.searchsorted(row[ties], np.arange(len(x)))]], least

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, and the squared distance."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        index, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        open_, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while open_.size:
            masks = self.inside(x[open_], radius)
            some = masks.any(1)
            rows = open_[some]
            if rows.size:
                index[rows], far[rows] = self._best(x[rows], masks[some])
            done = some & (far[open_] <= radius * radius)
            # Rounded up, so that an entry at exactly the found distance lies inside the next box.
            radius = np.where(some, np.sqrt(far[open_].astype(float)).astype(np.int64) + 1, 2 * radius + 1)[~done]
            open_ = open_[~done]
        return index, far


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, position): vectors cut into equal parts."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width).transpose(1, 0, 2)


def _assigned(x: np.ndarray, boxes: list[Boxes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut vectors, their entries and squared distances, each by part and row, of a bounded number of rows."""
    cut = _parts(x, len(boxes))
    found = [b.nearest(part) for b, part in zip(boxes, cut)]
    return cut, np.stack([f[0] for f in found]), np.stack([f[1] for f in found])


def _refined(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (part, entry, position) with each used entry replaced by the floored mean of its parts."""
    parts, entries, width = books.shape
    names = [f"s{k}" for k in range(width)]

    def add(batches):
        boxes = [Boxes.of(b) for b in books]
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                cut, index, _ = _assigned(matrix(batch.column(0).slice(at, ROWS_AT_ONCE)), boxes)
                of = (index + np.arange(parts)[:, None] * entries).ravel()
                flat = cut.reshape(len(of), width)
                order = np.argsort(of, kind="stable")
                first = np.flatnonzero(np.diff(of[order], prepend=-1))
                sums[of[order][first]] += np.add.reduceat(flat[order], first, axis=0)
                counts += np.bincount(of, minlength=parts * entries)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(counts[used]), *(pa.array(sums[used, k]) for k in range(width))], names=["entry", "n", *names]
        )

    partial = table.select("x").mapInArrow(add, ", ".join(f"{c} bigint" for c in ["entry", "n", *names]))
    total = partial.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ["n", *names]])
    result = books.reshape(parts * entries, width).copy()
    for row in total.collect():  # at most one row per entry
        result[row["entry"]] = [row[c] // row["n"] for c in names]
    return result.reshape(books.shape)


def compress(
    vectors: DataFrame, column: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """key, code (two hex digits per part), error, label_error (of all rows with the label) and codebooks_sha256 of every kept row."""
    if entries > 256:
        raise ValueError("a code has one byte per part")
    chosen = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(column).alias("vector"))
    table = written(whole_vectors(chosen, "vector", scale).drop("vector"), "whole-vectors")
    first = table.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).toArrow()
    outcome = "code string, error bigint"
    if first.num_rows:
        books = np.ascontiguousarray(_parts(matrix(first.column("x").combine_chunks()), parts))
        for _ in range(rounds):
            books = _refined(table, books)
    else:
        books = np.zeros((parts, 0, 0), np.int64)

    def encode(batches):
        boxes = [Boxes.of(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                _, index, far = _assigned(matrix(some.column(2)), boxes)
                digits = index.T.astype(np.uint8).tobytes().hex()
                codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(codes, pa.string()), pa.array(far.sum(0))], names=["id", "label", "code", "error"]
                )

    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    coded = written(table.select("id", "label", "x").mapInArrow(encode, f"{kinds}, {outcome}"), "vector-codes")
    by_label = small(written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"])).select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
