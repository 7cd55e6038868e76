"""Near-duplicates by SimHash: fingerprints of word shingles, linked within a few differing bits.

A fingerprint bit is set if more than half of the shingle hashes (XXH64 of the UTF-8 bytes, seed 42) set it. Two
64-bit fingerprints that differ in at most r bits agree on two whole parts when cut into r + 2, so fingerprints meet by
every pair of parts. Those that share such a key are compared bit-sliced: one long integer per bit position holds
that bit of all of them, a copy shifted by k lanes is compared with it, differing bits are added up in carry-save
counters that overflow beyond the radius, and a shift is given up once every lane has overflowed. Keys held by very
many fingerprints are dealt into blocks and compared block by block. Each comparison passes on a spanning
forest of its links, never all pairs.

Nulls: a null text has no words (fingerprint zero, linked like any other); a null doc_id is linked too, and is its own
component id only if nothing with an id is reachable. Repeated rows stay. An empty table gives an empty result. Very long
texts are read whole, one at a time. Other columns, whatever their names, are left out, and kept by ``one_of_each``.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from .common import free_names, written
from .components import components

BITS = 64
SEED = 42
BLOCK = 2048  # fingerprints of one key in a block; a task compares two blocks at a time
LANES = 1 << 16
SHORT_RUN = 64
HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), HASHES):
        block = hashes[at : at + HASHES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key (content hash) and fp, the fingerprint as a signed 64-bit integer."""

    def work(batches):
        for batch in batches:
            found = np.asarray([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key().alias("key"), "text")
    return rows.mapInArrow(work, "doc_id bigint, key bigint, fp bigint")


def _as_integer(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _lanes(mask: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little"))


def bit_planes(values: np.ndarray) -> list[int]:
    """One integer per bit position; lane i is bit i."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [_as_integer(np.ascontiguousarray(bits[:, b])) for b in range(BITS)]


def within(planes: list[int], shift: int, lanes: int, radius: int) -> int:
    """Of the given lanes i, those whose value differs from lane i + shift in at most ``radius`` bits."""
    width = radius.bit_length()
    preset = (1 << width) - 1 - radius
    counters = [lanes if preset >> j & 1 else 0 for j in range(width)]
    alive = lanes
    for plane in planes:
        carry = (plane ^ (plane >> shift)) & alive
        for j in range(width):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        alive &= ~carry
        if not alive:
            break
    return alive


def forest(values: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between values of one run; ``runs`` (run numbers) is sorted."""
    n = len(values)
    roots = np.arange(n)
    left, right = [], []
    planes = bit_planes(values)
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    longest = int(np.diff(np.r_[starts, n]).max()) if n else 0
    parts, one_run = n, len(starts) == 1
    for shift in range(1, longest):
        same = runs[shift:] == runs[:-shift]
        found = _lanes(within(planes, shift, _as_integer(same), radius), n)
        fresh = found[roots[found] != roots[found + shift]]
        for i in fresh.tolist():
            a, b = i, i + shift
            while roots[a] != a:
                a = roots[a]
            while roots[b] != b:
                b = roots[b]
            if a != b:
                roots[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + shift)
                parts -= 1
        if len(fresh):
            while (roots[roots] != roots).any():
                roots = roots[roots]
        if one_run and parts == 1:
            break
    return np.asarray(left, np.int64), np.asarray(right, np.int64)


def links(values: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within the radius."""
    parts = radius + 2
    edges = [round(BITS * k / parts) for k in range(parts + 1)]
    cut = [
        F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in zip(edges, edges[1:])
    ]
    keys = [
        F.struct(F.lit(t).alias("t"), F.shiftleft(cut[i], edges[j + 1] - edges[j]).bitwiseOR(cut[j]).alias("key"))
        for t, (i, j) in enumerate(combinations(range(parts), 2))
    ]
    spread = values.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    shared = spread.groupBy("t", "key").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    met = spread.join(shared, ["t", "key"]).select("t", "key", "fp", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own"))
    )
    dealt = met.withColumn("own", own).select("t", "key", "fp", "own", F.explode(other).alias("other"))
    group = ["t", "key", "g", "h"]
    grouped = dealt.select("t", "key", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "fp")
    ordered = grouped.repartition(*group).sortWithinPartitions(*group)

    def compare(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def pairs(columns: np.ndarray, fps: np.ndarray):
            new = np.r_[True, (columns[1:] != columns[:-1]).any(1)]
            runs = np.cumsum(new)
            lengths = np.bincount(runs)[runs]
            short = lengths <= SHORT_RUN
            found = [(fps[short], *forest(fps[short], runs[short], radius))] if short.any() else []
            for run in np.unique(runs[~short]):
                own = fps[runs == run]
                found.append((own, *forest(own, np.zeros(len(own), int), radius)))
            a = np.concatenate([v[i] for v, i, _ in found])
            b = np.concatenate([v[j] for v, _, j in found])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def merged():
            return np.concatenate([c for c, _ in held]), np.concatenate([f for _, f in held])

        for batch in batches:
            columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], 1)
            held.append((columns, batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            size += batch.num_rows
            if size >= LANES:
                columns, fps = merged()
                ends = np.flatnonzero((columns[1:] != columns[:-1]).any(1))
                if len(ends):
                    whole = ends[-1] + 1
                    yield pairs(columns[:whole], fps[:whole])
                    columns, fps = columns[whole:], fps[whole:]
                held, size = [(columns, fps)], len(fps)
        if size:
            yield pairs(*merged())

    return ordered.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """doc_id, key, fp, label (of the component) and component_id (the smallest doc_id reachable) of every row."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = written(components(links(classes.select("fp"), radius)), "labels")
    joined = classes.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    firsts = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    found = joined.join(firsts, "label").select("fp", "label", "component_id")
    return prints.join(found, "fp").select("doc_id", "key", "fp", "label", "component_id")


def hexadecimal(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, then of the smallest content hash.

    Rows without an id come last. Of repeated rows one stays. Columns stay, whatever their names.
    """
    found = near_duplicates(docs, shingle, radius)
    chosen = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    key, number, kept_id, kept_key = free_names(docs, "_key", "_n", "_d", "_k")
    kept = chosen.select(F.col("first.doc_id").alias(kept_id), F.col("first.key").alias(kept_key)).distinct()
    keyed = docs.withColumn(key, _key())
    rows = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    repeats = Window.partitionBy("doc_id", key).orderBy(key)
    return rows.withColumn(number, F.row_number().over(repeats)).filter(F.col(number) == 1).drop(number, key)
