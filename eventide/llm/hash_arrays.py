"""Sorted hash arrays: counts by 64-bit hash, gathered in Spark, kept as binary files and memory-mapped by workers.

Tasks count what they read, cut their sorted hashes into slices by the top bits and send each slice on as one packed
row; Spark deals the rows out by slice, and whoever holds a slice merges it and writes one file of arrays. Hashes are evenly
spread, so slices are even whatever the keys are, and a key met often crosses the network once per task and not once per use.

A file is named by the task attempt that wrote it and counts only once the manifest, which Spark commits, names it. Where the
shared folder is a path of the worker's own file system the files are mapped there; from any other store a file is
fetched into an unlinked temporary file first. Mapped pages belong to the system's file cache, not to the worker.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame

from .common import written

SLICE_BYTES = 128 * 1024 * 1024  # of text for each slice of hashes
LEAST_SLICES = 64
HELD = 1 << 21  # entries that a task counts before it sends them on
PACKED = "slice int, packed binary"
# Multipliers of a widely used 64-bit finaliser, which maps hashes one to one.
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_BACK1, _BACK2 = (np.uint64(pow(m, -1, 1 << 64)) for m in (_M1, _M2))


def slice_bits(text_bytes: int) -> int:
    """Number of top bits that tell slices apart, in proportion to the input."""
    return (max(LEAST_SLICES, -(-text_bytes // SLICE_BYTES)) - 1).bit_length()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly; every result has one origin."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * _BACK2
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _BACK1
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


_RADIX = 0x9E3779B97F4A7C15  # odd, so that it can be divided by
_POWERS: list[np.ndarray] = []


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of many spans of one sequence of 64-bit values: polynomials from running sums, spread by ``mix``."""
    if not _POWERS or len(_POWERS[0]) < len(values):
        n = 1 << max(16, (len(values) - 1).bit_length())
        radix = (_RADIX, pow(_RADIX, -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, r, np.uint64)], dtype=np.uint64) for r in radix]
    power, back = _POWERS
    running = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=running[1:])
    return mix((running[end] - running[begin]) * back[begin] + (end - begin).astype(np.uint64))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, keys.size]).astype(np.uint64)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their rows of ``values`` (one row per key, one column per number)."""
    if not keys.size:
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values, first, axis=0)


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight together: the high ones of small numbers are zeros and compress to nothing."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys as differences, and their numbers column by column."""
    step = np.diff(keys, prepend=np.uint64(0))
    parts = [_planes(step), *(_planes(values[:, k]) for k in range(values.shape[1]))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(keys).to_bytes(8, "little"), *parts]))


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:8], "little")
    columns = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, 8, n).transpose(0, 2, 1)
    columns = np.ascontiguousarray(columns).view("<u8")[:, :, 0]
    return np.cumsum(columns[0], dtype=np.uint64), columns[1:].T


def packed_slices(keys: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row per slice that the sorted hashes touch."""
    of = (keys >> np.uint64(64 - bits)).astype(np.int64)
    bounds = np.searchsorted(of, np.arange((1 << bits) + 1))
    some = np.flatnonzero(np.diff(bounds))
    packed = [pack(keys[bounds[s] : bounds[s + 1]], values[bounds[s] : bounds[s + 1]]) for s in some.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "packed"])


class Tally:
    """Counts by hash with bounded memory: what has grown too large is sent on and met again by the merge."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.size = bits, [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, n[:, None]))
        self.size += len(keys)
        if self.size >= 2 * HELD:
            self._settle()
            if self.size >= HELD:
                yield from self.rest()

    def _settle(self) -> None:
        self.parts = [summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([v for _, v in self.parts]))]
        self.size = len(self.parts[0][0])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._settle()
            yield packed_slices(*self.parts[0], self.bits)
        self.parts, self.size = [], 0


@dataclass(frozen=True)
class Files:
    """Names and lengths of the files of one kind, by slice; a slice without entries has no file."""

    folder: str
    names: dict[int, str]
    sizes: dict[int, int]


def write_arrays(folder: str, arrays: Iterable[np.ndarray]) -> str:
    """A new file with the arrays one after the other; its name."""
    files, root = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    with files.open_output_stream(f"{root}/{name}") as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
    return name


def merge_slices(
    packed: DataFrame, folder: str, write: Callable[[int, np.ndarray, np.ndarray], tuple[list[np.ndarray], list[int]]], numbers: list[str], name: str
) -> tuple[Files, list[dict]]:
    """Merge the packed rows of each slice, let ``write`` say which arrays its file holds and what the manifest notes.

    ``write`` gets slice, keys and sums, and returns the arrays and one number for each of ``numbers``, of which the
    first is the length of the arrays. Returns the files and the manifest: one small row per slice.
    """
    def merge(table: pa.Table) -> pa.Table:
        of = table.column("slice")[0].as_py()
        parts = [unpack(p) for p in table.column("packed").to_pylist()]
        arrays, noted = write(of, *summed(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])))
        row = {"slice": [of], "file": [write_arrays(folder, arrays)], **{k: [int(v)] for k, v in zip(numbers, noted)}}
        return pa.table(row, schema=pa.schema([("slice", pa.int32()), ("file", pa.string()), *((k, pa.int64()) for k in numbers)]))

    manifest = written(packed.groupBy("slice").applyInArrow(merge, ", ".join(["slice int, file string", *(f"{k} bigint" for k in numbers)])), name)
    rows = [r.asDict() for r in manifest.orderBy("slice").collect()]
    return Files(folder, {r["slice"]: r["file"] for r in rows}, {r["slice"]: r[numbers[0]] for r in rows}), rows


_MAPPED: dict[tuple[str, str], np.ndarray] = {}


def mapped(folder: str, name: str) -> np.ndarray:
    """The bytes of a file, memory-mapped; maps of another model are given up."""
    if (folder, name) not in _MAPPED:
        parent = folder.rsplit("/", 1)[0]
        for key in [k for k in _MAPPED if k[0].rsplit("/", 1)[0] != parent]:
            del _MAPPED[key]
        place = urlparse(folder)
        local = f"{place.path}/{name}" if place.scheme in ("", "file") else ""
        if local and os.path.exists(local):
            _MAPPED[folder, name] = np.memmap(local, np.uint8, "r")
        else:
            files, root = pa.fs.FileSystem.from_uri(folder)
            with tempfile.TemporaryFile() as copy, files.open_input_stream(f"{root}/{name}") as source:
                while chunk := source.read(1 << 22):
                    copy.write(chunk)
                copy.flush()
                _MAPPED[folder, name] = np.memmap(copy, np.uint8, "r")
    return _MAPPED[folder, name]


def columns_of(files: Files, of: int, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of one slice, as views of the mapped file."""
    n, raw, at, found = files.sizes[of], mapped(files.folder, files.names[of]), 0, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        found.append(raw[at : at + size].view(kind))
        at += size
    return found


def find(files: Files, bits: int, asked: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slice, positions among ``asked``, positions in the slice) of the sorted hashes that the files hold."""
    bounds = np.searchsorted(asked, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    bounds = np.r_[0, bounds, len(asked)]
    for of in np.flatnonzero(np.diff(bounds)).tolist():
        if files.sizes.get(of):
            (keys,) = columns_of(files, of, ["<u8"])
            own = asked[bounds[of] : bounds[of + 1]]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == own)
            yield of, hit + bounds[of], at[hit]
