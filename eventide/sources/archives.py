"""Zipped bar files as a Spark data source.

``spark.read.format("kline_archives").option("path", folder).load()`` has a row for every line of every archive: path, symbol,
month, line_no, line. An archive is one partition, since zip cannot be split, and is inflated as a stream: a task
holds a batch of lines, not the archive. Symbol and month stand in the file name (``ABCUSDT-1m-2024-01.zip``, or with a day), so
tests on them choose files while the query is planned, and other archives are not opened.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual,
)

FORMAT = "kline_archives"
SCHEMA = "path string, symbol string, month string, line_no bigint, line string"
LINES_PER_BATCH = 20_000
_MONTH = re.compile(r"-(\d{4}-\d{2})(?:-\d{2})?\.zip$")
_TESTS = {
    EqualTo: lambda own, value: own == value, EqualNullSafe: lambda own, value: own == value, In: lambda own, value: own in value,
    GreaterThan: lambda own, value: own > value, GreaterThanOrEqual: lambda own, value: own >= value,
    LessThan: lambda own, value: own < value, LessThanOrEqual: lambda own, value: own <= value,
}


def symbol_of(name: str) -> str:
    """Symbol from a file name, trimmed and in upper case."""
    return name.rsplit("/", 1)[-1].split("-")[0].strip().upper()


def month_of(name: str) -> str | None:
    """Month (yyyy-MM) from a file name, None if it names none."""
    found = _MONTH.search(name)
    return found[1] if found else None


@dataclass
class Archive(InputPartition):
    path: str
    symbol: str
    month: str | None


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.wanted = folder.rstrip("/"), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Tests on symbol and month are answered by the file names alone; all others are left to Spark."""
        for test in filters:
            if type(test) in _TESTS and test.attribute in (("symbol",), ("month",)) and test.value is not None:
                self.wanted.append((test.attribute[0], type(test), test.value))
            else:
                yield test

    def partitions(self) -> list[Archive]:
        files, root = pa.fs.FileSystem.from_uri(self.folder) if ":" in self.folder else (pa.fs.LocalFileSystem(), self.folder)
        found = []
        for file in files.get_file_info(pa.fs.FileSelector(root)):
            if file.is_file and file.base_name.endswith(".zip"):
                archive = Archive(f"{self.folder}/{file.base_name}", symbol_of(file.base_name), month_of(file.base_name))
                # As in SQL, a test on a month that is not there is not passed.
                if all(getattr(archive, c) is not None and _TESTS[kind](getattr(archive, c), value) for c, kind, value in self.wanted):
                    found.append(archive)
        return sorted(found, key=lambda a: a.path)

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive is wanted
            return
        files, path = pa.fs.FileSystem.from_uri(partition.path) if ":" in partition.path else (pa.fs.LocalFileSystem(), partition.path)
        with files.open_input_file(path) as source, zipfile.ZipFile(source) as archive, archive.open(archive.namelist()[0]) as member:
            lines, first = [], 0
            for raw in member:
                lines.append(raw.decode("utf-8").rstrip("\r\n"))
                if len(lines) == LINES_PER_BATCH:
                    yield _batch(partition, first, lines)
                    first, lines = first + len(lines), []
            if lines:
                yield _batch(partition, first, lines)


def _batch(archive: Archive, first: int, lines: list[str]) -> pa.RecordBatch:
    same = [pa.array([value] * len(lines), pa.string()) for value in (archive.path, archive.symbol, archive.month)]
    return pa.RecordBatch.from_arrays(
        [*same, pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.string())],
        names=["path", "symbol", "month", "line_no", "line"],
    )


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark
