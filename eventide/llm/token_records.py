"""Token ids of documents in length-delimited binary shards, with an offset index beside them.

A shard starts with ``MAGIC``. Each record is: payload length (unsigned 64-bit), masked checksum of those eight bytes
(unsigned 32-bit), payload, masked checksum of the payload; all little-endian. The checksum is CRC-32, rotated right
by 15 bits plus a constant, so that a checksum stored inside a payload does not look like its own. A payload is one
flag byte (1: ids of 16 bits, 0: of 32; 2 added: the document id is null), the document id (signed 64-bit), the number
of ids (unsigned 32-bit) and the ids as a zstd frame.

The index is a Parquet table with a row per record, in document order inside each part: a reader may shuffle or pick
index rows and read just those records. Shards get names of their own per task attempt and count only once the index,
which Spark commits task by task, names them; what a lost attempt left is never read.

Nulls: a null text counts as empty (only the end id); a null doc_id sorts first and stays null. Repeated rows are
records of their own, ordered by document id and a hash of the text. An empty table gives an empty index. A very long text
is one record; it is encoded in parts of a bounded length, its ids are in memory at once. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import scratch_path
from .tokenizing import BpeEncoder, loaded

MAGIC = b"IDSHARD1"
MASK = 0xA282EAD8
SHARD_BYTES = 64 * 1024 * 1024
READ_BYTES = 4 * 1024 * 1024
INDEX = "doc_id bigint, part int, pos bigint, file string, offset bigint, size bigint, n_tokens bigint, start_in_part bigint"


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_checksum(length)), payload, struct.pack("<I", masked_checksum(payload))))


def unframe(record: bytes) -> bytes:
    """Payload of one whole record; raises if a length or checksum is wrong."""
    length, length_sum = struct.unpack_from("<QI", record)
    if masked_checksum(record[:8]) != length_sum or len(record) != length + 16:
        raise ValueError("damaged record length")
    payload = record[12:-4]
    if masked_checksum(payload) != struct.unpack_from("<I", record, 12 + length)[0]:
        raise ValueError("damaged record payload")
    return payload


def pack_ids(doc_id: int | None, ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> bytes:
    narrow = ids.size == 0 or int(ids.max()) < 65536
    flags = int(narrow) | (2 if doc_id is None else 0)
    body = ids.astype("<u2" if narrow else "<u4").tobytes()
    return struct.pack("<BqI", flags, doc_id or 0, ids.size) + compressor.compress(body)


def unpack_ids(payload: bytes, decompressor: zstandard.ZstdDecompressor) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = struct.unpack_from("<BqI", payload)
    body = decompressor.decompress(payload[13:], max_output_size=max(1, n * 4))
    ids = np.frombuffer(body, "<u2" if flags & 1 else "<u4")
    if ids.size != n:
        raise ValueError("damaged record: wrong number of ids")
    return (None if flags & 2 else doc_id), ids.astype("<u4")


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode ``text`` of all rows, write shards under ``folder`` in ascending doc_id order, return the index."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches):
        files, root = pa.fs.FileSystem.from_uri(f"{folder}/shards")
        files.create_dir(root, recursive=True)
        encoder, compressor = loaded(BpeEncoder, tokenizer), zstandard.ZstdCompressor(level=1)
        end = np.asarray([end_id], "<u4")
        part, pos, tokens, out, name, at = TaskContext.get().partitionId(), 0, 0, None, None, 0
        try:
            for batch in batches:
                index = []
                texts = (cell.as_py() for cell in batch.column(1))
                for doc_id, found in zip(batch.column(0).to_pylist(), encoder.encode_many(texts)):
                    ids = np.concatenate((found, end))
                    record = frame(pack_ids(doc_id, ids, compressor))
                    if out is None or at + len(record) > SHARD_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{part:08d}-{uuid.uuid4().hex}.ids", len(MAGIC)
                        out = files.open_output_stream(f"{root}/{name}")
                        out.write(MAGIC)
                    out.write(record)
                    index.append((doc_id, part, pos, name, at, len(record), ids.size, tokens))
                    at, pos, tokens = at + len(record), pos + 1, tokens + ids.size
                columns = list(zip(*index)) or [[]] * 8
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in INDEX.split(", ")]
                )
        finally:
            if out is not None:
                out.close()

    spread.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``: ids of all documents before a record. One row per part is summed up in one task."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base", "start_in_part")


def read_records(index: DataFrame, folder: str, as_digest: bool = False) -> DataFrame:
    """Records named by index rows: doc_id, start and ``ids``, or their number and checksum with ``as_digest``.

    Neighbouring index rows of one shard are read together; any other order works record by record.
    """

    def read(batches):
        files, root = pa.fs.FileSystem.from_uri(f"{folder}/shards")
        decompressor, source, opened, held, held_at = zstandard.ZstdDecompressor(), None, None, b"", 0
        for batch in batches:
            starts, names, offsets, sizes = (c.to_pylist() for c in batch.columns)
            found = []
            for start, name, offset, size in zip(starts, names, offsets, sizes):
                if name != opened:
                    if source is not None:
                        source.close()
                    source, opened, held, held_at = files.open_input_file(f"{root}/{name}"), name, b"", 0
                    if source.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{name} is no shard")
                if not held_at <= offset <= offset + size <= held_at + len(held):
                    source.seek(offset)
                    held, held_at = source.read(max(size, READ_BYTES)), offset
                doc_id, ids = unpack_ids(unframe(held[offset - held_at : offset - held_at + size]), decompressor)
                found.append((doc_id, start, ids))
            doc_ids, at, ids = list(zip(*found)) or ((), (), ())
            columns = [pa.array(doc_ids, pa.int64()), pa.array(at, pa.int64())]
            if as_digest:
                columns += [pa.array([i.size for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())]
            else:
                columns.append(pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])
        if source is not None:
            source.close()

    schema = "doc_id bigint, start bigint, " + ("n_tokens bigint, ids_crc32 bigint" if as_digest else "ids array<bigint>")
    return index.select("start", "file", "offset", "size").mapInArrow(read, schema)


def token_records(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the documents into a new folder of the shared scratch space and read all records back as digests."""
    folder = scratch_path(docs.sparkSession, "token-records")
    return read_records(write_records(docs, folder, tokenizer, end_id), folder, as_digest=True)
