"""Token counts of documents through a cache of content digests.

The cache is a Parquet folder of (digest, version, n_tokens). A digest is the SHA-256 of the normalised content, a
version names the tokenizer file by the hash of its bytes. Contents are joined to the cache by digest; only distinct
contents without a stored count are encoded, one row each, and their counts are appended before the result is read.
An append that is repeated or made by two jobs at once stores equal rows; reading keeps one.

Normalisation turns null into empty and nothing else, as the tokenizers count white space and case. Repeated rows
get a row each, a null doc_id stays null, an empty table gives an empty result. Very long texts are encoded whole, one
at a time. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import scratch_path, written
from .tokenizing import PieceCounter, loaded

CACHE = "digest binary, version string, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:16]


def normalised(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer; a folder that does not exist yet is an empty cache."""
    place = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
    return stored.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def count_texts(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""

    def count(batches):
        counter = loaded(PieceCounter, tokenizer)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return rows.mapInArrow(count, "digest binary, n_tokens bigint")


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; the cache folder grows by what it lacked."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    keys = written(
        texts.select("doc_id", digest, F.octet_length("text").cast("bigint").alias("n_bytes")), "digests"
    )
    # One document speaks for each content: its smallest id. A hot content shrinks before the shuffle.
    speakers = keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    missing = speakers.join(read_cache(spark, cache, version), "digest", "left_anti")
    wanted = missing.select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_doc_id"))
    source = texts.select("doc_id", "text", digest)
    misses = source.join(
        wanted, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left_semi"
    )
    counted = count_texts(misses.select("digest", "text"), tokenizer)
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    # Written first, so that the join reads plain shuffles and Spark can split the part of a hot content.
    counts = keys.join(written(read_cache(spark, cache, version), "counts"), "digest")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def new_cache(spark: SparkSession) -> str:
    return scratch_path(spark, "token-counts")
