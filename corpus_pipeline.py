"""Cleaning and packing a corpus for training: language, near-duplicates, benchmark passages, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared
folder and reads it again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventide.llm.common import written
from eventide.llm.decontamination import without_contaminated
from eventide.llm.language_id import fifth, without_rejected
from eventide.llm.packing import pack_documents
from eventide.llm.simhash import one_of_each


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters and texts unlike every learned language go."""
    return without_rejected(docs, fifth(F.col("doc_id")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints the smallest document id stays."""
    return one_of_each(docs, shingle=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=20)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)
    return packed.withColumn("length", F.col("length").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # language models, tokenizers and the packing plan have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
