"""The corpus pipeline against its stages done plainly."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from eventide.llm import language_id
from llm.test_decontamination import plain
from llm.test_simhash import plain_fingerprint, plain_labels

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame(
        [(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7), (None, "the of and house water " * 20, "en", "s", 1)], docs.schema
    )
    docs = docs.unionAll(extra)
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "packing"]
    languages, copies, benchmark, packing = (f for _, f in corpus_pipeline.STAGES)

    kept = languages(spark, docs, FOLDER)
    assert kept.columns == columns
    rejected = {r.doc_id for r in language_id.identify(docs, language_id.fifth(F.col("doc_id"))).filter("rejected").collect()}
    assert {9001, 9002} <= rejected and len(rejected) <= 4
    first = {r.doc_id: r.text for r in kept.collect()}
    assert first.keys() == {r.doc_id for r in docs.collect()} - rejected

    single = copies(spark, kept, FOLDER)
    assert single.columns == columns
    with_id = {i: t for i, t in first.items() if i is not None}
    prints = {i: plain_fingerprint(t, 3) for i, t in with_id.items()}
    label = plain_labels(sorted(set(prints.values())), 2)
    smallest = {}
    for i, p in prints.items():
        smallest[label[p]] = min(i, smallest.get(label[p], i))
    second = {r.doc_id: r.text for r in single.collect()}
    assert second.keys() == {*smallest.values(), None}

    clean = benchmark(spark, single, FOLDER)
    assert clean.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    third = {r.doc_id: r.text for r in clean.collect()}
    assert third.keys() == {i for i, t in second.items() if not plain(t, items)[3]}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in third.items()}
    packed = packing(spark, clean, FOLDER).collect()
    assert sum(p.length for p in packed) == sum(map(len, ids.values()))
    places = {}
    for p in packed:
        assert p.ids_crc32 == zlib.crc32(np.asarray(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ["_d", "_K", "_key", "_key_", "_n", "key", "fp", "held_out", "best", "entropy", "w", "piece", "length", "h"]
    clashing = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for (name, stage), columns in zip(corpus_pipeline.STAGES, [clashing.columns] * 3 + [None]):
        wanted, found = stage(spark, docs, FOLDER), stage(spark, clashing, FOLDER)
        assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in wanted.collect()), name
        if columns:
            assert found.columns == columns
            assert all(r[c] == f"{c}{r.doc_id}" for r in found.collect() for c in names), name


def test_run(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(found.columns) and found.count() > 100
