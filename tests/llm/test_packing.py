"""Packing: every id in exactly one place, little padding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventide.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(4))
def test_a_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.choice([1, 2, 7, 64, 256]))
    histogram = np.zeros(window + 1, np.int64)
    histogram[1:] = rng.integers(0, 50, window) * rng.integers(0, 2, window)
    used = np.zeros_like(histogram)
    for lengths, times in packing.plan(histogram, window):
        assert times > 0 and sum(lengths) <= window
        for n in lengths:
            used[n] += times
    assert (used == histogram).all()


def test_a_large_histogram_is_filled_almost_completely():
    rng = np.random.default_rng(7)
    histogram = np.bincount(np.minimum(1024, rng.geometric(1 / 300, 50_000)), minlength=1025)
    chosen = packing.plan(histogram, 1024)
    tokens = int((histogram * np.arange(1025)).sum())
    assert sum(times for _, times in chosen) * 1024 <= tokens * 1.001 + 1024


def test_least_squares_meets_an_exact_histogram():
    ways = packing.fillings(10, np.arange(1, 11))
    assert sorted(set(map(tuple, ways))) == sorted(map(tuple, ways)) and (ways.sum(1) == 10).all()
    histogram = np.bincount(ways[[0, 3, 7]].ravel(), minlength=11) * 100
    histogram[0] = 0
    used = np.bincount(ways.ravel(), np.repeat(packing.repeat_counts(ways, histogram), 3), 11)
    used[0] = 0
    assert np.abs(used - histogram).max() < 1


def _check(packed, texts, window):
    library = Tokenizer.from_file(PATH)
    wanted = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    rows = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == wanted.keys()
    for doc_id, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            ids = wanted[doc_id][p.start : p.start + p.length]
            assert (p.start, p.doc_tokens) == (at, len(wanted[doc_id]))
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
            at += p.length
        assert at == len(wanted[doc_id])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence


def test_documents_are_packed_whole(spark):
    texts = {1: None, 2: "", 3: "one two three", 4: "long words again. " * 900, None: "no id", 6: "é 你好\n" * 50}
    texts |= {i: "some words " * (i % 40) for i in range(10, 200)}
    docs = spark.createDataFrame([(i, t, 3, 4) for i, t in texts.items()], "doc_id bigint, text string, length int, rank int")
    packed = packing.pack_documents(docs, PATH, end_id=0, window=64, with_ids=True).cache()
    by_sequence = _check(packed, texts, 64)
    joined = {r.sequence_id: r for r in packing.sequences(packed, 64, pad_id=5).collect()}
    for k, pieces in by_sequence.items():
        ids = b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.offset))
        n = len(ids) // 4
        assert joined[k].n_ids == n
        padding = b"" if n & (n - 1) == 0 else np.full(64 - n, 5, "<u4").tobytes()
        assert bytes(joined[k].ids) == ids + padding


def test_repeated_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "same text here")] * 40, "doc_id bigint, text string")
    packed = packing.pack_documents(docs, PATH, end_id=0, window=16).collect()
    assert len(packed) == 40 and len({(r.sequence_id, r.offset) for r in packed}) == 40
    assert packing.pack_documents(docs.limit(0), PATH, end_id=0).count() == 0
