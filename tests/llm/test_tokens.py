"""Token operators against the libraries themselves."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings, strategies as st
from tokenizers import Tokenizer

from eventide.llm import token_records as records, tokenizing
from eventide.llm.tokenizing import BpeEncoder, KnownPieces, PieceCounter

TEXTS = [
    "", " ", "\n", "a", "Plain words, with stops. And more!\nNext line here.", "two  spaces", " lead", "trail ", "a \n b", "x\n\ny",
    "don't we'll 'tis it's\nIt's", "Größe über été œuvre ÀÉÎ ñandú ß", "İstanbul Ωμέγα Σίσυφος привет 你好 👍🏽 é", "tab\there", "non breaking",
    "soft­hyphen á b", "12 345 6,7.8 $9 (a) [b] {c}", "<|endoftext|> in <|startoftext|> text", "a <|endoftext|> b", "<s> </s> <unk> ▁ x",
    "http://a.b/c?d=e&f=g#h", "…—‘quotes’ “more”", "CamelCase UPPER lower", "word" * 3000, "long text of words. " * 4000,
]
BPE = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")]


@pytest.mark.parametrize("path", BPE)
def test_ids_by_word_are_the_library_ids(path):
    library, encoder = Tokenizer.from_file(path), BpeEncoder(path)
    assert encoder.by_piece
    for text in TEXTS * 2:  # the second time from the caches
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


@pytest.mark.parametrize("path", BPE)
def test_ids_of_given_documents(path, spark):
    library, encoder = Tokenizer.from_file(path), BpeEncoder(path)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").toLocalIterator():
        assert np.frombuffer(encoder.encode(row[0]), "<u4").tolist() == library.encode(row[0], add_special_tokens=False).ids


_LOADED = {path: (Tokenizer.from_file(path), BpeEncoder(path)) for path in BPE}
_BITS = st.sampled_from([*"aBzÉßÿ'09.,!#-_(\n", " ", " word", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "ª", "µ", "²", "×", "ā", "þ", "´", "\u0301"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(_BITS, max_size=12).map("".join), min_size=1, max_size=4))
@example(["it's", "x''s", "5's", "('s)", " 's", "a.'s", "O'Brien's", "abc123def", "x\ny", "x\n\ny", "\nx", "x\n"])
def test_any_signs_side_by_side(texts):
    for library, encoder in _LOADED.values():
        found = list(encoder.encode_many(texts))
        assert [f.tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", BPE)
def test_groups_and_forgetting_change_nothing(path, monkeypatch):
    library, encoder = Tokenizer.from_file(path), BpeEncoder(path)
    monkeypatch.setattr(tokenizing, "GROUP", 50)
    monkeypatch.setattr(tokenizing, "RECENT", 8)
    encoder.known = KnownPieces(kept=20)
    texts = [t[:5000] for t in TEXTS] + ["one two, three's " * 40 + "end", "", "x" * 200, "a " * 100 + "<|endoftext|>"]
    for _ in range(2):
        found = list(encoder.encode_many(iter(texts)))
        assert [f.tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.known.tables[0][0]) <= 40 and list(encoder.encode_many([])) == []


def test_counts_of_pieces(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, counter = sentencepiece.SentencePieceProcessor(model_file=path), PieceCounter(path)
    assert counter.by_piece
    given = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in (TEXTS + given) * 2:
        assert counter.count(text) == len(library.encode(text)), text[:50]


def _frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, file string, offset int")


def test_records_hold_every_document_in_order(spark, tmp_path):
    texts = [*TEXTS, None, "same", "same"]
    ids = [*range(len(TEXTS), 0, -1), None, 7, 7]
    index = records.write_records(_frame(spark, texts, ids), str(tmp_path.as_uri()), BPE[1], end_id=1)
    library = Tokenizer.from_file(BPE[1])
    read = sorted(records.read_records(index, tmp_path.as_uri()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in read] == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for row in read:
        assert row.start == at
        at += len(row.ids)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in read)
    wanted = sorted((i is None, i or 0, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in zip(ids, texts))
    assert found == wanted
    shuffled = records.read_records(index.orderBy("size"), tmp_path.as_uri(), as_digest=True).collect()
    assert {(r.start, r.n_tokens, r.ids_crc32) for r in shuffled} == {
        (r.start, len(r.ids), zlib.crc32(np.asarray(r.ids, "<u4").tobytes())) for r in read
    }


def test_shards_are_cut_at_their_size(spark, tmp_path, monkeypatch):
    import random

    words = [" ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta"], k=400)) for i in range(60)]
    index = records.write_records(_frame(spark, words).repartition(1), tmp_path.as_uri(), BPE[0], end_id=0)
    assert index.count() == 60
    spans = sorted((r.file, r.offset, r.size) for r in index.collect())
    for (file, offset, size), (after, start, _) in zip(spans, spans[1:]):
        assert file != after or offset + size == start


def test_no_documents(spark, tmp_path):
    index = records.write_records(_frame(spark, []), tmp_path.as_uri(), BPE[0], end_id=0)
    assert records.read_records(index, tmp_path.as_uri()).count() == 0


def test_damage_is_found():
    record = records.frame(b"some payload")
    assert records.unframe(record) == b"some payload"
    for at in range(len(record)):
        with pytest.raises(ValueError):
            records.unframe(record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :])
    with pytest.raises(ValueError):
        records.unframe(record + b"x")
