"""Registered queries on the smallest tables, against SQL or a plain version of the whole result."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from checks.compare import canonical, connect
from eventide.llm.queries import ORACLE, QUERIES
from llm.test_decontamination import plain as plain_contamination
from llm.test_language_id import plain_languages
from llm.test_language_model import plain as plain_scores
from llm.test_license_scan import plain as plain_phrases, plain_labels as plain_license_labels
from llm.test_main_text import plain as plain_page
from llm.test_simhash import plain_fingerprint, plain_labels
from llm.test_url_rules import RULES, plain_rules, plain_tokens
from llm.test_whitening import plain as plain_whitening

FOLDER = "/root/testdata/sf0.001"


def _rows(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in _rows(spark, "documents")}


def _crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_each_operator_has_its_query():
    assert [name.split("_")[0] for name in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    left, right = canonical(QUERIES[name](spark, FOLDER).toPandas()), canonical(connect(FOLDER).execute(ORACLE[name]).df())
    assert left.equals(right) and len(left) > 0


def test_op1(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted, at = [], 0
    for i in sorted(docs):
        ids = [*library.encode(docs[i] or "", add_special_tokens=False).ids, 1]
        wanted.append((i, at, len(ids), _crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op1_token_records"](spark, FOLDER).collect())) == wanted


def test_op2(spark):
    found = QUERIES["op2_url_rules"](spark, FOLDER).collect()
    urls = {r.page_id: r.url for r in _rows(spark, "pages")}
    assert {r.page_id for r in found} == set(urls)
    tokens = {i: plain_tokens(url) for i, url in urls.items()}
    marks = [(r.doc_id, r.quality == 0 or r.toxic == 1) for r in _rows(spark, "labels")]
    rules = plain_rules([(tokens[i], bad) for i, bad in marks if i in tokens])
    blocked = {i for i, t in tokens.items() if any(set(c) <= t for c in rules)}
    for r in found:
        host = urls[r.page_id].split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].lower()
        path = urls[r.page_id].split("://", 1)[1][len(host):].split("?")[0].split("#")[0]
        fits = [u for u in RULES if (host == u.host or host.endswith("." + u.host)) and path.startswith(u.path)]
        best = max(fits, key=lambda u: len(u.text), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.text)
        assert r.verdict == (best.verdict if best else "block" if r.page_id in blocked else "allow")


def test_op3(spark):
    rows = _rows(spark, "documents")
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    wanted = plain_languages([(r.doc_id, r.text, None if held[r.doc_id] else r.lang) for r in rows])
    found = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, FOLDER).collect()}
    assert {i: (r.held_out, r.lang_pred) for i, r in found.items()} == {i: (held[i], w[0]) for i, w in wanted.items()}
    assert [found[i].score for i in wanted] == pytest.approx([w[1] for w in wanted.values()], rel=1e-9)
    asked = [r for r in rows if held[r.doc_id]]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in asked) >= 0.95 * len(asked)


def test_op4(spark):
    rows = {r.vec_id: np.asarray(r.embedding, float) for r in _rows(spark, "embeddings")}
    found = {}
    for r in QUERIES["op4_curve_search"](spark, FOLDER).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert found.keys() == {q for q in rows if q % 20 == 0}
    hits = 0
    for q, own in found.items():
        best = sorted((-float(rows[q] @ v), i) for i, v in rows.items() if i != q)[:20]
        hits += len({i for i, _ in own.values()} & {i for _, i in best})
        assert sorted(own) == list(range(1, 21)) and all(abs(s - rows[q] @ rows[i]) < 1e-12 for i, s in own.values())
    assert hits >= 0.9 * 20 * len(found)


def test_op5(spark, docs):
    prints = {i: plain_fingerprint(t, 3) for i, t in docs.items()}
    label = plain_labels(sorted(set(prints.values())), 2)
    first = {}
    for i in sorted(docs):
        first.setdefault(label[prints[i]], i)
    found = sorted(map(tuple, QUERIES["op5_simhash"](spark, FOLDER).collect()))
    assert found == sorted((i, f"{p:016x}", first[label[p]]) for i, p in prints.items())


def test_op6(spark):
    found = sorted(map(tuple, QUERIES["op6_main_text"](spark, FOLDER).collect()))
    assert found == sorted((r.page_id, r.url, plain_page(r.html), len(plain_page(r.html))) for r in _rows(spark, "pages"))


def test_op7(spark, docs):
    found = {r.doc_id: r for r in QUERIES["op7_license_scan"](spark, FOLDER).collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in found.items()} == {i: plain_phrases(t) for i, t in docs.items()}
    assert {i: (r.labels, r.score) for i, r in found.items()} == {i: plain_license_labels(t) for i, t in docs.items()}


def test_op8(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs.items()}
    pieces, used = {}, {}
    for r in QUERIES["op8_packing"](spark, FOLDER).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.length, r.ids_crc32, r.doc_tokens) == (len(part), _crc(part), len(ids[r.doc_id]))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found, total in [(v, len(ids[i])) for i, v in pieces.items()] + [(v, None) for v in used.values()]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == total if total else at <= 1024
    assert pieces.keys() == ids.keys()
    assert len(used) * 1024 <= 1.02 * sum(map(len, ids.values())) + 1024


def test_op9(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts = {i: len(library.encode(t or "")) for i, t in docs.items()}
    found = sorted(map(tuple, QUERIES["op9_token_counts"](spark, FOLDER).collect()))
    assert found == sorted((i, len((docs[i] or "").encode()), n, n > 4096) for i, n in counts.items())


def test_op10(spark, docs):
    items = [(r.item_id, r.text) for r in _rows(spark, "benchmark")]
    wanted = []
    for i, text in docs.items():
        n, hit, ids, bad, _ = plain_contamination(text, items)
        wanted.append((i, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bad))
    assert sorted(map(tuple, QUERIES["op10_decontamination"](spark, FOLDER).collect())) == sorted(wanted)


def test_op12(spark, docs):
    wanted = plain_scores([(i, docs[i]) for i in sorted(docs)], lambda i: zlib.crc32(str(i).encode()) % 10 == 0)
    found = QUERIES["op12_lm_scores"](spark, FOLDER).drop("perplexity").orderBy("doc_id").collect()
    assert [tuple(r)[:5] for r in found] == [w[:5] for w in wanted]
    assert np.allclose([tuple(r)[5:] for r in found], [w[5:] for w in wanted], rtol=1e-12)


def test_op12_held_out_texts_are_scored_better_than_by_single_words(spark):
    found = [r for r in QUERIES["op12_lm_scores"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in found) > 0.85 * sum(r.base_score for r in found)


def test_op13(spark):
    rows = [(r.vec_id, r.embedding) for r in _rows(spark, "embeddings")]
    found = QUERIES["op13_whitening"](spark, FOLDER).orderBy("vec_id", "component").collect()
    exact, values = plain_whitening(rows)
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in found] == [e[:4] for e in exact]
    sign = {c: np.sign(sum(r.whitened * e[4] for r, e in zip(found, exact) if r.component == c)) for c in range(1, 5)}
    assert np.allclose([r.whitened * sign[r.component] for r in found], [e[4] for e in exact], atol=1e-9)
    assert np.allclose([r.explained for r in found], [values[r.component - 1] for r in found], rtol=1e-12)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-10
