"""Character models: their arithmetic, held-out accuracy, rejection."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import language_id as ids


def plain_model(texts):
    """Interpolated Kneser-Ney by definition, as a function of a key."""
    grams = Counter(int(k) for t in texts for k in ids.keys(ids.symbols(t)))
    levels = {4: dict(grams)}
    for order in (3, 2, 1):
        levels[order] = Counter(g & ((1 << (order * 6)) - 1) for g in levels[order + 1])

    def discount(c):
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def probability(key, order=4):
        if order == 0:
            return 1 / 64
        key &= (1 << (order * 6)) - 1
        c, d = levels[order], discount(levels[order])
        near = {g: v for g, v in c.items() if g >> 6 == key >> 6}
        lower = probability(key, order - 1)
        if not near:
            return lower
        total = sum(near.values())
        return max(near.get(key, 0) - d, 0) / total + d * len(near) / total * lower

    return grams, probability


def plain_languages(rows):
    """{id: (language, score)} of rows (id, text, language or None): dictionaries of four-symbol windows, one per language."""
    def windows(text):
        found = []
        for c in (x.lower()[0] for x in text or ""):
            s = 0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37
            found += [s] if s or not found or found[-1] else []
        if not any(found):
            return []
        found = [0, 0, 0, *(found[1:] if found[0] == 0 else found), *([0] if found[-1] else [])]
        return [tuple(found[i : i + 4]) for i in range(len(found) - 3)]

    cut = {i: windows(t) for i, t, _ in rows}
    models = {}
    for lang in sorted({lang for _, t, lang in rows if lang is not None and cut}):
        levels = {4: Counter(w for i, _, known in rows if known == lang for w in cut[i])}
        for order in (3, 2, 1):
            levels[order] = Counter(w[1:] for w in levels[order + 1])
        totals = {o: Counter() for o in levels}
        kinds = {o: Counter() for o in levels}
        discounts = {}
        for order, counts in levels.items():
            for w, n in counts.items():
                totals[order][w[:-1]] += n
                kinds[order][w[:-1]] += 1
            ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
            discounts[order] = ones / (ones + 2 * twos) if ones and twos else 0.5
        known = {}

        def p(w):
            if not w:
                return 1 / 64
            if w not in known:
                order, below = len(w), p(w[1:])
                total = totals[order][w[:-1]]
                d = discounts[order]
                known[w] = (max(levels[order][w] - d, 0) + d * kinds[order][w[:-1]] * below) / total if total else below
            return known[w]

        models[lang] = {w: -np.log(p(w)) for w in {w for found in cut.values() for w in found}}
    result = {}
    for i, found in cut.items():
        if not found:
            result[i] = "und", 0.0
            continue
        entropy = {lang: sum(m[w] for w in found) / len(found) for lang, m in models.items()}
        best = min(entropy, key=entropy.get)
        result[i] = best, 1 / sum(np.exp((entropy[best] - e) * min(len(found), 64)) for e in entropy.values())
    return result


def test_probabilities_are_those_of_the_definition():
    texts = ["the cat sat on the mat", "that hat and the bat", "Über Öl", "x"]
    grams, probability = plain_model(texts)
    model = ids.KneserNey.fit(np.asarray(list(grams)), np.asarray(list(grams.values())))
    asked = np.asarray([*grams, *random.Random(1).sample(range(ids.KEYS), 300), *(g ^ 5 for g in grams)])
    assert np.exp(model.log_probability(asked)) == pytest.approx([probability(int(k)) for k in asked], rel=1e-12)
    context = next(iter(grams)) >> 6
    assert np.exp(model.log_probability(np.asarray([context << 6 | s for s in range(64)]))).sum() == pytest.approx(1)


def test_symbols():
    assert ids.symbols("Ab 12-c").tolist() == [0, 1, 2, 0, 3, 0]
    assert ids.symbols("123 \n!").size == ids.symbols("").size == 0
    assert len(ids.symbols("éè𝒜日本")) == 7
    assert ids.keys(ids.symbols("ab")).tolist() == [1, 1 << 6 | 2, 1 << 12 | 2 << 6]


def test_pieces_of_a_text_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts = ["", "1 2 3", "a", " a", "12345678 a 1234567", "word " * 9] + ["".join(rng.choices("ab é1-", k=n)) for n in range(1, 60)]
    whole = [ids.keys(ids.symbols(t)).tolist() if len(ids.symbols(t)) else [] for t in texts]
    monkeypatch.setattr(ids, "PIECE", 7)
    assert [[int(k) for piece in ids.key_pieces(t) for k in piece] for t in texts] == whole
    assert list(ids.key_pieces(None)) == []


def test_twenty_languages_need_little_memory(spark):
    rng = random.Random(7)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(60)] for _ in range(20)]
    some = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    rows = [(100 * lang + i, some(lang, 60), f"l{lang:02d}") for lang in range(20) for i in range(20)]
    asked = [(10_000 + lang, some(lang, 40), None) for lang in range(20)]
    found = {r.doc_id: r.lang_pred for r in ids.identify(_frame(spark, rows + asked), F.col("doc_id") >= 10_000).collect()}
    assert all(found[10_000 + lang] == f"l{lang:02d}" for lang in range(20))
    models = [ids.KneserNey.fit(*np.unique(ids.keys(ids.symbols(some(lang, 400))), return_counts=True)) for lang in range(20)]
    long = [" ".join(some(lang, 20_000) for lang in range(20))] + ["short text"] * 100
    tracemalloc.start()
    ids.cross_entropies(long, len(long), models)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(long[0]) > 2_000_000 and peak < 60e6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = ids.identify(docs, ids.fifth(F.col("doc_id"))).join(docs, "doc_id").filter("held_out").collect()
    assert {r.doc_id for r in found} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found) and not any(r.rejected for r in found)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, best int, training string")


def test_odd_rows_and_rejection(spark):
    rng = random.Random(2)
    english = lambda n: " ".join(rng.choices("the of and house water tree people under little going where".split(), k=n))
    german = lambda n: " ".join(rng.choices("der die und haus wasser baum leute unter kleine gehen straße".split(), k=n))
    rows = [(i, english(80), "en") for i in range(60)] + [(100 + i, german(80), "de") for i in range(60)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 34 !!", "en"), (203, english(40), None), (None, german(30), "de")]
    rows += [(204, german(20), "en"), (204, german(20), "en"), (205, "word " + german(20_000), None)]
    rows += [(206, "".join(rng.choices("qxzjkvwyp日本語щж", k=300)), None), (207, english(40) + " " + german(40), None)]
    found = {}
    for r in ids.identify(_frame(spark, rows), F.col("doc_id") >= 200).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    for i in (200, 201, 202):
        assert (found[i][0].lang_pred, found[i][0].score, found[i][0].rejected) == ("und", 0.0, True)
    assert [found[i][0].lang_pred for i in (0, 100, 203, None, 204, 205)] == ["en", "de", "en", "de", "de", "de"]
    assert len(found[204]) == 2 and found[206][0].rejected and not found[207][0].rejected
    assert not any(r.rejected for i, rs in found.items() if i is None or i < 200 for r in rs)


@pytest.mark.parametrize("trained", [5, 500])
def test_short_foreign_texts_are_rejected_at_any_size(spark, trained):
    rng = random.Random(3)
    words = {"en": "the of and house water tree people under little going where", "de": "der die und haus wasser baum leute unter kleine gehen straße"}
    some = lambda lang, n: " ".join(rng.choices(words[lang].split(), k=n))
    rows = [(i, some("en", 80), "en") for i in range(500)] + [(500 + i, some("de", 80), "de") for i in range(trained)]
    foreign = ["zażółć gęślą jaźń", "qxzjkv wypqzx kjvq", "źdźbło trzciny", "xqzv jkpw vxqj zkwy " * 4, "mgła spływająca ścieżką przez gąszcz"]
    known = [some(lang, n) for lang in words for n in (1, 2, 4, 8, 30)]
    rows += [(1000 + i, t, None) for i, t in enumerate(foreign)] + [(2000 + i, t, None) for i, t in enumerate(known)]
    for docs in (rows, [r for r in rows if r[2] != "en" and not (r[0] >= 2000 and r[0] < 2005)]):  # beside a large language, and alone
        found = {r.doc_id: r.rejected for r in ids.identify(_frame(spark, docs), F.col("doc_id") >= 1000).collect()}
        assert [i for i, r in found.items() if r] == [i for i in found if 1000 <= i < 2000]


def test_a_tie_goes_to_the_first_language(spark):
    rows = [(1, "same text", "b"), (2, "same text", "a"), (3, "same", None)]
    assert {r.lang_pred for r in ids.identify(_frame(spark, rows), F.lit(False)).collect()} == {"a"}


def test_nothing_to_learn_from(spark):
    untaught = ids.identify(_frame(spark, [(1, "words here", None), (2, None, "en")]), F.lit(False)).collect()
    assert {(r.lang_pred, r.rejected) for r in untaught} == {("und", True)}
    assert ids.identify(_frame(spark, []), F.lit(False)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_rejected_rows_go_and_others_stay(spark, broadcast, monkeypatch):
    """Whether the rejected rows are few enough to broadcast or not; repeated rows and a null id keep their number."""
    if not broadcast:
        monkeypatch.setattr(ids, "small", lambda table: table)
    rng = random.Random(4)
    words = "the of and house water tree people under little going where".split()
    rows = [(i, " ".join(rng.choices(words, k=40)), "en") for i in range(60)]
    rows += [(60, "", "en"), (61, "12 34", None), (62, "".join(rng.choices("qxzjkvwyp", k=300)), None), (63, None, None), (62, rows[0][1], "en")]
    rows += [(None, rows[1][1], "en"), (None, "77", "en"), (5, rows[5][1], "en")]
    docs = _frame(spark, rows)
    kept = ids.without_rejected(docs, F.col("doc_id") >= 60)
    assert kept.columns == docs.columns
    wanted = [r for r in rows if r[1] and r[1][0] not in "1q7x" and any(w in r[1].split() for w in words)]
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect())) == sorted((i is None, i or 0, t) for i, t, _ in wanted)
