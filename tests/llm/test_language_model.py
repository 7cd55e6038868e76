"""Model scores against dictionaries; probabilities that sum to one; texts cut into pieces."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventide.llm import hash_arrays, language_model
from eventide.llm.language_model import discounts, pieces, score_texts

SCHEMA = "doc_id bigint, text string, out boolean"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def model_of(texts):
    """p(word | word before) by dictionaries, the counts, and the discounts' weights."""
    counts, pairs = Counter(), Counter()
    for text in texts:
        tokens = [*words_of(text), "</s>"]
        counts.update(tokens)
        pairs.update(zip(["<s>", *tokens], tokens))
    before = Counter(w for _, w in pairs)
    times, seconds = Counter(), defaultdict(list)
    for (v, w), n in pairs.items():
        times[v] += n
        seconds[v].append(n)
    of = lambda ns: discounts([sum(n == k for n in ns) for k in (1, 2, 3, 4)])
    single, double = of(before.values()), of(pairs.values())
    cut = lambda n, d: n - d[min(n, 3) - 1] if n else 0.0
    rest = sum(single[min(n, 3) - 1] for n in before.values()) / max(1, len(pairs)) if pairs else 1.0

    def p(w, v):
        p1 = cut(before[w], single) / max(1, len(pairs)) + rest / (len(counts) + 1)
        if not times[v]:
            return p1
        return cut(pairs[v, w], double) / times[v] + sum(double[min(n, 3) - 1] for n in seconds[v]) / times[v] * p1

    return p, counts


def plain(rows, out):
    p, counts = model_of([t for i, t in rows if not out(i)])
    total, some, result = sum(counts.values()), len(counts), []
    for i, text in rows:
        tokens = [*words_of(text), "</s>"]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (some + 1))) for w in tokens)
        logs = sum(math.log10(p(w, v)) for w, v in zip(tokens, ["<s>", *tokens]))
        result.append((i, bool(out(i)), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, logs))
    return result


def _scores(spark, rows, table=None):
    table = spark.createDataFrame(rows, SCHEMA) if table is None else table
    return [tuple(r)[:7] for r in score_texts(table, F.col("out")).orderBy("doc_id").collect()]


TEXTS = ["The cat sat on the mat", "the cat ran", "", None, "A\tdog\nsat  on the CAT", "Üben übt ÜBEN İ", "the the the the", "\x1f odd space the cat"]


@pytest.fixture
def short_pieces(monkeypatch):
    monkeypatch.setattr(language_model, "PIECE", 7)
    monkeypatch.setattr(hash_arrays, "HELD", 4)


def test_equals_plain(spark):
    rows = [(i, t, i % 3 == 1) for i, t in enumerate(TEXTS * 4)]
    wanted = plain([(i, t) for i, t, _ in rows], lambda i: i % 3 == 1)
    found = _scores(spark, rows)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert np.allclose([f[5:] for f in found], [w[5:] for w in wanted], rtol=1e-12)


def test_probabilities_sum_to_one():
    p, counts = model_of([*TEXTS, *TEXTS[:3]])
    for v in [*counts, "<s>", "never"]:
        assert sum(p(w, v) for w in [*counts, "unknown"]) == pytest.approx(1)


def test_pieces_change_nothing(short_pieces):
    texts = ["", "one", " two  three ", "a_very_long_word_without_any_space", None, "x y z " * 9, "a_very_long_word_without_any_space tail"]
    row, word, before, carried = [], [], [], []
    for piece in pieces(pa.array(["skipped", *texts]).slice(1)):
        row += piece.row.tolist()
        word += piece.word.tolist()
        here = [int(piece.before), *piece.word.tolist()[:-1]]
        before += [int(language_model.START) if f else h for f, h in zip(piece.first, here)]
        carried.append(len(piece.word))
    wanted_rows, wanted_words = [], []
    for i, text in enumerate(texts):
        wanted_rows += [i] * (len(words_of(text)) + 1)
        wanted_words += [*words_of(text), None]
    assert row == wanted_rows and len(carried) > 5
    named = {}
    assert all(named.setdefault(w, h) == h for w, h in zip(wanted_words, word)) and len(set(named.values())) == len(named)
    starts = [k for k in range(len(row)) if k == 0 or row[k] != row[k - 1]]
    assert all((before[k] == int(language_model.START)) if k in starts else before[k] == word[k - 1] for k in range(len(row)))


def test_counts_survive_small_buffers():
    rng = np.random.default_rng(2)
    keys = hash_arrays.mix(rng.integers(0, 50, 4000).astype(np.uint64))
    tally, seen = hash_arrays.Tally(6), Counter()
    batches = []
    old, hash_arrays.HELD = hash_arrays.HELD, 16
    try:
        for part in np.array_split(keys, 40):
            batches += list(tally.add(*hash_arrays.counted(part)))
        batches += list(tally.rest())
    finally:
        hash_arrays.HELD = old
    for batch in batches:
        for of, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            some, n = hash_arrays.unpack(packed)
            assert (np.diff(some.astype(object)) > 0).all() and {int(s) >> 58 for s in some} == {of}
            seen.update(dict(zip(some.tolist(), n[:, 0].tolist())))
    assert len(batches) > 1 and seen == Counter(keys.tolist())
    assert (hash_arrays.unmix(hash_arrays.mix(keys)) == keys).all()


def test_arrays_from_a_store_that_cannot_be_mapped(tmp_path, monkeypatch):
    name = hash_arrays.write_arrays(f"file://{tmp_path}/words", [np.arange(5, dtype="<u8"), np.arange(5, dtype="<u4")])
    files = hash_arrays.Files(f"file://{tmp_path}/words", {3: name}, {3: 5})
    assert [c.tolist() for c in hash_arrays.columns_of(files, 3, ["<u8", "<u4"])] == [list(range(5))] * 2
    hash_arrays._MAPPED.clear()
    monkeypatch.setattr(hash_arrays.os.path, "exists", lambda path: False)
    assert hash_arrays.columns_of(files, 3, ["<u8", "<u4"])[1].tolist() == list(range(5))


def test_odd_tables(spark):
    assert _scores(spark, []) == []
    nothing_learnt = _scores(spark, [(1, "a b", True), (2, None, True)])
    assert nothing_learnt == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    rows = [(None, "a b", None), (1, "a b", False), (1, "a b", False), (2, "a c", True)]
    found = _scores(spark, rows)
    assert found[0][1:5] == (False, 3, 3, 9) and found[1] == found[2] and found[3][3] == 2
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("slice", "packed", "n_tokens", "score", "held_out", "n", "file")})
    assert _scores(spark, None, table) == found


def test_discounts_stay_inside_their_counts():
    assert discounts([0, 5, 1, 1]) == [0.5, 0.75, 0.9]
    for n in ([10, 1, 50, 0], [1, 100, 0, 3], [100, 50, 25, 12]):
        assert all(0.1 <= d <= k - 0.1 for k, d in enumerate(discounts(n), 1))
