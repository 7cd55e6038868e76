"""Windows of benchmark items in documents, against a plain search."""

import hashlib
import random
import re

import pytest

from eventide.llm import decontamination as d


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(text, items, window=13, share=20):
    words, hit, found = plain_words(text), set(), set()
    for item_id, item in items:
        w = plain_words(item)
        k = min(window, len(w))
        for s in range(len(w) - k + 1) if w else ():
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[s : s + k]:
                    hit.update(range(i, i + k))
                    found.add(str(item_id))
    n_hit = len(hit)
    return len(words), n_hit, sorted(found), n_hit > 0 and share * n_hit >= len(words), hit


def _data(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "of", "The", "é", "Zé", "x1", "2", "to", "in"] + [f"w{i}" for i in range(30)]
    text = lambda n: rng.choice([" ", ", ", "\n", " -- "]).join(rng.choices(vocabulary, k=n))
    items = [(i, text(n)) for i, n in enumerate([30, 13, 14, 60, 12, 7, 3, 2, 40])]
    items += [(20, items[0][1]), (21, None), (22, ""), (23, "..."), (24, "Rare1")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    for i in range(60, 120):
        item = rng.choice(items)[1] or ""
        parts = item.split(" ")
        a = rng.randrange(len(parts))
        docs.append((i, text(rng.randrange(80)) + "; " + " ".join(parts[a : a + rng.randrange(50)]).upper() + " " + text(rng.randrange(300))))
    docs += [(200, None), (201, ""), (202, "rare1"), (203, "Rare1 " * 3000), (203, "other text"), (None, items[0][1]), (None, items[0][1]), (5, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("seed, window, broadcast", [(1, 13, 10**6), (2, 13, 0), (3, 5, 10**6)])
def test_against_plain_search(spark, seed, window, broadcast, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_ROWS", broadcast)
    docs, items = _data(seed)
    documents = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id bigint, text string, key string, k int")
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, words string")
    judged = d.contamination(documents, benchmark, window)
    found = sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated, sorted(set().union(*(range(s.start, s.end) for s in r.hit_spans))))
        for r in judged.collect()
    )
    wanted = sorted(
        (i is None, i or 0, n, h, len(ids), ids, bad, sorted(hit)) for i, (n, h, ids, bad, hit) in ((i, plain(t, items, window)) for i, t in docs)
    )
    assert found == wanted
    kept = d.without_contaminated(documents, benchmark, window)
    assert kept.columns == documents.columns
    good = sorted((i is None, i or 0, t or "") for i, t in docs if not plain(t, items, window)[3])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == good


def test_empty_tables(spark):
    documents = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, "some words here")], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in d.contamination(documents, benchmark.limit(0)).collect()] == [(3, 0, False)]
    assert d.contamination(documents.limit(0), benchmark).count() == 0
    assert d.contamination(documents, benchmark).collect()[0].contaminated


def test_no_python_in_the_plan(spark):
    documents = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, "some words here")], "item_id bigint, text string")
    plan = d.contamination(documents, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert hashlib.sha256(b"").hexdigest() == documents.selectExpr("sha2('', 256) h").collect()[0].h
