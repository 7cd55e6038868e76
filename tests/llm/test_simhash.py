"""Bit-sliced comparison and near-duplicate components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from eventide.llm import simhash
from eventide.llm.components import components


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_labels(nodes, radius):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if (a ^ b).bit_count() <= radius and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


TEXTS = ["", None, " \t\n\x0b\x0c\r ", "One", "one two", "ONE two three", "Ä ä Été x y", "a b c a b c a b c", "x y z w " * 5000]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_fingerprints(k):
    for text in TEXTS:
        assert simhash.fingerprint(text, k) == plain_fingerprint(text, k)


def near(rng, n, radius):
    values = []
    for _ in range(n):
        value = rng.getrandbits(64) if not values or rng.random() < 0.4 else rng.choice(values)
        for _ in range(rng.randrange(radius + 2)):
            value ^= 1 << rng.randrange(64)
        values.append(value)
    return values


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    values = near(random.Random(radius), 150, radius)
    planes = simhash.bit_planes(np.asarray(values, np.uint64))
    for shift in (1, 2, 63, 64, 100):
        lanes = (1 << (len(values) - shift)) - 1
        found = simhash.within(planes, shift, lanes, radius)
        wanted = [i for i in range(len(values) - shift) if (values[i] ^ values[i + shift]).bit_count() <= radius]
        assert simhash._lanes(found, len(values)).tolist() == wanted


def _signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


@pytest.mark.parametrize("radius, block", [(2, 2048), (2, 10), (1, 7), (3, 2048)])
def test_components_of_fingerprints(spark, radius, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    values = list(dict.fromkeys(near(random.Random(block), 260, radius)))
    hub = random.Random(5).getrandbits(64)
    values = list(dict.fromkeys(values + [hub ^ (1 << b) ^ (1 << c) for b in range(20) for c in range(b)] + [0, 1]))
    frame = spark.createDataFrame([(_signed(v),) for v in values], "fp bigint")
    found = {r.node: r.label for r in components(simhash.links(frame, radius)).collect()}
    plain = plain_labels(values, radius)
    groups = {}
    for v in values:
        groups.setdefault(plain[v], set()).add(v)
    for group in groups.values():
        labels = {found.get(_signed(v), _signed(v)) for v in group}
        assert labels == {min(map(_signed, group))}


def test_component_of_a_long_chain(spark):
    order = random.Random(3).sample(range(1000), 300)
    chain = spark.createDataFrame(list(zip(order, order[1:])) + [(2000, 2001), (2001, 2001)], "a bigint, b bigint")
    found = {r.node: r.label for r in components(chain).collect()}
    assert found == {n: min(order) for n in order} | {2000: 2000, 2001: 2000}


def test_documents(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed"], k=200)) for _ in range(20)]
    texts = [*TEXTS, *base, *base, *(b + " extra" for b in base), *(b.upper() for b in base[:5])]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, 1, 2) for i, t in zip(ids, texts)] + [(ids[3], texts[3], 1, 2), (None, texts[10], 1, 2), (None, "alone without id", 1, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, label int")
    prints = {t: plain_fingerprint(t, 3) for t in {r[1] for r in rows}}
    label = plain_labels(sorted(set(prints.values())), 2)
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[label[prints[t]]] = min(i, first.get(label[prints[t]], i))
    found = sorted((r.doc_id is None, r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs, 3, 2).collect())
    assert found == sorted((i is None, i, _signed(prints[t]), first.get(label[prints[t]])) for i, t, *_ in rows)
    kept = simhash.one_of_each(docs, 3, 2)
    assert kept.columns == docs.columns
    stayed = kept.collect()
    assert sorted(r.doc_id for r in stayed if r.doc_id is not None) == sorted(first.values())
    assert [r.text for r in stayed if r.doc_id is None] == ["alone without id"]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs, 3, 2).count() == 0
