"""Licence phrases against a plain search; damaged notices by their votes."""

import random
import re

import pytest

from eventide.llm import license_scan as scan

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [
        (label, i) for label, phrase in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for _, i in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for label, _ in places}))
    )


def plain_labels(text):
    """(labels, score) of a text: every hit of every template by comparing words, diagonals, spans, verification."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    labels, best = set(), 0.0
    for label, phrase in BASE.items():
        if any(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words))):
            labels.add(label)
            best = 1.0
    for label, notices in scan.NOTICES.items():
        for notice in notices:
            wanted = notice.split()
            grams = [tuple(wanted[i : i + 3]) for i in range(len(wanted) - 2)]
            diagonals = {}
            for at in range(len(words) - 2):
                for place, gram in enumerate(grams):
                    if tuple(words[at : at + 3]) == gram:
                        diagonals.setdefault(at - place, set()).add(place)
            spans, last = [], None  # places voted for, first word, word after the last
            for diagonal in sorted(diagonals):
                voted = diagonals[diagonal]
                begin, end = diagonal + min(voted), diagonal + max(voted) + 3
                if last is not None and diagonal - last[0] <= scan.SLACK and begin - (last[1] - 3) <= len(grams) + scan.SLACK:
                    spans[-1] = spans[-1][0] | voted, min(spans[-1][1], begin), max(spans[-1][2], end)
                else:
                    spans.append((voted, begin, end))
                last = diagonal, end
            for voted, begin, end in spans:
                part = words[begin:end]
                found = {tuple(part[i : i + 3]) for i in range(len(part) - 2)} & set(grams)
                score = len(found) / len(set(grams))
                denied = len(wanted) < scan.NAMING and not set(words[max(0, begin - 3) : begin]).isdisjoint(scan.DENYING)
                if len(voted) >= scan.VOTED * len(grams) and score >= scan.VERIFIED and not denied:
                    labels.add(label)
                    best = max(best, score)
    return ",".join(sorted(labels)), best


def _damaged():
    """Notices with words put in, left out, exchanged and repeated, in filler."""
    rng = random.Random(6)
    notices = [n for group in scan.NOTICES.values() for n in group]
    texts = []
    for k in range(150):
        words = rng.choice(notices).split()
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], [words[i], "really"], ["other"], [words[i]] * 2])
        texts.append(" ".join(["some", "text"] * rng.randrange(3) + rng.choice([[], ["not"], ["no", "longer"], ["isn't"], ["was", "not", "x", "y", "z"]]) + words
                              + ["end"] * rng.randrange(2) + (rng.choice(notices).split() if rng.random() < 0.3 else [])))
    return texts


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_labels_and_scores_equal_plain(spark, broadcast, monkeypatch):
    monkeypatch.setattr(scan, "BROADCAST_ROWS", broadcast)
    rows = list(enumerate([*_damaged(), *_texts(), *(n for group in scan.NOTICES.values() for n in group)]))
    found = {r.doc_id: (r.labels, r.score) for r in scan.license_labels(_frame(spark, rows)).collect()}
    assert found == {i: plain_labels(t) for i, t in rows}
    assert len({labels for labels, _ in found.values()}) > 12


def test_denied_notices(spark):
    texts = {
        "It is not licensed under the MIT license.": "", "It isn't released under the MIT license": "", "No longer licensed under the MIT License": "",
        "It is licensed under the MIT license, not BSD": "mit", "Not all rights reserved": "reserved", "No: this is not CC BY": "cc-by",
        "Why not? Parts of it are licensed under the MIT license": "mit", "not " + scan.NOTICES["mit"][2]: "mit",
    }
    rows = list(enumerate(texts))
    found = {r.doc_id: r.labels for r in scan.license_labels(_frame(spark, rows)).collect()}
    assert [found[i] for i, _ in rows] == list(texts.values())


def _texts():
    rng = random.Random(4)
    bits = ["CC BY", "cc-by", "General\nPublic, License", "all rights reserved", "ALL RIGHTS", "reserved", "public license", "cc", "by", "é", "x9"]
    texts = [" ".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(80)]
    return [*texts, None, "", "...", "cc by " * 20_000, "all rights reservedé", "ccby", "CC_BY"]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id bigint, text string, key string, pos int")


def test_phrases(spark):
    rows = [*enumerate(_texts()), (3, _texts()[3]), (None, "cc by"), (None, "cc by"), (7, "all rights reserved")]
    found = scan.license_labels(_frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word or -1, r.last_word or -1, r.base_labels) for r in found) == sorted(
        (i is None, i or 0, n, b, first or -1, last or -1, labels) for i, (n, b, first, last, labels) in ((i, plain(t)) for i, t in rows)
    )
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)


def test_notices_whole_damaged_and_absent(spark):
    mit = scan.NOTICES["mit"][2]
    words = mit.split()
    gone = " ".join(words[:10] + words[11:25] + words[26:])  # two words left out
    more = " ".join(words[:15] + ["really"] + words[15:])
    rows = [
        (1, f"some text. {mit.upper()}! more"), (2, f"some text {gone} more"), (3, f"x {more}"), (4, " ".join(words[:12])),
        (5, " ".join(sorted(words))), (6, "Licensed under the Apache License, Version 2.0."), (7, f"{mit} {mit}"), (8, "filler " * 500 + mit),
        (9, "Licensed under CC BY-NC 4.0."), (10, "This work is licensed under the GNU General Public License, version 3."),
    ]
    found = {r.doc_id: r for r in scan.license_labels(_frame(spark, rows)).collect()}
    assert {i: found[i].labels for i in range(1, 9)} == {1: "mit", 2: "mit", 3: "mit", 4: "", 5: "", 6: "apache-2.0", 7: "mit", 8: "mit"}
    assert found[9].labels == "cc-by,cc-by-nc" and found[10].labels == "gpl,gpl-notice"
    assert found[1].score == 1 and 0.75 <= found[2].score < 1 and found[4].score == 0
    given = scan.templates()
    docs = _frame(spark, rows)
    spans = {(r.doc_id, r.label): (r.start, r.end) for r in scan.license_spans(docs, scan.votes(docs, given), given).collect()}
    assert spans[1, "mit"] == (2, 2 + len(words)) and spans[2, "mit"] == (2, len(words)) and spans[8, "mit"] == (500, 500 + len(words))


def test_no_documents(spark):
    assert scan.license_labels(_frame(spark, [])).count() == 0
