"""Curve windows against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import curve_search as c


@pytest.mark.parametrize("dimensions, bits", [(1, 5), (2, 4), (3, 3), (6, 2)])
def test_a_hilbert_curve_visits_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = c.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, label int, score double")


def brute(rows, k):
    sound = {i: np.asarray(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.asarray(v, float)).all() and any(v)}
    size = max({len(v) for v in sound.values()}, key=lambda n: (sum(len(v) == n for v in sound.values()), -n))
    sound = {i: v for i, v in sound.items() if len(v) == size}
    return {
        q: sorted(((-float(np.dot(v, w)), i) for i, w in sound.items() if i != q))[:k] for q, v in sound.items() if q % 5 == 0
    }


def _check(found, wanted, least):
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert by_query.keys() == {q for q, best in wanted.items() if best}
    hits = total = 0
    for q, best in wanted.items():
        own = sorted(by_query.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and len(own) == len(best)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {i for _, i in best})
        total += len(best)
    assert hits >= least * total


def test_recall_on_clusters_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 64)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 24))
    rows = [(i, (centres[i % 40] * rng.choice([0.5, 1, 3]) + 0.2 * rng.standard_normal(24)).tolist()) for i in range(2000)]
    rows += [(3000 + i, rows[7][1]) for i in range(500)]  # one vector that many rows share
    rows += [(5000, None), (5005, []), (5010, [0.0] * 24), (5015, [float("nan")] * 24), (5020, [float("inf")] + [1.0] * 23)]
    rows += [(5025, [None] + [1.0] * 23), (5030, [1.0, 2.0]), (None, rows[3][1]), (10, rows[10][1])]
    _check(c.nearest(_frame(spark, rows), F.col("vec_id") % 5 == 0, k=7).collect(), brute(rows, 7), 0.9)


def test_one_block_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(300)]  # many ties
    wanted = brute(rows, 20)
    found = c.nearest(_frame(spark, rows), F.col("vec_id") % 5 == 0, k=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(
        (q, n, i, -s) for q, best in wanted.items() for n, (s, i) in enumerate(best, 1)
    )


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0])], [(0, [1.0, 0.0]), (1, [0.5, 0.5])], [(1, [1.0])]])
def test_few_rows(spark, rows):
    found = c.nearest(_frame(spark, rows), F.col("vec_id") % 5 == 0, k=20).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in found] == ([(0, 1, 0.5)] if len(rows) == 2 else [])
