"""Vector codes against a plain quantiser, and the box search against comparing with every entry."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from eventide.llm.vector_codes import Boxes, compress

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, entries=256, rounds=4, parts=4):
    """Rows (id, vector, label) with finite vectors of one length; every distance computed."""
    rows = sorted(rows, key=lambda r: r[0])
    x = np.floor(1024 * np.asarray([r[1] for r in rows], float)).astype(int).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        far = np.square(x[:, :, None] - books[None]).sum(-1)  # row, part, entry
        return far.argmin(-1), far.min(-1)

    for _ in range(rounds):
        index, _ = assign()
        for p in range(parts):
            for e in set(index[:, p].tolist()):
                own = x[index[:, p] == e, p]
                books[p, e] = own.sum(0) // len(own)
    index, far = assign()
    errors = far.sum(1)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    return [(r[0], "".join(f"{i:02x}" for i in index[k]), int(errors[k]), by_label[r[2]], sha) for k, r in enumerate(rows)]


def _codes(spark, rows, **options):
    return sorted(map(tuple, compress(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=lambda r: (r[0] is None, *r))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_plain(spark, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + spread * rng.normal(size=16)).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(700)]
    assert _codes(spark, rows) == plain(rows)
    assert _codes(spark, rows[:90], entries=40, rounds=2) == plain(rows[:90], 40, 2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 130), st.integers(1, 6), st.integers(1, 3000))
def test_box_search_finds_the_nearest_and_lowest(seed, n, width, most):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-most, most + 1, (n, width)), rng.integers(-2 * most, 2 * most + 1, (50, width))
    index, far = Boxes.of(entries).nearest(x)
    every = np.square(x[:, None] - entries).sum(-1)
    assert (far == every.min(1)).all() and (index == every.argmin(1)).all()


def test_few_candidates_are_left_of_clustered_entries():
    rng = np.random.default_rng(5)
    entries = rng.integers(-10_000, 10_000, (256, 16))
    boxes = Boxes.of(entries)
    left = boxes.inside(entries + rng.integers(-30, 30, (256, 16)), np.full(256, 200))
    assert np.bitwise_count(left).sum() < 300


def test_largest_components_stay_exact():
    entries = np.asarray([[1 << 28, -(1 << 28)], [(1 << 28) - 1, -(1 << 28)]])
    index, far = Boxes.of(entries).nearest(np.asarray([[-(1 << 28), 1 << 28]]))
    assert (index[0], far[0]) == (1, (2**29 - 1) ** 2 + 2**58)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(3, [0.5, 0.25, -0.1, 0.0], 1), (1, [0.5, 0.25, -0.1, 0.001], None), (2, [0.1, 0.2, 0.3, 0.4], None), (2, [0.1, 0.2, 0.3, 0.4], None)]
    bad = [(4, None, 1), (5, [0.1, None, 0.2, 0.3], 1), (6, [nan, 0.0, 0.0, 0.0], 1), (7, [0.0, inf, 0.0, 0.0], 1), (8, [0.0, 0.0, 0.0, -inf], 1)]
    assert _codes(spark, good + bad) == sorted(plain(good))
    with_null_id = _codes(spark, [*good, (None, [0.5, 0.25, -0.1, 0.0], 7)])
    assert with_null_id[-1][0] is None and with_null_id[-1][2] == with_null_id[-1][3]
    assert _codes(spark, bad) == [] and _codes(spark, []) == []
    assert [r[1] for r in _codes(spark, [(1, [], None), (2, [], None)])] == ["00000000"] * 2
    # Unequal lengths: filled up with zeros.
    short = [(1, [0.5], 1), (2, [0.5, 0.0, 0.0, 0.0, 0.0], 1)]
    assert [r[1:3] for r in _codes(spark, short)] == [("00000000", 0), ("00000000", 0)]


def test_clashing_names(spark):
    rows = [(i, [float(i), 0.0, 1.0, 2.0], i % 2) for i in range(6)]
    table = spark.createDataFrame(rows, SCHEMA)
    clashing = table.withColumns({c: F.lit(c) for c in ("x", "id", "code", "error", "_label", "vector", "entry", "n")})
    assert sorted(map(tuple, compress(clashing).collect())) == _codes(spark, rows)


def test_too_large_a_component_fails(spark):
    with pytest.raises(Exception, match="exceeds"):
        _codes(spark, [(1, [3e30, 0.0, 0.0, 0.0], 1)])
