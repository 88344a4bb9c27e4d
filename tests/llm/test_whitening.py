"""Whitening against exact arithmetic on the distinct integer vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from factloom.llm import whitening
from factloom.llm.whitening import add_scatter, bit_planes, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x long, dims int, component int, n long, total long"
TAIL = (0, 1, 2, 3, 4, 5)


def table(spark, rows):
    return spark.createDataFrame([(i, v, *TAIL) for i, v in rows], SCHEMA)


def plain(rows, dims):
    """Integer vectors of the rows that remain, and n, sums and covariance of the distinct ones."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)))
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(x[d] for x in fit) for d in range(dims)]
    centred = [[n * x[d] - sums[d] for d in range(dims)] for x in fit]
    v = np.array([[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(dims)] for i in range(dims)])
    return kept, n, sums, v


def odd_rows(dims=6):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(dims, dims)) * np.array([9, 5, 3, 2, 1, 0.5])
    rows = [(i, [float(c) for c in rng.normal(size=dims) @ mix]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [rows[0], (None, rows[1][1])]
    rows += [(2000, None), (2001, [math.nan] * dims), (2002, [1.0, None] + [0.0] * (dims - 2)), (2003, []), (2004, [math.inf] + [0.0] * (dims - 1))]
    return rows + [(2005, [1.0, 2.0]), (2006, [-0.001] * dims)]


def check(got, rows, dims, k):
    kept, n, sums, v = plain(rows, dims)
    e = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == len(kept) * k
    xs = dict(kept)
    z = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9)
        if r.vec_id is not None:
            assert r.deviation == sum((n * x - s) ** 2 for x, s in zip(xs[r.vec_id], sums, strict=True))
            z.setdefault(r.vec_id, {})[r.component] = r.whitened
    ids = sorted(z)
    x = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(xs[i], sums, strict=True)] for i in ids])
    w = np.array([[z[i][c] for c in range(1, k + 1)] for i in ids])
    vectors = np.linalg.lstsq(x, w, rcond=None)[0] * np.sqrt(e[:k])
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-8)
    assert np.allclose(v @ vectors, vectors * e[:k], atol=1e-8 * e[0])
    assert np.allclose(x @ vectors / np.sqrt(e[:k]), w, atol=1e-8)


def test_whitening(spark, monkeypatch):
    rows = odd_rows()
    found = table(spark, rows).repartition(3)
    check(whiten(found).collect(), rows, 6, 6)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    check(whiten(found, components=2).collect(), rows, 6, 2)


def test_degenerate_tables(spark):
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, [])] * 3)).count() == 0
    assert whiten(table(spark, [(1, None), (2, [math.nan])])).count() == 0
    assert whiten(table(spark, [(i, [1.0, 2.0]) for i in range(4)])).count() == 0  # copies of one vector
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]  # one direction only
    got = whiten(table(spark, flat)).collect()
    assert len(got) == 10 and got[0].explained == pytest.approx(1)


def test_far_entries(spark):
    rows = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [3.0, 2.0]), (3, [5.0, -1.0])]
    got = whiten(table(spark, rows)).collect()
    assert len(got) == 4 * len({r.component for r in got})
    x = [[max(-(1 << 53), min(1 << 53, math.floor(64 * c))) + 1_000_000 for c in v] for _, v in rows]
    exact = [sum((4 * c - sum(y[d] for y in x)) ** 2 for d, c in enumerate(v)) for v in x]
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None) for r in got)
    assert {r.vec_id for r in got if r.deviation is None} == {0, 1}


@pytest.mark.parametrize("bits", [1, 7, 17, 40])
def test_scatter_of_bit_planes_is_exact(bits):
    rng = np.random.default_rng(bits)
    y = rng.integers(0, 1 << bits, size=(130, 5))
    limbs = (2 * bits) // whitening.LIMB + 1
    sums, products = np.zeros((limbs, 5), np.int64), np.zeros((limbs, 5, 5), np.int64)
    for a in range(0, 130, 64):
        add_scatter(bit_planes(y[a : a + 64], bits), sums, products)

    def whole(parts):
        return sum(int(p) << (whitening.LIMB * k) for k, p in enumerate(parts))

    exact = y.astype(object)
    assert [whole(sums[:, i]) for i in range(5)] == list(exact.sum(axis=0))
    assert all(whole(products[:, i, j]) == (exact[:, i] * exact[:, j]).sum() for i in range(5) for j in range(i, 5))
