"""Whitening against a plain eigendecomposition, and the contour solver against one."""

import numpy as np
import pytest

from presslake.llm import feast, whitening
from presslake.llm.common import tune

SCHEMA = "vec_id long, embedding array<double>, x string, size int, n long, component string"


def plain(rows, components, scale):
    out = {}
    by = {}
    for key, v in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            by.setdefault(len(v), []).append((key, tuple(int(np.floor(c * scale)) for c in v)))
    for size, members in by.items():
        fit = sorted({x for _, x in members})
        n = len(fit)
        total = [sum(x[i] for x in fit) for i in range(size)]
        c = np.array([[float(a) - s / n for a, s in zip(x, total)] for x in fit]).reshape(n, size)
        values, vectors = np.linalg.eigh(c.T @ c / n)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        trace = np.trace(c.T @ c / n)
        for key, x in members:
            away = np.array([a - s / n for a, s in zip(x, total)])
            dev = sum((n * a - s) ** 2 for a, s in zip(x, total))
            for i, e in enumerate(values):
                ok = e > size * 2.2e-16 * trace
                out.setdefault((key, i + 1), []).append((n, dev if dev < 1 << 63 else None, away @ vectors[:, i] / np.sqrt(e) if ok else None, (e if ok else 0.0) / trace if trace else None))
    return out


def agrees(got, want):
    assert len(got) == sum(map(len, want.values()))
    signs = {}
    for r in got:
        options = want[r.vec_id, r.component]
        n, dev, white, share = next(o for o in options if (o[0], o[1]) == (r.n, r.deviation))
        assert (r.explained is None) == (share is None) and (share is None or abs(r.explained - share) <= 1e-9)
        assert (r.whitened is None) == (white is None)
        if white is not None:
            assert abs(abs(r.whitened) - abs(white)) < 1e-7
            if abs(white) > 1e-3:
                signs.setdefault((n, r.component), set()).add(np.sign(r.whitened * white))
            assert r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_agrees_with_plain_form(spark):
    tune(spark)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13) / 7).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # copies count once
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [-0.0] * 12), (None, [1.0] * 12)]
    rows += [(3000 + i, rng.normal(size=3).tolist()) for i in range(40)] + [(4000, [])]
    df = spark.createDataFrame([(k, v, "c", 1, 2, "d") for k, v in rows], SCHEMA).repartition(7)
    agrees(whitening.whiten(df, 4).collect(), {k: v for k, v in plain(rows, 4, 256).items()})


@pytest.mark.parametrize("rows", [
    [(1, [1.0, 2.0])],
    [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0]), (3, [5.0, 2.0, 3.0])],
    [(i, [float(i % 2) * 1e9, float(i // 2) * 2e9, 3e9]) for i in range(4)],
])
def test_little_variance_and_large_numbers(spark, rows):
    tune(spark)
    agrees(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4).collect(), plain(rows, 4, 256))


def test_no_rows(spark):
    tune(spark)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("values", [
    np.arange(1, 41.0), np.ones(20), np.r_[np.zeros(10), 1, 1, 1, 2], 10.0 ** -np.arange(16), np.r_[-5.0, 1, 2, 3, 3 + 1e-7],
    [7.0], [2.0, 1.0], np.zeros(6), np.r_[np.linspace(1, 1.0001, 100), 50],
])
def test_contours_find_the_largest_pairs(values):
    rng = np.random.default_rng(len(values))
    turn, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    v = turn @ np.diag(values) @ turn.T
    got, vectors = feast.largest(v, 4)
    want = np.sort(np.asarray(values, float))[::-1][:4]
    size = np.abs(values).max() or 1.0
    assert np.abs(got - want).max() < 1e-13 * size * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * got).max() < 1e-13 * size * len(values)


def test_inertia_counts():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    shifts = np.linspace(-12, 12, 50)
    assert feast.above(feast.tridiagonal(a), shifts).tolist() == [(np.linalg.eigvalsh(a) > s).sum() for s in shifts]
