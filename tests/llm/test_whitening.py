"""Whitened vectors against a full eigendecomposition of the covariance, and exact sums in whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from strandlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, size string, component string, n string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c", "d") for i, v in rows], SCHEMA.replace("float", kind)).repartition(3)


def expected(rows, k=8):
    """Deviations, whitened (up to signs) and explained by numpy's eigh; vectors of one length."""
    use = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in use]
    n, s = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    c = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > e[0] * 1e-12).sum()))
    return [i for i, _ in use], dev, (c @ u[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(got, rows, rtol=1e-9):
    ids, dev, w, explained = expected(rows)
    k = w.shape[1]
    assert len(got) == len(ids) * k
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        mine = np.array([by[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ w[:, c])
        assert np.abs(mine - sign * w[:, c]).max() < rtol * max(1, np.abs(w[:, c]).max())
    assert all(by[i, 1].deviation == (d if d < 2**63 else None) for i, d in zip(ids, dev))
    for r in got:
        assert r.n == len(ids) and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-10) and 0 <= r.identity_error < 1e-9


def test_against_eigh(spark):
    rng = np.random.default_rng(4)
    data = (rng.standard_normal((400, 24)) * np.linspace(0.02, 0.4, 24) + rng.standard_normal(24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(900, None), (901, []), (902, [None] + [0.1] * 23), (903, [float("nan")] * 24), (904, [float("inf")] + [0.0] * 23), (905, [-0.0] * 24)]
    compare(whitening.whiten(table(spark, rows + odd)).collect(), rows + odd)


def test_other_lengths_and_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((30, 3)).astype(np.float32))]
    got = whitening.whiten(table(spark, [*rows, (50, [1.0, 2.0]), (51, [1.0] * 9)])).collect()
    compare(got, rows)
    got = whitening.whiten(table(spark, [(None, v) for _, v in rows])).collect()
    assert len(got) == 90 and {r.vec_id for r in got} == {None}


def test_no_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [float("nan")])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 0.25])])).count() == 0
    assert whitening.whiten(table(spark, [(i, [0.5, 0.25]) for i in range(9)])).count() == 0
    line = [(i, [0.25 * i, 0.5 * i, -0.25 * i]) for i in range(20)]  # one component only
    compare(whitening.whiten(table(spark, line)).collect(), line)


def test_large_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (v * 1e7).tolist()) for i, v in enumerate(rng.standard_normal((40, 4)))]
    compare(whitening.whiten(table(spark, rows, "double")).collect(), rows)
    got = whitening.whiten(table(spark, [*rows, (99, [1e300, -1e300, 0.0, 1.0])], "double")).collect()
    assert len(got) == 4 * 41 and all(math.isfinite(r.whitened) for r in got) and any(r.deviation is None for r in got)


@pytest.mark.parametrize("d", [1, 2, 9, 40, 130, 300])
def test_iteration(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.sort(rng.random(d))[::-1]
    if d >= 40:
        e[2] = e[1]  # a double eigenvalue
    a = (q * e) @ q.T
    asked = []

    def product(v):
        asked.append(v.shape[1])
        return a @ v

    k = min(8, d)
    values, u, error = whitening.leading(product, d, k)
    assert np.abs(values - e[:k]).max() < 1e-13 and error < 1e-13
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-13 and np.abs(a @ u - u * values).max() < 1e-12
    assert len(asked) < 300 and max(asked) <= whitening.SUBSPACE


def test_minres():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    b = rng.standard_normal((12, 3))
    shift = np.array([0.0, 1.0, -2.0])
    t = whitening.minres(lambda x: a @ x - x * shift, b, 12)
    for i in range(3):
        assert np.abs((a - shift[i] * np.eye(12)) @ t[:, i] - b[:, i]).max() < 1e-8
