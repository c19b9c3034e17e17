"""Embedding whitening against numpy's eigenvectors on the whole matrix."""

import math

import numpy as np
import pytest

from roadlens.llm import whitening
from roadlens.session import ensure_checkpoint_dir

SCHEMA = "vec_id long, embedding array<float>, label int, x string, whitened int"


def vectors(d=24, n=300, seed=4):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((n, d)).astype(np.float32) * np.linspace(3, 0.5, d).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0, "y", 1) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1], 0, None, None) for i in range(150)] + [rows[7], (None, rows[8][1], 0, "", 0)]
    bad = [None, [], [None] * d, [float("nan")] * d, [math.inf] + [0.0] * (d - 1), [1.0] * (d + 1), [1e30] * d]
    return rows, [(2000 + i, b, 0, "z", 2) for i, b in enumerate(bad)]


def expected(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, vecs = np.linalg.eigh(np.cov(fit.T - 1_000_000.0, bias=True))
    values, vecs = values[::-1][:16], vecs[:, ::-1][:, :16]
    white = (x - s / n) @ vecs / np.sqrt(values)
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for v in x], white, values / np.trace(np.cov(fit.T, bias=True))


@pytest.mark.parametrize("d", [24, 64, 5])
def test_whitened_rows(spark, d):
    ensure_checkpoint_dir(spark)
    rows, bad = vectors(d)
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    table, fitted = whitening.whiten(df)
    out = whitening.report(table, fitted).collect()
    n, deviation, white, share = expected(rows)
    k = min(16, d)
    assert len(out) == len(rows) * k and {r.n for r in out} == {n}
    assert max(r.identity_error for r in out) < 1e-9
    got = {}
    for r in out:
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    sign = None
    for (vec_id, dev), comps in got.items():
        i = next(j for j, row in enumerate(rows) if row[0] == vec_id)
        assert dev == deviation[i] and sorted(comps) == list(range(1, k + 1))
        mine = np.array([comps[c][0].whitened for c in range(1, k + 1)])
        if sign is None and np.abs(white[i]).min() > 1e-3:
            sign = np.sign(mine) * np.sign(white[i])
        assert np.allclose(np.abs(mine), np.abs(white[i]), atol=1e-8)
        if sign is not None:
            assert np.allclose(mine * sign, white[i], atol=1e-8)
        assert all(abs(comps[c][0].explained - share[c - 1]) < 1e-9 for c in comps)
    assert sign is not None and (d <= 32 or fitted.passes > 10)


def test_few_distinct_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [2.0, 2.0, 5.0]
    df = spark.createDataFrame([(1, a), (2, a), (3, b)], "vec_id long, embedding array<float>")
    table, fitted = whitening.whiten(df)
    out = whitening.report(table, fitted).collect()
    assert fitted.n == 2 and sorted((r.vec_id, r.component) for r in out) == [(1, 1), (2, 1), (3, 1)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in out)
    for rows in ([], [(1, None)], [(1, a), (2, a)]):
        table, fitted = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        out = whitening.report(table, fitted)
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0


def test_tree_of_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    df = spark.createDataFrame([([i, 2 * i],) for i in range(100)], "x array<long>").repartition(7)
    assert whitening.tree_sum(df, lambda x: x.sum(axis=0), (2,), np.int64).tolist() == [4950, 9900]


def test_deviation_beyond_64_bits():
    w = whitening.Whitening(10**9, np.array([5 * 10**9, 7]), np.empty((2, 0)), np.empty(0), 1.0)
    assert w.deviations(np.array([[5, 0], [9, 0]])) == [49, None]
