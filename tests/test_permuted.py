"""Permutation tests, ranks, probes and assignments against plain NumPy."""

from __future__ import annotations

from itertools import permutations as orders

import numpy as np
import pytest

from simloom.operators import correlation as R
from simloom.operators import permuted, probes
from simloom.operators.clusters import mapped_accuracy

rng = np.random.default_rng(5)


def _pairs(spark, m, gone=()):
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(i + 1, len(m)) if (i, j) not in gone]
    return spark.createDataFrame(rows, "i long, j long, s double")


def _symmetric(n):
    m = rng.random((n, n))
    return m + m.T


@pytest.mark.parametrize("strata", [None, "g"])
def test_mantel_dense_as_joined(spark, strata):
    n = 12
    a, b = _symmetric(n), _symmetric(n)
    one, two = _pairs(spark, a, {(0, 3)}), _pairs(spark, b, {(2, 5), (1, 2)})
    ids = spark.createDataFrame([(k, k % 3) for k in range(n)], "id long, g long")
    codes = np.arange(n) % 3 if strata else None
    dense = {r.perm: r.r for r in permuted.mantel_null(one, two, np.arange(n), 20, strata=codes).collect()}
    joined = {r.perm: r.r for r in R._mantel_joined(one, two, ids, 20, strata, 0).collect()}
    assert sorted(dense) == sorted(joined) == list(range(21))
    assert all(abs(dense[k] - joined[k]) < 1e-12 for k in dense)


def test_mantel_of_itself_and_of_constants(spark):
    m = _symmetric(8)
    ids = spark.range(8)
    row = R.mantel(_pairs(spark, m), _pairs(spark, m), ids, 30).first()
    assert row.r == 1.0 and row.p == pytest.approx(1 / 31)
    flat = R.mantel(_pairs(spark, np.ones((8, 8))), _pairs(spark, m), ids, 5).first()
    assert flat.r is None


def test_rsa_against_products(spark, monkeypatch):
    n, k, perms = 14, 3, 15
    x, s = rng.normal(size=(n, k)), _symmetric(n)
    gone = {(0, 1), (4, 9)}
    features = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, v array<double>")
    found = {(r.perm, r.dim): r.r for r in permuted.rsa_null(features, _pairs(spark, s, gone), perms).collect()}
    at = [(i, j) for i in range(n) for j in range(i + 1, n)]
    for perm in range(perms + 1):
        to = permuted.permuted(np.arange(n), perm, 0)
        lo = [(min(to[i], to[j]), max(to[i], to[j])) for i, j in at]
        kept = [(p, q) for p, q in zip(at, lo, strict=True) if q not in gone]
        for d in range(k):
            r = np.corrcoef([x[i, d] * x[j, d] for (i, j), _ in kept], [s[q] for _, q in kept])[0, 1]
            assert found[perm, d + 1] == pytest.approx(r, abs=1e-10)


def test_ranks_with_ties_and_nulls(spark):
    x = [3.0, 1.0, 1.0, None, 2.0, 3.0, 3.0]
    got = R.ranked(spark.createDataFrame(list(enumerate(x)), "k long, x double"), "x", "r")
    assert [r.r for r in got.orderBy("k").collect()] == [5.0, 1.5, 1.5, None, 3.0, 5.0, 5.0 + 0.0]


def test_lasso_path_meets_its_conditions():
    a = rng.normal(size=(80, 6))
    g, c = a.T @ a / 80, a.T @ (a @ [2, 0, 0, -1, 0, 0.1] + rng.normal(size=80)) / 80
    for alpha, w in zip((0.5, 0.05, 0.001), probes.lasso_path(g, c, np.array([0.5, 0.05, 0.001])).T, strict=True):
        slope = g @ w - c
        assert np.all(np.abs(slope) <= alpha + 1e-6)
        assert np.allclose(slope[w != 0], -alpha * np.sign(w[w != 0]), atol=1e-6)


@pytest.mark.parametrize("kind", ["lasso", "ridge"])
def test_nested_cv_against_rows(spark, kind):
    n, d = 120, 4
    x = rng.normal(size=(n, d)) * [1, 5, 1, 1] + 2
    y = x @ [1.0, -0.5, 0.0, 0.0] + rng.normal(size=n)
    items = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(n)] + [(n, [0.0] * d, None)], "id long, v array<double>, y double")
    found, models = probes.nested_cv(items, kind, inner=3)
    folds = {r.id: (r.fold, r.inner) for r in probes.with_folds(items, 5, 3).collect()}
    got = {r.id: r.predicted for r in found.collect()}
    assert sorted(got) == list(range(n))
    outer, inner = (np.array([folds[i][k] for i in range(n)]) for k in (0, 1))
    chosen = {r.fold: r.alpha for r in models.collect()}

    def fit(a, b, alphas):
        mu, m = a.mean(0), b.mean()
        if kind == "ridge":
            w = np.column_stack([np.linalg.solve((a - mu).T @ (a - mu) + t * np.eye(d), (a - mu).T @ (b - m)) for t in alphas])
        else:
            w = np.zeros((d, len(alphas)))
            for c, t in enumerate(alphas):
                for _ in range(400):
                    for k in range(d):
                        rest = b - m - (a - mu) @ w[:, c] + (a[:, k] - mu[k]) * w[k, c]
                        z = (a[:, k] - mu[k]) @ rest / len(b)
                        w[k, c] = np.sign(z) * max(abs(z) - t, 0) / np.mean((a[:, k] - mu[k]) ** 2)
        return w, m - mu @ w

    for f in sorted(chosen):
        tr = outer != f
        mu, sd = x[tr].mean(0), x[tr].std(0)
        z = (x - mu) / sd
        if kind == "ridge":
            alphas, loss = probes.RIDGE, np.zeros(len(probes.RIDGE))
            for g in range(3):
                a, b = tr & (inner != g), tr & (inner == g)
                w, c = fit(z[a], y[a], alphas)
                loss += ((z[b] @ w + c - y[b][:, None]) ** 2).sum(0)
            assert chosen[f] == pytest.approx(alphas[loss.argmin()])
        w, c = fit(z[tr], y[tr], [chosen[f]])
        for i in np.flatnonzero(~tr):
            assert got[i] == pytest.approx(z[i] @ w[:, 0] + c[0], abs=1e-5)


def test_accuracy_of_the_best_assignment(spark):
    t, p = rng.integers(0, 4, 60), rng.integers(0, 3, 60)
    best = max(np.mean(np.array(o)[p] == t) for o in orders(range(4), 3))
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(t, p, strict=True)], "t long, p long")
    assert mapped_accuracy(rows, "t", "p").first().accuracy == pytest.approx(best)


@pytest.mark.parametrize("strata", [None, "label"])
def test_mantel_of_many_items_has_no_table_of_pairs(spark, monkeypatch, strata):
    x = np.random.default_rng(3).normal(size=(23, 5))
    x[7] = x[8]
    items = spark.createDataFrame([(2 * i, i % 3, v[:3].tolist(), v[2:].tolist()) for i, v in enumerate(x)], "id long, label long, v array<double>, w array<double>")
    want = R.mantel_of(items, 40, strata=strata).first()
    for name in ("mantel_null", "_mantel_joined"):
        monkeypatch.setattr(permuted if hasattr(permuted, name) else R, name, None)
    monkeypatch.setattr(permuted, "DENSE", 5)
    got = R.mantel_of(items, 40, strata=strata).first()
    assert abs(got.r - want.r) < 1e-11 and got.p == want.p
    tiled = permuted.mantel_tiles(items, 6, strata=strata, block=4).toPandas().sort_values("perm").r.to_numpy()
    assert np.allclose(tiled, permuted.mantel_tiles(items, 6, strata=strata).toPandas().sort_values("perm").r.to_numpy(), atol=1e-12)


def test_feature_test_in_tiles_as_with_the_pair_table(spark):
    from simloom.operators import kernels as K
    from simloom.operators import permuted as P

    x = np.random.default_rng(3).normal(size=(70, 4)) * [3, 1, 0.5, 0]
    x[:, 3] = 2
    items = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    tiles = {(r.perm, r.dim): r.r for r in P.rsa_tiles(items, 20, block=16).collect()}
    table = {(r.perm, r.dim): r.r for r in P.rsa_null(items, K.pairs(items, "euclidean", kind="distance"), 20).collect()}
    assert tiles.keys() == table.keys() and all(tiles[p, 4] is None for p in range(21))
    assert max(abs(tiles[k] - table[k]) for k in tiles if k[1] < 4) < 1e-9
    odd = spark.createDataFrame([(1, [1.0]), (2, [float("nan")])], "id long, v array<double>")
    assert P.rsa_tiles(odd, 3) is None
