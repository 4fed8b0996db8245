"""Alignment with items left out against a new assignment for each item, and its test."""

from __future__ import annotations

from itertools import permutations as orders

import numpy as np
import pytest

from simloom.functions.numeric import assignment, central_potentials, even_potentials, mended
from simloom.operators import alignment as A

rng = np.random.default_rng(8)


def _frame(spark, x, w):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, w, strict=True))], "id long, x array<double>, w array<double>")


def _best(corr):
    k = len(corr)
    return max(orders(range(k)), key=lambda o: sum(corr[d, o[d]] for d in range(k)))


def _naive(x, w):
    k, out = x.shape[1], []
    for i in range(len(x)):
        rest = np.arange(len(x)) != i
        out.append(_best(np.corrcoef(x[rest].T, w[rest].T)[:k, k:]))
    return np.array(out)


def _planted(n, k, noise):
    x = rng.random((n, k))
    return x, x[:, rng.permutation(k)] + noise * rng.random((n, k))


def test_assignments_mended_from_another():
    for k in (1, 2, 5, 9, 20):
        cost = rng.normal(size=(k, k))
        match, proof = assignment(cost)
        central = central_potentials(cost, match)
        for potential in (proof, central):
            reduced = cost - potential
            assert (reduced[np.arange(k), match] <= reduced.min(1) + 1e-9).all()
        for size in (0, 1e-3, 0.1, 1.0, 10.0):
            others = cost + size * rng.normal(size=(12, k, k))
            assert all((a == assignment(c)[0]).all() for a, c in zip(mended(others, central, match), others, strict=True))


@pytest.mark.parametrize("noise", [0.2, 3.0, 100.0])
def test_left_out_equals_new_assignments(spark, noise):
    x, w = _planted(60, 5, noise)
    rows = {r.id: r for r in A.aligned(_frame(spark, x, w).repartition(3)).collect()}
    naive = _naive(x, w)
    assert all((np.array(rows[i].match) - 1 == naive[i]).all() for i in range(60))
    assert all(np.allclose(rows[i].w, w[i, naive[i]]) for i in range(60))
    r = {t.dim: t.r for t in A.aligned_correlations(A.aligned(_frame(spark, x, w))).collect()}
    moved = np.take_along_axis(w, naive, 1)
    assert all(abs(r[d + 1] - np.corrcoef(x[:, d], moved[:, d])[0, 1]) < 1e-10 for d in range(5))
    whole = A.aligned(_frame(spark, x, w), leave_out=False).first()
    assert tuple(np.array(whole.match) - 1) == _best(np.corrcoef(x.T, w.T)[:5, 5:])


def test_null_aligns_again_each_time(spark):
    x, w = _planted(25, 4, 1.0)
    got = {(r.perm, r.dim): r.r for r in A.alignment_null(_frame(spark, x, w), 6, seed=3).collect()}
    for perm in range(7):
        moved = x[np.random.default_rng([3, perm]).permutation(25)] if perm else x
        fit = np.take_along_axis(w, _naive(moved, w), 1)
        assert all(abs(got[perm, d + 1] - np.corrcoef(moved[:, d], fit[:, d])[0, 1]) < 1e-10 for d in range(4))


def test_recovered_and_lost_dimensions(spark):
    x, w = _planted(80, 4, 0.3)
    lost = assignment(-A.correlations(A.moments(x, w)))[0][2]
    w[:, lost] = rng.random(80)
    rows = {r.dim: r for r in A.alignment_test(_frame(spark, x, w), 200).collect()}
    assert all(rows[d].rejected and rows[d].p == pytest.approx(1 / 201) for d in (1, 2, 4))
    assert not rows[3].rejected and rows[3].p_adjusted >= rows[3].p


def test_edges(spark):
    empty = _frame(spark, np.zeros((0, 2)), np.zeros((0, 2)))
    assert A.aligned(empty).collect() == A.alignment_null(empty, 3).collect() == A.alignment_test(empty, 3).collect() == []
    flat = _frame(spark, np.ones((5, 2)), rng.random((5, 2)))
    assert {r.r for r in A.alignment_test(flat, 4).collect()} == {None} and {r.p for r in A.alignment_test(flat, 4).collect()} == {1.0}
    one = A.aligned(_frame(spark, rng.random((1, 3)), rng.random((1, 3)))).collect()
    assert sorted(one[0].match) == [1, 2, 3]


@pytest.mark.parametrize("few", [20, 5000])
@pytest.mark.parametrize(("n", "noise"), [(2000, 1.0), (2000, 100.0), (30, 100.0)])
def test_few_items_are_aligned_anew(monkeypatch, n, noise, few):
    x, w = _planted(n, 6, noise)
    w[5] += 50  # far from all others
    m, aligned = A.moments(x, w), []
    monkeypatch.setattr(A, "_FEW", few)
    monkeypatch.setattr(A, "_without", lambda m, x, w, old=A._without: aligned.append(len(x)) or old(m, x, w))
    got = A.left_out(m, x, w)
    whole = assignment(-A.correlations(m))[0]
    changed = (got != whole).any(1)
    cost = -A.correlations(A.Moments(np.full(n, n - 1), m.x - x, m.w - w, m.xx - x * x, m.ww - w * w, m.xw - x[:, :, None] * w[:, None, :]))
    assert all((a == assignment(c)[0]).all() for a, c in zip(got, cost, strict=True))
    assert sum(aligned) <= 2 + 2 * changed.sum()


def test_potentials_leave_even_room():
    for k in (1, 2, 6, 15):
        cost = rng.normal(size=(k, k))
        match = assignment(cost)[0]
        reduced = cost - even_potentials(cost, match)
        room = np.where(np.arange(k) == match[:, None], np.inf, reduced - reduced[np.arange(k), match][:, None]).min(initial=np.inf)
        other = cost - central_potentials(cost, match)
        assert room >= 0.97 * np.where(np.arange(k) == match[:, None], np.inf, other - other[np.arange(k), match][:, None]).min(initial=np.inf)
