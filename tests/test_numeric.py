from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from simloom.functions.numeric import beta_cdf, correlation_p, hungarian, sym_nmf, symmetric_eigen
from simloom.operators.spectral import aligned


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10_000))
def test_assignment_is_optimal(n, seed):
    cost = np.random.default_rng(seed).normal(size=(n, n))
    got = hungarian(cost)
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
    assert math.isclose(cost[np.arange(n), got].sum(), best, abs_tol=1e-9)


def test_beta_and_correlation_p():
    assert beta_cdf(0.3, 2, 5) == pytest.approx(0.579825)
    assert correlation_p(0.5, 20) == pytest.approx(0.02477, abs=1e-4)


def test_eigenvectors_are_signed_and_sorted():
    a = np.random.default_rng(1).normal(size=(8, 8))
    values, vectors = symmetric_eigen(a + a.T)
    assert (np.diff(values) <= 0).all()
    assert (vectors[np.abs(vectors).argmax(0), np.arange(8)] > 0).all()


@pytest.mark.parametrize("missing", [0.0, 0.4])
def test_planted_factors_are_found(missing):
    rng = np.random.default_rng(3)
    w = rng.random((60, 6)) * (rng.random((60, 6)) > 0.5)
    s = w @ w.T
    hidden = np.triu(rng.random(s.shape) < missing, 1)
    hidden |= hidden.T
    x = np.where(hidden, np.nan, s)
    got, _ = sym_nmf(x, 6, seed=1, outer=300, low=0.0, high=float(s.max()))
    assert (got >= 0).all()
    i = np.triu_indices(60, 1)
    assert np.corrcoef((got @ got.T)[i], s[i])[0, 1] > 0.95
    assert aligned(w, got, by="correlation")[1].mean() > 0.8
