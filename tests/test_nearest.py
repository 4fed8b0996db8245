"""Nearest items against a whole matrix of similarities."""

from __future__ import annotations

import numpy as np
import pytest

from simloom.operators import kernels as K
from simloom.operators.nearest import nearest

rng = np.random.default_rng(31)


def _items(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("block", [5, 1024])
def test_nearest_with_copies_and_without_a_pair_table(spark, monkeypatch, block):
    x = rng.normal(size=(53, 6))
    x[10:20], x[30:33], x[40:44] = x[9], x[29], 2.0  # copies tie, the last ones have no variance
    z = x - x.mean(1, keepdims=True)
    norm = np.linalg.norm(z, axis=1)
    s = np.clip(np.divide((z[:, None] * z[None]).sum(-1), norm[:, None] * norm[None], out=np.zeros((53, 53)), where=(norm > 0)[:, None] & (norm > 0)[None]), -1, 1)
    want = {(i, k + 1): (j, s[i, j]) for i in range(53) for k, j in enumerate(sorted((j for j in range(53) if j != i), key=lambda j: (-s[i, j], j))[:4])}
    monkeypatch.setattr(K, "pairs", None)
    found = {(r.i, r["rank"]): (r.j, r.s) for r in nearest(_items(spark, x), 4, block=block).collect()}
    assert found.keys() == want.keys() and all(found[k][0] == j and abs(found[k][1] - v) < 1e-12 for k, (j, v) in want.items())


def test_few_items_and_odd_numbers(spark):
    assert nearest(_items(spark, rng.normal(size=(3, 4))), 5).count() == 6 and nearest(_items(spark, np.ones((0, 2))), 5).count() == 0
    assert nearest(_items(spark, np.array([[1.0, 2.0], [np.nan, 1.0], [2.0, 5.0]])), 1).count() == 3
