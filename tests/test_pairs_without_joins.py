"""Tables of all pairs whose values come from other pairs or labels: no pair is joined or shuffled."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from simloom.operators import extras as X
from simloom.operators import kernels as K
from simloom.operators import triplets as T

rng = np.random.default_rng(8)


def _above(found):
    """The plan after the grid's product; without one, all of it."""
    above, product, _ = found._jdf.queryExecution().executedPlan().toString().partition("CartesianProduct")
    return above if product else ""


@pytest.mark.parametrize("compared", [1 << 20, 0])
def test_co_association_by_grid_and_by_join(spark, monkeypatch, compared):
    monkeypatch.setattr(X, "COMPARED", compared)
    rows = [(int(r), int(i), "abc"[rng.integers(3)]) for r in (3, 5, 9, 11) for i in range(25) if rng.random() < 0.6]
    rows += [(3, 40, None), (None, 41, "a"), (3, None, "a")]
    label = {(r, i): x for r, i, x in rows if None not in (r, i, x)}
    want = {p: n / 4 for p in itertools.combinations(range(25), 2) if (n := sum(label.get((r, p[0]), 0) == label.get((r, p[1]), 1) for r in (3, 5, 9, 11)))}
    found = X.co_association(spark.createDataFrame(rows, "run int, id long, label string"))
    assert {(r.i, r.j): r.c for r in found.collect()} == want and found.columns == ["i", "j", "c"]
    assert bool(_above(found)) == bool(compared) and "Exchange hash" not in _above(found)
    twice = X.co_association(spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "a"), (2, 2, "b")], "run int, id long, label string"))
    assert [tuple(r) for r in twice.collect()] == [(1, 2, 1.0)]


def test_filled_pairs_take_seen_ones_along(spark):
    wins = [(int(i), int(j), int(w), 5) for i, j in itertools.combinations(range(-3, 30), 2) if (w := rng.integers(0, 12)) <= 5]
    ids = list(range(-3, 26)) + [None]  # the last items are not among them
    found = T.similarity(spark.createDataFrame(wins, "i long, j long, wins long, trials long"), items=spark.createDataFrame([(i,) for i in ids], "id long"), fill=0.25)
    seen = {(i, j): (w + 1) / (t + 2) for i, j, w, t in wins}
    assert {(r.i, r.j): r.s for r in found.collect()} == {p: seen.get(p, 0.25) for p in itertools.combinations(range(-3, 26), 2)}
    blocks = K.filled(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([(*p, s) for p, s in seen.items()], "i long, j long, s double"), 0.25, block=7)
    assert sorted(blocks.collect()) == sorted(found.collect())
    above = _above(found)
    assert above and "Join" not in above and "Exchange" not in above
    again = T.similarity(spark.createDataFrame(wins[:3], "i long, j long, wins long, trials long"), items=spark.createDataFrame([(1,), (1,), (2,)], "id long"), fill=0.0)
    assert again.count() == 2
