"""Cell functions of a caller's in the block grid."""

from __future__ import annotations

import numpy as np
import pytest

from simloom.operators import kernels as K

rng = np.random.default_rng(51)


def _items(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def _rank(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


@pytest.mark.parametrize("block", [4, 512])
def test_a_function_of_two_vectors(spark, block):
    x = rng.integers(0, 5, size=(13, 9)).astype(float)
    got = {(r.i, r.j): r.s for r in K.pairs(_items(spark, x), K.pairwise(lambda a, b: float(np.abs(a - b).max())), block=block).collect()}
    assert got == {(i, j): np.abs(x[i] - x[j]).max() for i in range(13) for j in range(i + 1, 13)}
    ranks = {(r.i, r.j): r.s for r in K.pairs(_items(spark, x), K.spearman, block=block).collect()}
    assert all(abs(s - np.corrcoef(_rank(x[i]), _rank(x[j]))[0, 1]) < 1e-12 for (i, j), s in ranks.items()) and len(ranks) == 78


def test_unknown_names_and_empty_tables(spark):
    with pytest.raises(ValueError, match="unknown metric"):
        K.pairs(_items(spark, rng.random((3, 2))), "nothing")
    assert K.pairs(_items(spark, rng.random((0, 2))), K.spearman).collect() == []


def test_the_grid_moves_no_vector_but_once(spark):
    plan = K.pairs(_items(spark, rng.random((40, 3))), "cosine", block=4)._jdf.queryExecution().executedPlan().toString()
    above, product, below = plan.partition("CartesianProduct")
    assert product and "Exchange" not in above and below


def test_vectors_of_two_lengths_are_refused(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="of one length"):
        K.pairs(items, "dot").collect()


@pytest.mark.parametrize("fisher", [False, True])
def test_subjects_are_averaged_within_a_cell(spark, fisher):
    x = rng.normal(size=(9, 6))
    x[3, :3], x[4, :3] = 0, x[5, :3]  # a zero vector, and a correlation of 1
    found = K.pairs(_items(spark, x), K.group("pearson", 2, fisher=fisher), block=4)
    assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString().partition("CartesianProduct")[0]
    each = [{(r.i, r.j): r.s for r in K.pairs(_items(spark, v), "pearson").collect()} for v in (x[:, :3], x[:, 3:])]
    tagged = spark.createDataFrame([(k, i, j, s) for k, m in enumerate(each) for (i, j), s in m.items()], "subject long, i long, j long, s double")
    mean = {(r.i, r.j): r.s for r in K.group_mean(tagged, fisher=fisher).collect()}
    assert {(r.i, r.j): r.s for r in found.collect()} == pytest.approx(mean, abs=1e-12)


@pytest.mark.parametrize(("block", "most"), [(256, 1 << 22), (4, 1), (5, 40)])
def test_softmax_of_triplets_in_tiles(spark, block, most):
    x = rng.normal(size=(14, 3))
    e, n = np.exp(x @ x.T), 14
    want = {(i, j): sum(e[i, j] / (e[i, j] + e[i, k] + e[j, k]) for k in range(n) if k not in (i, j)) / (n - 2) for i in range(n) for j in range(i + 1, n)}
    assert {(r.i, r.j): r.s for r in K.softmax_triplet_similarity(_items(spark, x), block, most).collect()} == pytest.approx(want, abs=1e-12)
    assert K.softmax_triplet_similarity(_items(spark, x[:0]), block, most).collect() == []


def test_information_in_pieces_needs_little_memory():
    import tracemalloc

    from simloom.operators import kernels

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(6, 60_001)).round(2), rng.normal(size=(5, 60_001)).round(2)
    y[0] = x[0] + 0.1 * y[0]
    tracemalloc.start()
    found = kernels.information(10)(x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tile = lambda v: np.argsort(np.argsort(v, kind="stable")) * 10 // len(v)

    def plain(a, b):
        n = np.histogram2d(tile(a), tile(b), bins=(np.arange(11), np.arange(11)))[0] / len(a)
        apart = n.sum(1)[:, None] * n.sum(0)[None]
        return (n * np.log(n / apart, where=n > 0, out=np.zeros_like(n))).sum()

    assert np.allclose(found, [[plain(a, b) for b in y] for a in x], atol=1e-4) and most < 48e6, most
