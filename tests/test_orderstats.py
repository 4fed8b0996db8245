"""Selection by bits against sorting."""

from __future__ import annotations

import numpy as np
import pytest

from simloom.operators import kernels, orderstats
from simloom.operators.orderstats import number_of, order_statistics, ordered_bits, quantiles

rng = np.random.default_rng(4)


def _frame(spark, x):
    return spark.createDataFrame([(None if v is None else float(v),) for v in x], "s double").repartition(3)


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e308, -1.5, -1.0, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1, 2), 2.0, np.inf])
    bits = ordered_bits(x)
    assert (np.diff(bits.astype(object)) > 0).all() and [number_of(int(b)) for b in bits] == x.tolist()
    assert ordered_bits(np.array([-0.0])) == ordered_bits(np.array([0.0]))


def test_ranks_of_numbers_of_all_sizes(spark):
    x = np.r_[rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), [0.0, -0.0, np.inf, -np.inf], np.repeat(1.25, 40)]
    order = np.sort(x)
    ranks = [0, 1, 17, 150, 200, 210, len(x) - 1]
    assert order_statistics(_frame(spark, [*x, None, np.nan]), ranks) == order[ranks].tolist()
    with pytest.raises(ValueError):
        order_statistics(_frame(spark, x), [len(x)])


def test_quantiles_with_weights(spark):
    x = rng.random(101)
    whole = np.r_[x, x, np.zeros(30)]
    shares = [0.0, 0.1, 0.5, 0.98, 1.0]
    assert np.allclose(quantiles(_frame(spark, x), shares, times=2, also={0.0: 30}), np.quantile(whole, shares), rtol=1e-14)
    assert quantiles(_frame(spark, []), [0.5]) == [None] and quantiles(_frame(spark, [None]), [0.5], also={2.0: 1}) == [2.0]


@pytest.mark.parametrize("few", [0, 1, 1 << 20])
def test_the_last_pass_brings_few_numbers(spark, monkeypatch, few):
    monkeypatch.setattr(orderstats, "FEW", few)
    x = np.r_[rng.normal(size=200), np.repeat(0.25, 20), np.nextafter(0.25, 1), [0.0, -0.0]]
    shares = [0.0, 0.02, 0.5, 0.55, 0.98, 1.0]
    assert np.allclose(quantiles(_frame(spark, x), shares), np.quantile(x, shares), rtol=1e-14)
    whole = np.r_[x, x, np.repeat(0.25, 7)]
    assert quantiles(_frame(spark, x), [0.5, 0.6], times=2, also={0.25: 7}) == pytest.approx(np.quantile(whole, [0.5, 0.6]).tolist(), rel=1e-14)


def test_quantiles_of_pairs_write_nothing(spark, monkeypatch):
    from simloom import scratch

    monkeypatch.setattr(scratch.Scratch, "table", None)  # a pair table of 1 GB of vectors doesn't fit
    x = rng.normal(size=(30, 4))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    apart = np.linalg.norm(x[:, None] - x[None], axis=2)[np.triu_indices(30, 1)]
    found = kernels.rbf(kernels.values(items, "euclidean", kind="distance", block=8))
    assert found.first().sigma == pytest.approx(np.median(apart)) and found.columns == ["s", "sigma"] and found.count() == 435
    wide = kernels.pairs(items, "gaussian_kernel", block=8)
    assert wide.columns == ["i", "j", "s"] and wide.count() == 435
