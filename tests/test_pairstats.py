"""Tallies of distances against whole tables of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from simloom.operators import kernels as K
from simloom.operators import pairstats as P
from simloom.plans.catalog import QUERIES

rng = np.random.default_rng(77)


def _items(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def _apart(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(len(x), 1)]


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e7])
def test_squares_keep_digits_of_near_and_far_pairs(scale):
    x = rng.normal(size=(40, 5)) * scale + 1e3 * scale
    x[7], x[8] = x[3], x[3] * (1 + 1e-9)
    found, want = K.squares(x[:10], x), ((x[:10, None] - x[None]) ** 2).sum(-1)
    assert found[3, 7] == 0 and np.allclose(found, want, rtol=1e-9, atol=0)
    x[0, 0] = np.inf
    assert np.isinf(K.squares(x[1:3], x)[:, 0]).all() and K.squares(x[:0], x[:0]).shape == (0, 0)


@pytest.mark.parametrize("few", [0, 3, 1 << 20])
@pytest.mark.parametrize("block", [7, 1024])
def test_quantiles_of_distances(spark, monkeypatch, few, block):
    monkeypatch.setattr(P, "FEW", few)
    x = rng.normal(size=(31, 4))
    x[5:11], x[20], x[21] = x[4], 1e-7, 1e5  # zeros, and numbers of other sizes
    apart, shares = _apart(x), [0.0, 0.02, 0.3, 0.5, 0.98, 1.0]
    assert P.distance_quantiles(_items(spark, x), shares, block=block) == pytest.approx(np.quantile(apart, shares).tolist(), rel=1e-9)
    whole = np.r_[apart, apart, np.zeros(31)]
    assert P.distance_quantiles(_items(spark, x), shares, times=2, zeros=31, block=block) == pytest.approx(np.quantile(whole, shares).tolist(), rel=1e-9)


def test_quantiles_without_pairs_or_with_equal_ones(spark):
    assert P.distance_quantiles(_items(spark, np.ones((1, 2))), [0.5]) == [None] == P.distance_quantiles(_items(spark, np.ones((0, 2))), [0.5])
    assert P.distance_quantiles(_items(spark, np.ones((9, 2))), [0.0, 0.5]) == [0.0, 0.0]
    odd = _items(spark, np.array([[1.0], [np.nan], [4.0]]))
    assert not P.plain(odd) and P.quantiles_of(odd, [0.5]) == [3.0] and P.quantiles_of(_items(spark, np.ones((1, 2))), [0.5], times=2, zeros=1) == [0.0]


def _tables(tmp_path, x):
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [v.tolist() for v in x], "label": np.arange(len(x)) % 3}).to_parquet(tmp_path / "embeddings.parquet")
    return str(tmp_path)


def test_statistics_of_pairs_send_no_pair(spark, monkeypatch, tmp_path):
    x = rng.normal(size=(60, 64))
    d, apart = _tables(tmp_path, x), _apart(x)
    monkeypatch.setattr(K, "pairs", None)
    monkeypatch.setattr(K, "values", None)
    r = QUERIES["r1_correlate_rsms"](spark, d).first()
    assert (r.r, r.n) == (pytest.approx(np.corrcoef(_apart(x[:, :32]), _apart(x[:, 32:]))[0, 1], abs=1e-6), len(apart))
    k = QUERIES["k14_pair_percentile"](spark, d).first()
    assert [k.p98, k.p02, k.n] == pytest.approx([*np.quantile(apart, [0.98, 0.02]), len(apart)], abs=1e-6)
    e = -(apart**2) / (2 * np.median(apart) ** 2)
    entropy = lambda s: -sum(p * np.log2(p) for p in np.bincount(np.minimum((s * 100).astype(int), 99)) / len(s) if p)
    a12 = QUERIES["a12_histogram_entropy"](spark, d).first()
    assert [a12.bits, a12.nats] == pytest.approx([entropy(np.exp(e)), entropy(np.exp(e)) * np.log(2)], abs=1e-6)
    for a in QUERIES["a13_sigma_sweep"](spark, d).collect():
        s = np.exp(np.maximum(e / a.alpha**2, -50))
        assert [a.entropy, a.mean, a.high, a.low] == pytest.approx([entropy(s), s.mean(), (s > 0.95).mean(), (s < 0.05).mean()], abs=1e-6)
    for a in QUERIES["k8_reexponentiate"](spark, d).collect():
        s = np.exp(np.maximum(e / a.alpha**2, -50))
        assert [a.mean, a.low, a.high] == pytest.approx([s.mean(), s.min(), s.max()], abs=1e-6)


def test_medians_of_kernels_and_splits_write_no_pair(spark, monkeypatch, tmp_path):
    from simloom import scratch
    from simloom.operators import orderstats, transforms

    d = _tables(tmp_path, rng.normal(size=(30, 64)))
    monkeypatch.setattr(scratch.Scratch, "table", None)
    for module in (K, P, orderstats, transforms):
        monkeypatch.setattr(module, "quantiles", None, raising=False)
    assert all(QUERIES[n](spark, d).count() == 435 for n in ("v15_median_split", "k6_gaussian_kernel", "k7_rbf_median_bandwidth"))
