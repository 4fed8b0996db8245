"""Information of pairs of dimensions from counts that add up."""

from __future__ import annotations

import numpy as np
import pytest

from simloom.operators import kernels as K
from simloom.operators.clusters import information_of_pairs, mutual_information
from simloom.plans.models import c4_plugged

rng = np.random.default_rng(12)


def test_counts_add_up_over_tasks_with_ties_and_gaps(spark):
    rows = [(i, d, float(rng.integers(0, 9))) for i in range(90) for d in (2, 5, 6, 11) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "id long, dim long, x double").repartition(3)
    found, want = ({(r.d1, r.d2): r.mi for r in f(df, 4).collect()} for f in (information_of_pairs, mutual_information))
    assert found == pytest.approx(want, abs=1e-12) and len(found) == 6 and information_of_pairs(df.limit(0), 4).count() == 0


def test_no_dimension_is_one_array(spark, monkeypatch, tmp_path):
    x = rng.normal(size=(70, 5)).round(1)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(K, "pairs", None)
    want = K.information(10)(x.T, x.T)
    assert {(r.d1, r.d2): r.mi for r in c4_plugged(spark, str(tmp_path)).collect()} == pytest.approx({(a + 1, b + 1): want[a, b] for a in range(5) for b in range(a + 1, 5)}, abs=1e-6)
