"""Nested samples of triplets, and scores of fits to them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from simloom.functions.hashing import uniform
from simloom.operators import lowdata as L
from simloom.operators import triplets as T

rng = np.random.default_rng(41)


def _judged(spark, x, many):
    out = []
    while len(out) < many:
        a, b, c = (int(k) for k in rng.choice(len(x), 3, replace=False))
        s = {(a, b, c): x[a] @ x[b], (a, c, b): x[a] @ x[c], (b, c, a): x[b] @ x[c]}
        out.append(max(s, key=s.get))
    return spark.createDataFrame(out, "a long, b long, c long")


def test_counts_of_each_sample_alone(spark):
    triplets = _judged(spark, rng.random((9, 3)), 300)
    shares = [0.1, 0.5, 1.0]
    got = sorted(map(tuple, L.nested_wins(triplets, [1.0, 0.1, 0.5, 0.5]).collect()))
    want = []
    for f in shares:
        sample = triplets.where(uniform(F.lit("fraction0"), *(F.col(c).cast("string") for c in "abc")) < f)
        want += [(f, *r) for r in T.pair_wins(sample).collect()]
    assert got == sorted(want)
    assert L.nested_wins(triplets, [0.0]).collect() == [] and L.nested_wins(triplets.where("false"), shares).collect() == []


def test_more_judgements_tell_more(spark):
    x = np.kron(np.eye(4), np.ones((10, 1))) + 0.1 * rng.random((40, 4))
    train, test = _judged(spark, x, 12000), _judged(spark, x, 600)
    rows = {r.fraction: r for r in L.low_data_curve(train, test, [0.02, 1.0], [4], steps=60).collect()}
    assert rows[1.0].accuracy > 0.6 and rows[1.0].accuracy > rows[0.02].accuracy and rows[1.0].n == 600
