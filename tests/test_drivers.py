"""Runs that are killed and begun again."""

from __future__ import annotations

import numpy as np
import pytest

from simloom.operators import drivers as D
from simloom.operators import rowblocks as B
from simloom.scratch import Scratch

rng = np.random.default_rng(31)


@pytest.fixture(scope="module")
def of(spark):
    w = rng.random((24, 2))
    m = w @ w.T
    rows = [(i, j, float(m[i, j])) for i in range(24) for j in range(i, 24)]
    return B.blocks(spark.createDataFrame(rows, "i long, j long, s double"), Scratch(spark, "drivers"))


class Killed(Exception):
    pass


def _counted(monkeypatch, name, done, most):
    whole = getattr(B, name)

    def run(of, *args, **more):
        if len(done) == most:
            raise Killed
        done.append(more.get("cells") or args[1])
        return whole(of, *args, **more)

    monkeypatch.setattr(B, name, run)


def test_validation_goes_on(spark, of, tmp_path, monkeypatch):
    ask = dict(folds=2, gap=1, rounds=2, steps=4)
    straight = sorted(map(tuple, D.validate(of, f"{tmp_path}/a", [1, 5], **ask).collect()))
    done: list = []
    _counted(monkeypatch, "cross_validate", done, 2)
    with pytest.raises(Killed):
        D.validate(of, f"{tmp_path}/b", [1, 5], **ask)
    assert len(done) == 2
    monkeypatch.undo()
    _counted(monkeypatch, "cross_validate", done, 100)
    again = sorted(map(tuple, D.validate(of, f"{tmp_path}/b", [1, 5], **ask).collect()))
    cells = [c for batch in done for c in batch]
    assert again == straight and len(cells) == len(set(cells)) == len(straight) and {r[2] for r in straight} >= {1, 3, 5}
    before = len(done)
    assert sorted(map(tuple, D.validate(of, f"{tmp_path}/b", [1, 5], **ask).collect())) == straight and len(done) == before
    D.validate(of, f"{tmp_path}/b", [1], **{**ask, "steps": 3, "rounds": 0})
    assert len(done) == before + 1  # other settings are other tasks


def test_estimate_goes_on(spark, of, tmp_path, monkeypatch):
    done: list = []
    _counted(monkeypatch, "subspace_overlap", done, 1)
    with pytest.raises(Killed):
        D.estimate(of, f"{tmp_path}/e", k=2, rates=[0.6, 0.9], boots=2)
    monkeypatch.undo()
    _counted(monkeypatch, "subspace_overlap", done, 100)
    rows = D.estimate(of, f"{tmp_path}/e", k=2, rates=[0.6, 0.9], boots=2).collect()
    # k comes third: the rates are the second argument.
    assert len(rows) == 2 * 2 * 2 and len(done) == 2


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    ledger = D.Ledger(spark, f"{tmp_path}/l", {}, ["k"], "k long, x double")
    tasks = spark.range(6).withColumnRenamed("id", "k")

    def work(batch):
        df = spark.createDataFrame(batch, "k long").selectExpr("k", "cast(k as double) as x")
        return df.selectExpr("k", "if(k = 3, cast(raise_error('lost') as double), x) as x") if (3,) in batch else df

    with pytest.raises(Exception, match="lost"):
        ledger.run(tasks, work, 2)
    assert {r.k for r in ledger.rows().collect()} == {0, 1}
    assert ledger.run(tasks, lambda batch: spark.createDataFrame([(k, 0.5) for (k,) in batch], "k long, x double"), 2) == 4
    assert {r.k: r.x for r in ledger.rows().collect()} == {0: 0.0, 1: 1.0, 2: 0.5, 3: 0.5, 4: 0.5, 5: 0.5}
