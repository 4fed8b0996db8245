"""Readers and writers on small files."""

from __future__ import annotations

import json

import numpy as np
import pytest

from simloom.sources import readers


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_triplet_splits(spark, tmp_path):
    folder = tmp_path / "triplets_47"
    folder.mkdir()
    (folder / "trainset.txt").write_text("0 1 2\n3  4 5\n\n")
    (folder / "validationset.txt").write_text("6\t7 8\n")
    read = lambda split: _rows(readers.load(spark, "triplet_splits", str(tmp_path), split=split))
    assert read("train") == [(0, 1, 2), (3, 4, 5)]
    assert read("validation") == [(6, 7, 8)]
    assert read("train+validation") == [(0, 1, 2), (3, 4, 5), (6, 7, 8)]
    with pytest.raises(ValueError):
        read("test")
    with pytest.raises(ValueError):
        readers.load(spark, "no such source")


def test_associations(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("cue\tresponse\tR1\tN\tR1.Strength\tR123\tR123.Strength\na\tb\t2\t4\t0.5\t6\t0.25\na\t\t1\t4\t0.25\t1\t0.1\n")
    assert _rows(readers.load(spark, "associations", str(path))) == [("a", "b", 2.0, 0.5)]
    assert _rows(readers.load(spark, "associations", str(path), all_responses=True)) == [("a", "b", 6.0, 0.25)]
    full = readers.load(spark, "association_strengths", str(path))
    assert {"N", "R123.Strength"} < set(full.columns)
    assert sorted(tuple(r) for r in full.select("cue", "count", "strength").collect()) == [("a", 1.0, 0.1), ("a", 6.0, 0.25)]
    path.write_text("cue\tresponse\na\tb\n")
    with pytest.raises(ValueError):
        readers.load(spark, "association_strengths", str(path))


def test_ratings_edges_json(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("word," + ",".join(readers.RATINGS).replace("size", "semsize") + "\nDog,1,2,3,4,5,6,7,8,9\n")
    row = readers.load(spark, "ratings", str(path)).first()
    assert (row.word, row.arousal, row["size"], row.gender) == ("dog", 1.0, 8.0, 9.0)
    path.write_text("source,target,w\na,b,2\n")
    assert _rows(readers.load(spark, "edges", str(path))) == [("a", "b", 1.0)]
    assert _rows(readers.load(spark, "edges", str(path), weight="w")) == [("a", "b", 2.0)]
    (tmp_path / "good.json").write_text(json.dumps({"k": 1, "s": "x"}))
    (tmp_path / "bad.json").write_text("{")
    assert _rows(readers.load(spark, "json", str(tmp_path / "good.json"), str(tmp_path / "bad.json"), schema="k long, s string")) == [(1, "x")]


def test_matrix_and_word_vectors(spark, tmp_path):
    m = np.random.default_rng(0).random((5, 5))
    np.save(tmp_path / "m.npy", m)
    found = _rows(readers.load(spark, "matrix", str(tmp_path / "m.npy")))
    assert found == [(i, j, m[i, j]) for i in range(5) for j in range(i + 1, 5)]
    (tmp_path / "v.txt").write_text("2 3\nx 1 2 3\ny 4 5 6\n")
    assert _rows(readers.load(spark, "word_vectors", str(tmp_path / "v.txt"))) == [("x", [1.0, 2.0, 3.0]), ("y", [4.0, 5.0, 6.0])]


def test_cached_and_write(spark, tmp_path):
    path, made = str(tmp_path / "c"), []

    def make(n):
        made.append(n)
        return spark.range(n)

    read = lambda n, **more: readers.cached(lambda: make(n), spark, path, **more).count()
    assert [read(3), read(4), read(5, force=True)] == [3, 3, 5] and made == [3, 5]
    readers.write(spark.range(2), str(tmp_path / "w"))
    readers.write(spark.range(3), str(tmp_path / "w"), append=True)
    assert spark.read.parquet(str(tmp_path / "w")).count() == 5
    readers.write(spark.range(1), str(tmp_path / "w"), "json")
    assert spark.read.json(str(tmp_path / "w")).count() == 1


def test_trials(spark):
    t = lambda rows: spark.createDataFrame(rows, "stim long, trial long, channel long, x double")
    one, two = t([(1, 5, 1, 0.5), (1, 2, 1, 0.2), (2, 3, 1, 0.3)]), t([(1, 1, 1, 0.1)])
    assert _rows(readers.repetitions(one, two)) == [(1, 1, 1, 0.2), (1, 2, 1, 0.5), (1, 3, 1, 0.1), (2, 1, 1, 0.3)]
    r = spark.createDataFrame([(1, 0.1), (1, 0.5), (2, 0.1)], "channel long, r double")
    x = t([(1, 1, 1, 1.0), (1, 2, 1, 3.0), (1, 1, 2, 9.0)])
    assert _rows(readers.reliable(x, r)) == [(1, 1, 1.0), (1, 1, 3.0)]
    assert _rows(readers.reliable(x, r, average=True)) == [(1, 1, 2.0)]
    assert _rows(readers.reliable(x, r, None, average=True)) == [(1, 1, 2.0), (1, 2, 9.0)]
