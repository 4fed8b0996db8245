"""Registered queries on all of their input."""

from __future__ import annotations

from collections import defaultdict

from simloom.plans.catalog import QUERIES


def test_components_over_all_lines(spark, tmp_path):
    # Parts 1..6 and suppliers 1..4; few lines have a large quantity.
    lines = [(1, 1, 50.0), (2, 1, 3.0), (2, 2, 7.0), (3, 2, 50.0), (3, 2, 1.0), (4, 3, 50.0), (5, 3, 50.0), (6, 4, 2.0), (6, 3, 50.0)] + [(k, 2, 1.0) for k in range(7, 12)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for part, supplier, _ in lines:
        parent[root(part)] = root(-supplier - 1)
    groups = defaultdict(set)
    for part, supplier, _ in lines:
        groups[root(part)].add((part, -supplier - 1))
    largest = max(groups.values(), key=lambda g: len({x for e in g for x in e}))
    assert {tuple(r) for r in QUERIES["g3_components_of_suppliers"](spark, str(tmp_path)).collect()} == largest
