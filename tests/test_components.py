from __future__ import annotations

import random

import pytest

from simloom.operators.components import connected_components, union_find


@pytest.mark.parametrize("one_task", [0, 1 << 17])
def test_components_match_union_find(spark, one_task):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), one_task_edges=one_task)
    want = union_find((a, b) for a, b in edges if a is not None)
    assert {r.node: r.component for r in got.collect()} == want


@pytest.mark.parametrize("one_task", [0, 1 << 17])
def test_no_edges_no_rows(spark, one_task):
    assert connected_components(spark.createDataFrame([], "src long, dst long"), one_task_edges=one_task).count() == 0
