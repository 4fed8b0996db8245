"""Connected components of an edge table, without a driver-side graph.

Each partition first contracts its own edges with union-find, then large-star
and small-star steps (Kiveris et al., 2014) run until the edges form stars.
Every step is two joins or aggregations on node ids; a hub's rows are split by
the adaptive skew join and its minimum is pre-aggregated on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.scratch import Scratch


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node that occurs in ``pairs`` with its component's smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Memory is bounded by contracting every batch alone, not the partition.
    for batch in batches:
        found = union_find(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        rows = [(x, r) for x, r in found.items() if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["u", "v"]
        )


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = union_find((a, b) for x in batches for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["node", "component"])


#: Edges, once each, that one task may hold; more take the distributed steps.
ONE_TASK_EDGES = 1 << 17


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", *, scratch: Scratch | None = None, one_task_edges: int = ONE_TASK_EDGES
) -> DataFrame:
    """``(node, component)`` for each node on an edge; component is the smallest node id reachable.

    Edge tables of a counted, bounded size are joined up by union-find in one
    task; larger ones by star steps on the cluster, with the same result.

    Edges with a null end are ignored; a self-loop gives a component of one;
    repeated and reversed edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "components")
    ends = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    nodes = scratch.table(ends, "cc_edges")
    # u > v from here on: u hangs below v.
    if nodes.count() <= one_task_edges:
        return scratch.table(nodes.coalesce(1).mapInArrow(_one_task, "node long, component long"), "cc_nodes")
    step = scratch.table(nodes.mapInArrow(_contract, "u long, v long").distinct(), "cc_0")
    mark, k = None, 0
    while True:
        now = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark, k = now, k + 1
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        step = scratch.table(small, f"cc_{k}")
        if k > 1:
            scratch.drop(f"cc_{k - 1}")
    roots = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(step.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
