"""The nearest items of each item, chosen where similarities are made.

A task goes over its cells of the block grid and keeps for each of its items
the best ones yet, so that only those leave it.  A product of matrices proposes
items; the similarity of one that may belong to the best is made anew by itself,
so that equal vectors tie whatever tile they are in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.operators import kernels
from simloom.operators.pairstats import plain

#: Items of a block, rows of one multiplied at once, and partitions of each side of the grid: fewer send less.
BLOCK, ROWS, SIDE = 1024, 128, 12
#: What a product of unit vectors may be off.
OFF = 1e-12


class _Best:
    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.s, self.j = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def take(self, first: int, s: np.ndarray, jds: np.ndarray, exact) -> None:
        """``s``: rows of items from ``first`` on by items ``jds``; ``exact`` gives the similarities of places."""
        own = slice(first, first + len(s))
        least = self.s[own, -1]
        fresh = np.flatnonzero(least == -np.inf)
        if len(fresh) and s.shape[1] > self.k:
            least = least.copy()
            least[fresh] = np.partition(s[fresh], -self.k, axis=1)[:, -self.k]
        r, c = np.nonzero((s >= (least - OFF)[:, None]) & (s > -np.inf))
        if not len(r):
            return
        rows = np.unique(r)
        old = np.repeat(rows, self.k)
        at = np.r_[old, r]
        values = np.r_[self.s[own][rows].reshape(-1), exact(r, c)]
        names = np.r_[self.j[own][rows].reshape(-1), jds[c]]
        order = np.lexsort((names, -values, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        self.s[first + at[kept], place[kept]] = values[order][kept]
        self.j[first + at[kept], place[kept]] = names[order][kept]


def nearest(items: DataFrame, k: int, *, block: int = BLOCK) -> DataFrame:
    """``i, rank, j, s``: the ``k`` items of greatest Pearson similarity to each of ``items`` (``id, v``), ties by ``j``."""
    if not plain(items):
        pairs = kernels.pairs(items, "pearson")
        found = pairs.select("i", "j", "s").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    else:
        found = kernels._grid(items, block, SIDE).mapInArrow(_chosen(k), "i long, j long, s double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "j"))).where(F.col("rank") <= k)
    return best.select("i", "rank", "j", "s")


def _chosen(k: int):
    def unit(column: pa.Array, row: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = kernels._rows(column, row, n)
        x -= x.mean(1, keepdims=True)
        norm = np.linalg.norm(x, axis=1)
        return x, norm, np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(c)[row].as_py() for c in (0, 1))
                ids, jds = (batch.column(c)[row].values.to_numpy() for c in (2, 4))
                (x, p, u), (y, q, w) = unit(batch.column(3), row, len(ids)), unit(batch.column(5), row, len(jds))
                left, right = best.setdefault(a, _Best(ids, k)), best.setdefault(b, _Best(jds, k))

                def exact(i: np.ndarray, j: np.ndarray, x=x, y=y, p=p, q=q) -> np.ndarray:
                    out = np.zeros(len(i))
                    for at in range(0, len(i), 4096):  # bounds the vectors laid side by side
                        own = slice(at, at + 4096)
                        scale = p[i[own]] * q[j[own]]
                        np.divide((x[i[own]] * y[j[own]]).sum(1), scale, out=out[own], where=scale > 0)
                    return np.clip(out, -1, 1)

                for at in range(0, len(ids), ROWS):
                    s = u[at : at + ROWS] @ w.T
                    if a == b:
                        s[ids[at : at + ROWS, None] == jds[None]] = -np.inf
                    left.take(at, s, jds, lambda r, c, at=at, f=exact: f(r + at, c))
                    if a != b:
                        right.take(0, s.T, ids[at : at + ROWS], lambda r, c, at=at, f=exact: f(c + at, r))
        for own in best.values():
            there = own.s > -np.inf
            yield pa.RecordBatch.from_pydict({"i": np.repeat(own.ids, there.sum(1)), "j": own.j[there], "s": own.s[there]})

    return run
