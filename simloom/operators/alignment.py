"""Alignment of one embedding's dimensions to another's, over all items or leaving each item out in turn, and its permutation test.

Everything that an assignment needs are sums over items: of each dimension, its
square, and each product of a dimension of one with one of the other.  Spark
adds them up by partition, ``k x k`` numbers each.  An item is left out by
taking its own terms away, for a whole batch of items at once; the assignment of
all items stays the best one where its column potentials still prove that, and
is mended from those potentials where they don't, for all such items of a batch
at once.  How far an item can move a correlation is bounded for a tile of items
first, and only pairs of dimensions that could come to prefer each other are
looked at item by item.

Rows hold ``id, x, w``: the reference's vector and the one to align, of one
length, without nulls or NaN.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.numeric import assignment, even_potentials, mended
from simloom.operators.correlation import bh_adjust, p_value

#: Numbers of both embeddings that go to each task of a permutation test: 512 MB.
MOST_CELLS = 1 << 26
#: Correlations held at once while items are left out, and items whose moves are bounded together.
_CELLS, _TILE = 1 << 21, 1 << 12
#: What correlations may be off by through rounding, where variances are above ``_SOUND`` times the squares.
_ROUNDING, _SOUND = 1e-9, 1e-6
#: Times that potentials are lowered along all pairs of dimensions before an item is aligned anew, and items for which no shared assignment is looked for.
_SWEEPS, _FEW = 3, 1 << 11


class Moments(NamedTuple):
    """Sums over items: count, x, w, squares, and products [dimension of x, dimension of w]."""

    n: float
    x: np.ndarray
    w: np.ndarray
    xx: np.ndarray
    ww: np.ndarray
    xw: np.ndarray


def moments(x: np.ndarray, w: np.ndarray) -> Moments:
    return Moments(len(x), x.sum(0), w.sum(0), (x * x).sum(0), (w * w).sum(0), x.T @ w)


def correlations(m: Moments) -> np.ndarray:
    """``[..., dimension of x, dimension of w]``; 0 where there is no variance."""
    n = np.asarray(m.n, float)[..., None]
    spread_x, spread_w = (np.maximum(s2 - s * s / n, 0) for s, s2 in ((m.x, m.xx), (m.w, m.ww)))
    # A variance below the rounding of its sums is none.
    spread_x, spread_w = np.where(spread_x > 1e-12 * m.xx, spread_x, 0), np.where(spread_w > 1e-12 * m.ww, spread_w, 0)
    norm = np.sqrt(spread_x[..., :, None] * spread_w[..., None, :])
    cov = m.xw - m.x[..., :, None] * m.w[..., None, :] / n[..., None]
    return np.divide(cov, norm, out=np.zeros_like(cov), where=norm > 0)


def _without(m: Moments, x: np.ndarray, w: np.ndarray) -> Moments:
    """The moments of all other items, for each row."""
    return Moments(np.full(len(x), m.n - 1), m.x - x, m.w - w, m.xx - x * x, m.ww - w * w, m.xw - x[:, :, None] * w[:, None, :])


def _in_doubt(m: Moments, cost: np.ndarray, potential: np.ndarray, whole: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether ``whole`` may not be best for each row, left out; False is sure.

    With an item's deviations ``a`` and ``b`` in units of the root sum of
    squares, a correlation without it is ``(r - c a b) / sqrt((1 - c a a) (1 - c b b))``
    where c is n / (n - 1).  Potentials are lowered item by item where a column
    has become cheaper for some row; if they then prove ``whole`` again, it stands.
    """
    doubt = np.ones(len(x), bool)
    spread_x, spread_w = m.xx - m.x * m.x / m.n, m.ww - m.w * m.w / m.n
    if m.n < 3 or not ((spread_x > _SOUND * m.xx).all() and (spread_w > _SOUND * m.ww).all()):
        return doubt
    c, r, each = m.n / (m.n - 1), -cost, np.arange(len(cost))
    gap = cost - potential
    gap = gap - gap[each, whole][:, None]
    for at in range(0, len(x), _TILE):
        a, b = (np.ascontiguousarray(((v[at : at + _TILE] - s / m.n) / np.sqrt(spread)).T) for v, s, spread in ((x, m.x, spread_x), (w, m.w, spread_w)))
        u, v = c * a * a, c * b * b
        far = (np.maximum(u.max(0), v.max(0)) > 0.5) | ~np.isfinite(u.sum(0) + v.sum(0))
        for part in (a, b, u, v):
            part[:, far] = 0
        grow_a, grow_b = 1 / np.sqrt(1 - u), 1 / np.sqrt(1 - v)
        grown = grow_a.max(1)[:, None] * grow_b.max(1)
        bound = np.abs(r) * (grown - 1) + c * np.abs(a).max(1)[:, None] * np.abs(b).max(1) * grown
        bound = bound + bound[each, whole][:, None] + _ROUNDING
        b *= c
        room = bound.max()  # what potentials may be lowered by: all other pairs have that much to spare
        rows, columns = np.nonzero((gap <= bound + room) & (np.arange(gap.shape[1]) != whole[:, None]))
        owns = whole[rows]
        spare = np.empty((len(rows), a.shape[1]))
        for d in np.unique(rows):
            mine, own = rows == d, whole[d]
            e = columns[mine]
            less = (r[d, e, None] - a[d] * b[e]) * grow_b[e] - (r[d, own] - a[d] * b[own]) * grow_b[own]
            spare[mine] = (potential[own] - potential[e])[:, None] - _ROUNDING - less * grow_a[d]
        open_ = np.flatnonzero((spare < 0).any(0))
        spare, lowered = spare[:, open_], np.zeros((len(cost), len(open_)))
        for _ in range(_SWEEPS):
            for own, e, left in zip(owns, columns, spare, strict=True):
                np.minimum(lowered[e], lowered[own] + left, out=lowered[e])
        proven = lowered.min(0, initial=0) >= -room
        for own, e, left in zip(owns, columns, spare, strict=True):
            proven &= lowered[e] <= lowered[own] + left
        far[open_[~proven]] = True
        doubt[at : at + _TILE] = far
    return doubt


def left_out(m: Moments, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each row, the column of ``w`` matched with each dimension of ``x`` by the other items' signed correlations.

    Items that part from the assignment of all items mostly share another, so
    that of one of them is tried on the others while many are left.
    """
    cost = -correlations(m)
    whole = assignment(cost)[0]
    potential = even_potentials(cost, whole)
    out = np.tile(whole, (len(x), 1))
    doubt = np.flatnonzero(_in_doubt(m, cost, potential, whole, x, w))
    many = len(x)
    while _FEW < len(doubt) < many:
        many = len(doubt) * 7 // 8
        one = doubt[len(doubt) // 2, None]
        own = -correlations(_without(m, x[one], w[one]))[0]
        match = assignment(own)[0]
        still = _in_doubt(m, cost, even_potentials(own, match), match, x[doubt], w[doubt])
        out[doubt[~still]] = match
        doubt = doubt[still]
    step = max(1, _CELLS // max(1, x.shape[1] ** 2))
    for at in range(0, len(doubt), step):
        rows = doubt[at : at + step]
        cost = -correlations(_without(m, x[rows], w[rows])) if m.n > 1 else np.zeros((len(rows), x.shape[1], x.shape[1]))
        stands = ((cost - potential).argmin(2) == whole).all(1)
        if not stands.all():
            out[rows[~stands]] = mended(cost[~stands], potential, whole)
    return out


def _arrays(batch: pa.RecordBatch, *names: str) -> Iterator[np.ndarray]:
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        yield np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def total_moments(both: DataFrame) -> Moments | None:
    """Moments of all rows, from one row of sums a partition; none without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                own = [np.atleast_1d(np.asarray(v, float)).reshape(-1) for v in moments(*_arrays(batch, "x", "w"))]
                sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sums).tolist(), pa.float64()), pa.array(range(sum(map(len, sums))))], names=["s", "at"])

    rows = both.select("x", "w").mapInArrow(run, "s double, at long").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    if not rows:
        return None
    s = np.array([r.s for r in rows])
    k = round((len(s) + 3) ** 0.5) - 2  # 1 + 4 k + k^2 numbers
    return Moments(s[0], s[1 : k + 1], s[k + 1 : 2 * k + 1], s[2 * k + 1 : 3 * k + 1], s[3 * k + 1 : 4 * k + 1], s[4 * k + 1 :].reshape(k, k))


def aligned(both: DataFrame, *, leave_out: bool = True) -> DataFrame:
    """``id, x, w, match``: ``w`` in the order of ``x``, by each item's assignment without it, or by the one of all items.

    ``match`` has, for each dimension of ``x``, the dimension of ``w`` from 1
    on.  Assignments maximise signed correlations.  No rows give none.
    """
    m = total_moments(both)
    schema = "id long, x array<double>, w array<double>, match array<int>"
    if m is None:
        return both.sparkSession.createDataFrame([], schema)
    known = both.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _arrays(batch, "x", "w")
            order = left_out(known.value, x, w) if leave_out else np.tile(assignment(-correlations(known.value))[0], (len(x), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(np.take_along_axis(w, order, 1))), pa.array(list((order + 1).astype(np.int32)))], names=["id", "x", "w", "match"])

    return both.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("w").cast("array<double>").alias("w")).mapInArrow(run, schema)


def aligned_correlations(rows: DataFrame) -> DataFrame:
    """``dim, r``: signed correlation of each dimension of ``aligned`` rows; null without variance."""
    each = rows.select(F.posexplode(F.arrays_zip("x", "w")).alias("at", "c"))
    spread = F.stddev_pop("c.x") * F.stddev_pop("c.w")
    return each.groupBy((F.col("at") + 1).cast("long").alias("dim")).agg(F.when(spread > 0, F.corr("c.x", "c.w")).alias("r"))


def _r(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Correlations of columns, NaN without variance."""
    x, w = x - x.mean(0), w - w.mean(0)
    norm = np.sqrt((x * x).sum(0) * (w * w).sum(0))
    return np.divide((x * w).sum(0), norm, out=np.full(x.shape[1], np.nan), where=norm > 0)


def alignment_null(both: DataFrame, n: int = 1000, *, leave_out: bool = True, seed: int = 0) -> DataFrame:
    """``perm, dim, r``: signed correlations after aligning again to the reference with its rows permuted; 0 is as observed.

    A task takes some permutations of both embeddings, whose size is counted
    first and must not exceed ``MOST_CELLS``.
    """
    rows = both.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("w").cast("array<double>").alias("w"))
    cells = rows.agg(F.coalesce(F.sum(F.size("x") + F.size("w")), F.lit(0))).first()[0]
    if cells > MOST_CELLS:
        raise ValueError(f"embeddings of {cells} numbers are more than a task can hold")
    spark = both.sparkSession
    schema = "perm long, dim long, r double"
    if not cells:
        return spark.createDataFrame([], schema)
    table = rows.orderBy("id").toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast(tuple(np.asarray(table[c].combine_chunks().flatten()).reshape(table.num_rows, -1) for c in ("x", "w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, w = shared.value
        same = moments(x, w)  # but for the products
        for batch in batches:
            for perm in batch.column(0).to_pylist():
                moved = x[np.random.default_rng([seed, perm]).permutation(len(x))] if perm else x
                m = same._replace(xw=moved.T @ w)
                order = left_out(m, moved, w) if leave_out else np.tile(assignment(-correlations(m))[0], (len(w), 1))
                r = _r(moved, np.take_along_axis(w, order, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), perm)), pa.array(np.arange(1, len(r) + 1)), pa.array(r, from_pandas=True)], names=["perm", "dim", "r"])

    tasks = max(1, min(n + 1, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n + 1, 1, tasks).mapInArrow(run, schema)


def alignment_test(both: DataFrame, n: int = 1000, *, leave_out: bool = True, two_sided: bool = True, q: float = 0.05, seed: int = 0) -> DataFrame:
    """``dim, r, p, p_adjusted, rejected``: whether each dimension is recovered, aligning anew in each permutation; false discoveries are controlled over dimensions.

    A dimension without variance has a null r and a p of 1.
    """
    r = alignment_null(both, n, leave_out=leave_out, seed=seed)
    r = r.withColumn("r", F.abs("r")) if two_sided else r
    seen = r.where("perm = 0").select("dim", F.col("r").alias("observed"))
    p = r.where("perm > 0").join(F.broadcast(seen), "dim").groupBy("dim", "observed").agg(F.when(F.col("observed").isNull(), 1.0).otherwise(p_value(F.col("observed"), F.col("r"))).alias("p"))
    return bh_adjust(p.withColumnRenamed("observed", "r").withColumn("g", F.lit(0)), "p", ["g"], q).drop("g")
