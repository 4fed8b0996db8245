"""Pairwise kernels: items with vectors to a table ``i, j, s`` with i < j.

Items are dealt into blocks by hash; a grid of block pairs, each held once, is
the plan, and each cell is a dense product in NumPy.  A cell's memory is fixed
by the block size; n items make about (n / block)^2 / 2 cells, spread over the
cluster.  The grid is a Cartesian product of partitions of blocks, so that each
vector is shuffled once, however many cells it is in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.operators.orderstats import quantiles

BLOCK = 512
PLACES = 1 << 21  # numbers that show in which tile each place of two blocks lies, held at once
NEAR, LARGE = 1e-2, 1e300  # share of both squared lengths below which a squared distance is made from differences, and squared length above which all are
SIDE = 24  # partitions of each side of the grid at most; a task takes a pair of them


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product; by differences where that would lose digits."""
    middle = y.mean(0) if len(y) else 0.0
    with np.errstate(invalid="ignore"):  # infinite ones go by differences
        p, q = x - middle, y - middle
    a, b = np.einsum("ik,ik->i", p, p), np.einsum("ik,ik->i", q, q)
    top = max(a.max(initial=0.0), b.max(initial=0.0))
    if not top < LARGE:  # or NaN
        return ((x[:, None, :] - y[None, :, :]) ** 2).sum(-1)
    d = p @ q.T
    d *= -2
    d += a[:, None]
    d += b[None]
    at = np.flatnonzero(d <= 2 * NEAR * top)
    i, j = at // max(1, len(y)), at % max(1, len(y))
    i, j = (k[d[i, j] <= NEAR * (a[i] + b[j])] for k in (i, j))
    for k in range(0, len(i), 4096):
        own = slice(k, k + 4096)
        apart = x[i[own]] - y[j[own]]
        d[i[own], j[own]] = (apart * apart).sum(1)
    return d


def _euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(x, y))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Zero where a norm is; within -1 and 1."""
    a, b = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    scale = a[:, None] * b[None]
    return np.clip(np.divide(x @ y.T, scale, out=np.zeros((len(x), len(y))), where=scale > 0), -1, 1)


def _pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _cosine(x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True))


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x[:, None, :] - y[None, :, :]).sum(-1)


SIMILARITIES = {
    "pearson": _pearson, "cosine": _cosine, "euclidean": lambda x, y: 1 / (1 + _euclid(x, y)), "manhattan": lambda x, y: 1 / (1 + _manhattan(x, y)), "dot": lambda x, y: x @ y.T,
}
DISTANCES = {"pearson": lambda x, y: 1 - _pearson(x, y), "cosine": lambda x, y: 1 - _cosine(x, y), "euclidean": _euclid, "manhattan": _manhattan}
METRICS = (*SIMILARITIES, "gaussian_kernel")


def validate_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(METRICS)}")


#: A cell function: from vectors in rows, x and y, the matrix of their values.
Cell = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pairwise(f: Callable[[np.ndarray, np.ndarray], float]) -> Cell:
    """A cell function from a function of two vectors."""
    return lambda x, y: np.array([[f(a, b) for b in y] for a in x], float).reshape(len(x), len(y))


def spearman(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of ranks, ties by their mean."""
    return _pearson(*(np.array([_ranks(v) for v in m]).reshape(m.shape) for m in (x, y)))


def _ranks(v: np.ndarray) -> np.ndarray:
    _, at, many = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(many) - (many - 1) / 2)[at]


def information(bins: int) -> Cell:
    """A cell function of mutual information in nats over equally full bins, ties in the order of the vector."""

    def tiles(m: np.ndarray) -> np.ndarray:
        n = m.shape[1]
        large, size = n % bins, n // bins
        tile = np.repeat(np.arange(bins), [size + (k < large) for k in range(bins)])
        out = np.empty(m.shape, np.int32)
        for own, v in zip(out, m, strict=True):
            own[np.argsort(v, kind="stable")] = tile
        return out

    def cell(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        p, q = tiles(x), tiles(y)
        both, first, second = np.zeros((len(x), len(y), bins, bins)), np.zeros((len(x), bins)), np.zeros((len(y), bins))
        step = max(1, PLACES // max(1, bins * (len(x) + len(y))))
        for at in range(0, n, step):  # counts add up; a whole vector's tiles are not spread out at once
            a, b = ((m[:, None, at : at + step] == np.arange(bins)[None, :, None]).astype(float) for m in (p, q))
            both += np.einsum("ipn,jqn->ijpq", a, b, optimize=True)
            first, second = first + a.sum(2), second + b.sum(2)
        apart = first[:, None, :, None] * second[None, :, None, :]
        return np.sum(both / n * np.log(np.divide(both * n, apart, out=np.ones_like(both), where=both > 0)), axis=(2, 3))

    return cell


def group(metric: str, subjects: int, *, fisher: bool) -> Cell:
    """A cell function of the mean of subjects' similarities, whose vectors lie one after another; by Fisher's z for correlations."""
    f = SIMILARITIES[metric]

    def cell(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        each = (f(a, b) for a, b in zip(np.split(x, subjects, 1), np.split(y, subjects, 1), strict=True))
        if not fisher:
            return sum(each) / subjects
        # NaN is above all numbers, as in Spark's functions.
        return np.tanh(sum(np.arctanh(np.fmin(np.maximum(s, 1e-6 - 1), 1 - 1e-6)) for s in each) / subjects)

    return cell


def _rows(column: pa.Array, k: int, rows: int) -> np.ndarray:
    """The vectors of a block as a matrix."""
    vectors = column[k].values
    if vectors.null_count or len(set(np.unique(vectors.value_lengths()))) > 1:
        raise ValueError("vectors must be of one length, without nulls")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _cells(kind: str, metric: str | Cell, named: bool, positive: bool = False):
    f = metric if callable(metric) else (SIMILARITIES if kind == "similarity" else DISTANCES)[metric]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].as_py() for c in (0, 1))
                ids, jds = (batch.column(c)[k].values.to_numpy() for c in (2, 4))
                x, y = _rows(batch.column(3), k, len(ids)), _rows(batch.column(5), k, len(jds))
                for at in range(0, len(ids), 64):  # bounds what a difference of all pairs takes
                    s = f(x[at : at + 64], y)
                    i, j, s = np.repeat(ids[at : at + 64], len(jds)), np.tile(jds, len(s)), s.reshape(-1)
                    if a == b:
                        once = i < j
                        i, j, s = i[once], j[once], s[once]
                    if positive:
                        there = s > 0
                        i, j, s = i[there], j[there], s[there]
                    if named:
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(s)], names=["i", "j", "s"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(s)], names=["s"])

    return run


def _grid(items: DataFrame, block: int, most: int = SIDE) -> DataFrame:
    """``b, c, ids, vs, jds, ws``: each pair of blocks once, in the order that gives every block about as many cells as a left one as as a right one."""
    count = max(1, -(-items.count() // block))
    side = min(count, most)
    b = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    dealt = items.select(b.alias("b"), F.struct("id", "v").alias("r")).repartitionById(side, F.col("b"))
    left = dealt.groupBy("b").agg(F.array_sort(F.collect_list("r")).alias("r")).select("b", F.col("r.id").alias("ids"), F.col("r.v").alias("vs"))
    right = left.select(F.col("b").alias("c"), F.col("ids").alias("jds"), F.col("vs").alias("ws"))
    once = (F.col("b") == F.col("c")) | (((F.col("b") + F.col("c")) % 2 == 0) == (F.col("b") < F.col("c")))
    return left.hint("shuffle_replicate_nl").join(right, once).select("b", "c", "ids", "vs", "jds", "ws")


def pairs(items: DataFrame, metric: str | Cell = "pearson", *, kind: str = "similarity", sigma: float | None = None, sigma_scale: float = 1.0, block: int = BLOCK, positive: bool = False) -> DataFrame:
    """``i, j, s`` for all i < j of ``items`` (``id, v``), or the pairs of a value above 0; vectors are of one length, without nulls.

    ``metric`` is a name, or a caller's cell function of a symmetric value, whose
    results are taken as they are.
    """
    if not callable(metric):
        validate_metric(metric)
    if metric == "gaussian_kernel":
        if kind != "similarity":
            raise NotImplementedError("the Gaussian kernel is no distance")
        if sigma is None:
            from simloom.operators.pairstats import quantiles_of

            middle = quantiles_of(items, [0.5], times=2, zeros=items.count())[0]
            sigma = float("nan") if middle is None else middle * sigma_scale
        return gaussian(pairs(items, "euclidean", kind="distance", block=block), 0, sigma=sigma)
    if kind == "distance" and metric == "dot":
        raise NotImplementedError("a dot product has no distance")
    return _grid(items, block).mapInArrow(_cells(kind, metric, True, positive), "i long, j long, s double")


def values(items: DataFrame, metric: str | Cell, *, kind: str = "similarity", block: int = BLOCK) -> DataFrame:
    """``s``: the values of ``pairs`` without their items."""
    return _grid(items, block).mapInArrow(_cells(kind, metric, False), "s double")


def filled(ids: DataFrame, seen: DataFrame, fill: float, *, block: int = BLOCK) -> DataFrame:
    """``i, j, s`` of all i < j of ``ids`` (``id``, each once): of ``seen``, or else ``fill``.

    An item takes its seen pairs along into the block grid, so that no pair of the grid is joined.
    """
    seen = seen.where("s is not null")
    both = seen.select("i", "j", "s").unionByName(seen.select(F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    listed = both.groupBy(F.col("i").alias("id")).agg(F.collect_list(F.struct(F.col("j").cast("long").alias("j"), F.col("s").cast("double").alias("s"))).alias("v"))
    none = F.array().cast("array<struct<j:bigint,s:double>>")
    items = ids.where("id is not null").join(listed, "id", "left").select("id", F.coalesce("v", none).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].as_py() for c in (0, 1))
                ids, jds = (batch.column(c)[k].values.to_numpy() for c in (2, 4))
                lists = batch.column(3)[k].values
                row = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
                j, s = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                at = np.minimum(np.searchsorted(jds, j), len(jds) - 1)
                there = jds[at] == j
                out = np.full((len(ids), len(jds)), float(fill))
                out[row[there], at[there]] = s[there]
                i, j, out = np.repeat(ids, len(jds)), np.tile(jds, len(ids)), out.reshape(-1)
                if a == b:
                    once = i < j
                    i, j, out = i[once], j[once], out[once]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(out)], names=["i", "j", "s"])

    return _grid(items, block).select("b", "c", "ids", "vs", "jds").mapInArrow(run, "i long, j long, s double")


def gaussian(distances: DataFrame, n: int, *, sigma: float | None = None, sigma_scale: float = 1.0) -> DataFrame:
    """exp(-d^2 / 2 sigma^2); sigma is the scaled median of the whole distance matrix, its zero diagonal included, unless given."""
    if sigma is None:
        middle = quantiles(distances.select("s"), [0.5], times=2, also={0.0: n})[0]
        sigma = float("nan") if middle is None else middle * sigma_scale
    return distances.select("i", "j", F.exp(-F.col("s") * F.col("s") / F.lit(2 * float(sigma) * float(sigma))).alias("s"))


def rbf(distances: DataFrame, *, alpha: float = 1.0, middle: float | None = None) -> DataFrame:
    """Gaussian kernel whose bandwidth is alpha times the median distance of pairs; columns beside ``s`` stay.

    A plan that makes the distances is run in each pass, if the median isn't
    given as ``middle``; nothing is written.
    """
    if middle is None:
        middle = quantiles(distances.select("s"), [0.5])[0]
    sigma = F.lit(None if middle is None else middle * alpha).cast("double")
    return distances.withColumns({"s": F.exp(-F.col("s") * F.col("s") / (2 * sigma * sigma)), "sigma": sigma})


def reexponentiate(kernel: DataFrame, alphas: list[float]) -> DataFrame:
    """Kernels at other bandwidths from the one at alpha 1, without the distances."""
    grid = kernel.sparkSession.createDataFrame([(a,) for a in alphas], "alpha double")
    return kernel.crossJoin(F.broadcast(grid)).withColumn("s", F.exp(F.greatest(F.log("s") / (F.col("alpha") * F.col("alpha")), F.lit(-50.0))))


def group_mean(tagged: DataFrame, *, fisher: bool) -> DataFrame:
    """Mean of subjects' matrices ``subject, i, j, s``; by Fisher's z for correlations."""
    z = F.tanh(F.avg(F.atanh(F.least(F.greatest("s", F.lit(1e-6 - 1)), F.lit(1 - 1e-6))))) if fisher else F.avg("s")
    return tagged.groupBy("i", "j").agg(z.alias("s"))


def graph_similarity(edges: DataFrame, fill: float | None = None) -> DataFrame:
    """Adjacency as similarity: divided by the greatest weight if that is over one; nulls filled."""
    top = edges.agg(F.max("s").alias("top"))
    s = F.col("s") / F.when(F.col("top") > 1, F.col("top")).otherwise(1.0)
    return edges.crossJoin(F.broadcast(top)).select("i", "j", (s if fill is None else F.coalesce(s, F.lit(fill))).alias("s"))


def listed_cosine(items: DataFrame, listed: DataFrame) -> DataFrame:
    """Cosine for listed pairs ``a, b, ...``; pairs with an unknown item or a zero vector are left out."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)
    one, two = (items.select(F.col("id").alias(k), F.col("v").alias(f"v_{k}")) for k in "ab")
    both = listed.join(one, "a").join(two, "b")
    norm = F.sqrt(dot("v_a", "v_a")) * F.sqrt(dot("v_b", "v_b"))
    return both.withColumn("norm", norm).where("norm > 0").withColumn("s", dot("v_a", "v_b") / F.col("norm")).drop("v_a", "v_b", "norm")


def softmax_triplet_similarity(items: DataFrame, block: int = 256, most: int = 1 << 22) -> DataFrame:
    """P(i, j): mean over k of the share of exp(s_ij) among the pairs of i, j, k; ``i, j, s`` with i < j.

    A task takes tiles of ``block`` i by ``block`` j.  It has the vectors of all
    items, whose size is checked, and of the products with all items only those
    of one i and of ``most / n`` j at once.  The work grows with the cube of n.
    """
    rows = items.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    size = rows.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    if size > 1 << 26:
        raise ValueError(f"vectors of {size} numbers are more than a task can hold")
    table = rows.orderBy("id").toArrow().combine_chunks()
    n = table.num_rows
    ids = table["id"].to_numpy()
    shared = items.sparkSession.sparkContext.broadcast(np.asarray(table["v"].combine_chunks().flatten()).reshape(n, -1) if n else np.zeros((0, 1)))
    wide, narrow = -(-n // block), max(1, most // max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for tile in batch.column(0).to_pylist():
                at, to = tile // wide * block, tile % wide * block
                for first in range(to, min(n, to + block), narrow) if to >= at else ():
                    j = np.arange(first, min(n, to + block, first + narrow))
                    far = np.exp(w[j] @ w.T)
                    for i in range(at, min(n, at + block, j[-1])):
                        later = slice(max(0, i + 1 - first), None)
                        near, other, own = np.exp(w @ w[i]), far[later], j[later]
                        share = near[own, None] / (near[own, None] + near[None] + other)
                        share[:, i] = 0
                        share[np.arange(len(own)), own] = 0
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), ids[i])), pa.array(ids[own]), pa.array(share.sum(1) / max(1, n - 2))], names=["i", "j", "s"])

    tiles = items.sparkSession.range(0, wide * wide, 1, max(1, min(wide * wide, 1024)))
    return tiles.mapInArrow(run, "i long, j long, s double")
