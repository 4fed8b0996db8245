"""Linear probes by nested cross-validation, from one pass over the rows.

Outer and inner folds come from hashes of the id, which makes cells of rows;
each cell's sums of products are all that a fit or a loss needs, so every model
of the grid is solved from sums of cells and no row is read again until the
predictions.  A task holds matrices of the number of features, which is
checked, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.hashing import uniform

FEATURES = 2000
RIDGE = np.logspace(-4, 2, 13)


def with_folds(items: DataFrame, outer: int, inner: int, seed: int = 0) -> DataFrame:
    """``items`` with ``fold`` and ``inner``, from hashes of ``id``."""
    draw = lambda tag, n: F.floor(uniform(F.lit(f"{tag}{seed}"), F.col("id").cast("string")) * n).cast("int")
    return items.withColumn("fold", draw("outer", outer)).withColumn("inner", draw("inner", inner))


def cell_sums(folded: DataFrame, width: int) -> DataFrame:
    """``fold, inner, place, x``: sums of products of 1, the features and ``y`` in each cell, row by row."""
    size = (width + 2) ** 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            f, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            v = batch.column(2).flatten().to_numpy().reshape(-1, width)
            z = np.column_stack([np.ones(len(v)), v, batch.column(3).to_numpy()])
            for cell in set(zip(f.tolist(), g.tolist(), strict=True)):
                part = z[(f == cell[0]) & (g == cell[1])]
                held[cell] = held.get(cell, 0) + part.T @ part
        for (a, b), m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([m.ravel()])], names=["fold", "inner", "m"])

    rows = folded.select("fold", "inner", "v", "y").mapInArrow(sums, "fold int, inner int, m array<double>")
    return rows.select("fold", "inner", F.posexplode("m").alias("place", "x")).where(F.col("place") < size).groupBy("fold", "inner", "place").agg(F.sum("x").alias("x"))


def _centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Means and population covariances of features, and with ``y``, from sums of products."""
    n = m[0, 0]
    mean, y = m[0, 1:-1] / n, m[0, -1] / n
    return mean, m[1:-1, 1:-1] / n - np.outer(mean, mean), m[1:-1, -1] / n - mean * y, y, n


def lasso_path(g: np.ndarray, c: np.ndarray, alphas: np.ndarray, tol: float = 1e-9, steps: int = 20_000) -> np.ndarray:
    """Columns minimise w'Gw / 2 - c'w + alpha |w|, all penalties at once by accelerated steps."""
    rate = 1 / max(np.linalg.eigvalsh(g)[-1], 1e-12)
    w = z = np.zeros((len(c), len(alphas)))
    t = 1.0
    for _ in range(steps):
        step = z - rate * (g @ z - c[:, None])
        new = np.sign(step) * np.maximum(np.abs(step) - rate * alphas, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        restart = ((z - new) * (new - w)).sum(0) > 0
        z = np.where(restart, new, new + (t - 1) / s * (new - w))
        done = np.abs(new - w).max(initial=0.0) <= tol * max(1.0, np.abs(new).max(initial=0.0))
        w, t = new, s
        if done:
            break
    return w


def ridge_path(g: np.ndarray, c: np.ndarray, alphas: np.ndarray, n: float) -> np.ndarray:
    """Columns minimise |y - Xw|^2 + alpha |w|^2 of ``n`` rows."""
    e, q = np.linalg.eigh(g * n)
    return q @ ((q.T @ c * n)[:, None] / (np.maximum(e, 0)[:, None] + alphas))


def _loss(m: np.ndarray, mean: np.ndarray, y: float, w: np.ndarray) -> np.ndarray:
    """Squared error over the rows of ``m`` of each column of ``w``."""
    z = np.vstack([y - mean @ w, w, -np.ones((1, w.shape[1]))])
    return np.einsum("ik,ij,jk->k", z, m, z)


def fit_fold(cells: dict[tuple[int, int], np.ndarray], fold: int, kind: str) -> tuple[np.ndarray, float, float]:
    """Weights, intercept and penalty for rows outside ``fold``, the penalty chosen over the inner folds.

    Features are standardised on the training rows.  Lasso penalties are 100,
    from the least that empties the model down to a thousandth of it.
    """
    inner = sorted({g for f, g in cells if f != fold})
    train = {g: sum(m for (f, h), m in cells.items() if f != fold and h == g) for g in inner}
    total = sum(train.values())
    mean, g, c, y, n = _centred(total)
    sd = np.sqrt(np.maximum(np.diag(g), 0))
    sd = np.where(sd > 0, sd, 1.0)
    scale = np.diag(np.concatenate([[1.0], 1 / sd, [1.0]]))
    top = max(np.abs(c / sd).max(initial=0.0), 1e-12)
    alphas = RIDGE if kind == "ridge" else top * np.logspace(0, -3, 100)

    def solve(m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        mean, g, c, y, n = _centred(m)
        return mean, y, ridge_path(g, c, at, n) if kind == "ridge" else lasso_path(g, c, at)

    loss = np.zeros(len(alphas))
    for k in inner if len(inner) > 1 else []:
        mu, my, w = solve(scale @ (total - train[k]) @ scale, alphas)
        held = scale @ train[k] @ scale
        loss += _loss(held, mu, my, w) / (held[0, 0] if kind == "lasso" else 1.0)
    best = alphas[int(np.argmin(loss))]
    mu, my, w = solve(scale @ total @ scale, np.array([best]))
    w = w[:, 0]
    return w / sd, float(my - mu @ w), float(best)


def nested_cv(items: DataFrame, kind: str = "lasso", *, outer: int = 5, inner: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Predictions ``id, fold, y, predicted`` out of fold, and models ``fold, weights, intercept, alpha, active``.

    ``items`` has ``id, v, y``; rows with a null in them are left out.  Fewer
    than two outer folds with rows raise an error.
    """
    if kind not in ("lasso", "ridge"):
        raise ValueError(f"unknown kind {kind!r}; there are lasso, ridge")
    rows = items.where("y is not null and v is not null").select("id", "v", F.col("y").cast("double").alias("y"))
    first = rows.select(F.size("v").alias("d")).first()
    if first is None or first.d > FEATURES:
        raise ValueError("no rows, or more features than a task can hold")
    width = first.d
    folded = with_folds(rows, outer, inner, seed)
    cells: dict[tuple[int, int], np.ndarray] = {}
    for r in cell_sums(folded, width).groupBy("fold", "inner").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p.x).alias("m")).collect():
        cells[r.fold, r.inner] = np.array(r.m).reshape(width + 2, width + 2)
    folds = sorted({f for f, _ in cells})
    if len(folds) < 2:
        raise ValueError("rows in fewer than two folds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0).to_pylist():
                w, b, alpha = fit_fold(cells, f, kind)
                values = [pa.array([f], pa.int32()), pa.array([w]), pa.array([b]), pa.array([alpha]), pa.array([int((np.abs(w) > 1e-5).sum())], pa.int64())]
                yield pa.RecordBatch.from_arrays(values, names=["fold", "weights", "intercept", "alpha", "active"])

    spark = items.sparkSession
    tasks = spark.createDataFrame([(f,) for f in folds], "fold int").repartition(len(folds))
    found = tasks.mapInArrow(run, "fold int, weights array<double>, intercept double, alpha double, active long").collect()
    models = spark.createDataFrame(found, "fold int, weights array<double>, intercept double, alpha double, active long")
    dot = F.aggregate(F.zip_with("v", "weights", lambda a, b: a * b), F.col("intercept"), lambda t, z: t + z)
    return folded.join(F.broadcast(models), "fold").select("id", "fold", "y", dot.alias("predicted")), models
