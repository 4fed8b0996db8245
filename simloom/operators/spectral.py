"""Rank selection from masked bootstraps of a similarity matrix, and factorisation.

Matrices are pair tables ``i, j, s``; a task of a grid gets the whole matrix of
a checked, small number of items and does dense algebra on it.  Masks, noise
and null draws come from hashes of the task's key, so tasks can be run again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.functions.numeric import hungarian, sym_nmf, symmetric_eigen

#: Items whose matrix goes with a task.
MOST_ITEMS = 5000


def symmetrized(entries: DataFrame) -> DataFrame:
    """``i, j, s`` (i <= j): the mean of both directions, the one there is, or no row."""
    return entries.where("s is not null and not isnan(s)").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.avg("s").alias("s"))


def observed_rate(pairs: DataFrame, n: int) -> DataFrame:
    """``q``: share of off-diagonal pairs that are observed, at least 1e-12."""
    return pairs.where("i < j").agg(F.least(F.greatest(F.count(F.lit(1)) / F.lit(n * (n - 1) / 2), F.lit(1e-12)), F.lit(1.0)).alias("q"))


def masked(pairs: DataFrame, p: float, rep: int = 0) -> DataFrame:
    """Pairs kept with probability p by a hash of the pair and divided by p; masks of one rep are nested in p."""
    from simloom.functions.hashing import uniform

    u = uniform(F.lit("mask"), F.lit(str(rep)), F.col("i").cast("string"), F.col("j").cast("string"))
    return pairs.where((F.col("i") == F.col("j")) | (u < p)).withColumn("s", F.when(F.col("i") == F.col("j"), F.col("s")).otherwise(F.col("s") / p))


def dense(pairs: DataFrame, *, diagonal: float | None = 1.0, most: int = MOST_ITEMS) -> tuple[np.ndarray, np.ndarray]:
    """Item ids and the matrix, NaN where no pair is; its size is checked before it is collected."""
    ids = [r.id for r in pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct().orderBy("id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} items")
    rows = pairs.select("i", "j", "s").toPandas()
    m = np.full((len(ids), len(ids)), np.nan)
    a, b = np.searchsorted(ids, rows.i), np.searchsorted(ids, rows.j)
    m[a, b] = m[b, a] = rows.s
    if diagonal is not None:
        m[np.arange(len(ids)), np.arange(len(ids))] = diagonal
    return np.array(ids), m


def on_grid(spark: SparkSession, grid: list[tuple], names: str, f: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """Rows of ``f(*task)`` for each task of the grid, one task to a partition."""
    tasks = spark.createDataFrame(grid, names).repartition(max(1, min(len(grid), spark.sparkContext.defaultParallelism * 4)))

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield f(*row)

    return tasks.mapInPandas(run, schema)


def _mask(n: int, p: float, seed: int) -> np.ndarray:
    u = np.random.default_rng(seed).random((n, n))
    u = np.triu(u, 1)
    keep = (u + u.T) < p
    np.fill_diagonal(keep, True)
    return keep


def _unbiased(m: np.ndarray, keep: np.ndarray, p: float) -> np.ndarray:
    seen = np.isfinite(m) & keep
    off = ~np.eye(len(m), dtype=bool)
    rate = np.isfinite(m)[off].mean() * p if off.any() else 1.0
    out = np.where(seen, m, 0.0)
    out[off] /= max(rate, 1e-12)
    return out


def subspace_overlap(spark: SparkSession, m: np.ndarray, k_max: int, p_list: list[float], boots: int, seed: int = 0) -> DataFrame:
    """``p, b, k, i, null``: squared projection of the full matrix's eigenvector k on the top k of a masked one, and of a random direction."""
    full = np.where(np.isfinite(m), m, 0.0)
    u = symmetric_eigen(full, k_max)[1]

    def task(p: float, b: int) -> pd.DataFrame:
        top = symmetric_eigen(_unbiased(m, _mask(len(m), p, seed + 7919 * b), p), k_max)[1]
        x = np.random.default_rng(seed + b).normal(size=len(m))
        x /= np.linalg.norm(x)
        g, h = top.T @ u, top.T @ x
        k = np.arange(1, k_max + 1)
        return pd.DataFrame({"p": p, "b": b, "k": k, "i": [float(np.square(g[: j, j - 1]).sum()) for j in k], "null": [float(np.square(h[:j]).sum()) for j in k]})

    return on_grid(spark, [(float(p), b) for p in p_list for b in range(boots)], "p double, b long", task, "p double, b long, k long, i double, null double")


def estimate_rank_kappa(spark: SparkSession, m: np.ndarray, *, k_max: int = 20, n_p: int = 12, boots: int = 8, seed: int = 0) -> DataFrame:
    """``k, jump``: the change point of the leakage curve over ranks."""
    from simloom.operators.curves import change_point, kappa

    p_list = np.linspace(0.3, 0.98, n_p).round(4).tolist()
    curve = subspace_overlap(spark, m, k_max, p_list, boots, seed).groupBy("k", "p").agg(F.percentile("i", F.lit(0.5)).alias("i"))
    return change_point(kappa(curve), width=1)


def parallel_analysis(spark: SparkSession, m: np.ndarray, *, k_max: int, p_list: list[float], boots: int, nulls: int, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``k, p_value, significant``: eigenvalues of masked matrices against those of entry-permuted ones; the worst p over the upper half of rates."""

    def task(p: float, b: int) -> pd.DataFrame:
        a = _unbiased(m, _mask(len(m), p, seed + 7919 * b), p)
        values = symmetric_eigen(a, k_max)[0]
        i, j = np.triu_indices(len(a), 1)
        rng = np.random.default_rng(seed + 104729 * b)
        reached = np.zeros(len(values))
        for _ in range(nulls):
            x = np.diag(np.diag(a)).astype(float)
            x[i, j] = rng.permutation(a[i, j])
            reached += symmetric_eigen(x + np.triu(x, 1).T, k_max)[0] >= values
        return pd.DataFrame({"p": p, "b": b, "k": np.arange(1, len(values) + 1), "reached": reached})

    rows = on_grid(spark, [(float(p), b) for p in p_list for b in range(boots)], "p double, b long", task, "p double, b long, k long, reached double")
    each = rows.groupBy("p", "k").agg(((F.sum("reached") + 1) / (F.count(F.lit(1)) * nulls + 1)).alias("v"))
    cut = float(np.median(p_list))
    return each.where(F.col("p") >= cut).groupBy("k").agg(F.max("v").alias("p_value")).withColumn("significant", F.col("p_value") <= alpha)


def fits(spark: SparkSession, m: np.ndarray, ranks: list[int], seeds: list[int], **solver) -> DataFrame:
    """``rank, seed, id, dim, x`` of one factorisation a task; id counts from 0."""

    def task(rank: int, seed: int) -> pd.DataFrame:
        w, _ = sym_nmf(m, int(rank), seed=int(seed), **solver)
        i, k = np.indices(w.shape).reshape(2, -1)
        return pd.DataFrame({"rank": rank, "seed": seed, "id": i, "dim": k + 1, "x": w.reshape(-1)})

    return on_grid(spark, [(r, s) for r in ranks for s in seeds], "rank long, seed long", task, "rank long, seed long, id long, dim long, x double")


def cross_validate(spark: SparkSession, m: np.ndarray, ranks: list[int], *, folds: int = 5, repeats: int = 1, rate: float = 1.0, seed: int = 0, **solver) -> DataFrame:
    """``rep, fold, rank, val_mse``: entries of the upper triangle in folds; each fold's entries are hidden in turn, and of the others a share is kept."""
    i, j = np.triu_indices(len(m), 1)
    seen = np.isfinite(m[i, j])
    i, j = i[seen], j[seen]
    low, high = float(np.nanmin(m)), float(np.nanmax(m))

    def task(rep: int, fold: int, rank: int) -> pd.DataFrame:
        rng = np.random.default_rng(seed + rep)
        of, keep = rng.integers(0, folds, len(i)), rng.random(len(i)) < rate
        x = m.copy()
        hide = (of == fold) | ~keep
        x[i[hide], j[hide]] = x[j[hide], i[hide]] = np.nan
        w, _ = sym_nmf(x, int(rank), seed=seed + rep * 31 + fold, low=low, high=high, **solver)
        test = of == fold
        error = (w @ w.T)[i[test], j[test]] - m[i[test], j[test]]
        return pd.DataFrame({"rep": [rep], "fold": [fold], "rank": [rank], "val_mse": [float(np.square(error).mean())]})

    grid = [(r, f, k) for r in range(repeats) for f in range(folds) for k in ranks]
    return on_grid(spark, grid, "rep long, fold long, rank long", task, "rep long, fold long, rank long, val_mse double")


def aligned(reference: np.ndarray, other: np.ndarray, *, by: str = "cosine") -> tuple[np.ndarray, np.ndarray]:
    """Columns of ``other`` in the order that matches the reference best, and each match's score."""
    a, b = reference, other
    if by in ("correlation", "absolute"):
        a, b = a - a.mean(0), b - b.mean(0)
    norm = np.linalg.norm(a, axis=0)[:, None] * np.linalg.norm(b, axis=0)[None]
    score = np.divide(a.T @ b, norm, out=np.zeros((a.shape[1], b.shape[1])), where=norm > 0)
    cost = -np.abs(score) if by == "absolute" else -score
    order = hungarian(cost)
    return other[:, order], score[np.arange(len(order)), order]


def consensus(runs: DataFrame) -> DataFrame:
    """``seed, id, dim, x, agreement`` of the selected run: runs are aligned to the first, and the one nearest to their element-wise median is taken whole."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = {s: g.pivot(index="id", columns="dim", values="x").sort_index().to_numpy() for s, g in pdf.groupby("seed")}
        seeds = sorted(w)
        stack = np.stack([aligned(w[seeds[0]], w[s])[0] for s in seeds])
        middle = np.median(stack, axis=0)
        away = np.linalg.norm(stack - middle, axis=(1, 2))
        best = int(away.argmin())
        agree = float(np.mean([aligned(stack[best], x)[1].mean() for k, x in enumerate(stack) if k != best])) if len(seeds) > 1 else 1.0
        i, k = np.indices(middle.shape).reshape(2, -1)
        return pd.DataFrame({"rank": int(pdf["rank"].iloc[0]), "seed": seeds[best], "id": i, "dim": k + 1, "x": stack[best].reshape(-1), "agreement": agree})

    return runs.groupBy("rank").applyInPandas(run, "rank long, seed long, id long, dim long, x double, agreement double")


def effective_rank(values: np.ndarray) -> float:
    """exp of the entropy of normalised absolute values."""
    p = np.abs(values) / max(np.abs(values).sum(), 1e-300)
    p = p[p > 0]
    return float(np.exp(-(p * np.log(p)).sum()))


def planted(spark: SparkSession, n: int, k: int, zeros: float = 0.5) -> DataFrame:
    """``i, j, s`` of W W^T for a hash-drawn sparse non-negative W."""
    from simloom.functions.hashing import uniform

    key = [F.col("id").cast("string"), F.col("dim").cast("string")]
    w = spark.range(n).crossJoin(spark.range(1, k + 1).withColumnRenamed("id", "dim")).withColumn("x", F.when(uniform(F.lit("zero"), *key) >= zeros, uniform(F.lit("w"), *key)).otherwise(0.0))
    v = w.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r.x).alias("v"))
    a, b = v.select(F.col("id").alias("i"), F.col("v").alias("a")), v.select(F.col("id").alias("j"), F.col("v").alias("b"))
    return a.join(b, F.col("i") <= F.col("j")).select("i", "j", F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda t, z: t + z).alias("s"))


def hidden(pairs: DataFrame, retained: float) -> DataFrame:
    """``pairs`` with ``shown``: exactly the given share of off-diagonal pairs by hash rank; the diagonal stays."""
    from simloom.functions.hashing import uniform

    u = uniform(F.lit("hide"), F.col("i").cast("string"), F.col("j").cast("string"))
    w = Window.partitionBy(F.col("i") == F.col("j"))
    ranked = pairs.withColumn("rk", F.row_number().over(w.orderBy(u, "i", "j"))).withColumn("m", F.count(F.lit(1)).over(w))
    return ranked.withColumn("shown", (F.col("i") == F.col("j")) | (F.col("rk") <= F.round(F.col("m") * retained))).drop("rk", "m")


def impute_columns(pairs: DataFrame, how: str = "mean") -> DataFrame:
    """``pairs`` (``i, j, s, shown``) with ``guess``: mean of both items' column means or medians of shown entries."""
    both = pairs.select("i", "j", "s", "shown").unionByName(pairs.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "s", "shown"))
    value = F.avg("s") if how == "mean" else F.percentile("s", F.lit(0.5))
    column = both.where("shown").groupBy("i").agg(value.alias("c"))
    return pairs.join(column.withColumnRenamed("c", "ci"), "i").join(column.select(F.col("i").alias("j"), F.col("c").alias("cj")), "j").withColumn("guess", (F.col("ci") + F.col("cj")) / 2).drop("ci", "cj")
