"""Matrix checks, noise, trend similarity, double centring, co-association and nearest-neighbour imputation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.hashing import normal
from simloom.operators import kernels


def is_symmetric(entries: DataFrame, tol: float = 1e-8) -> DataFrame:
    """``symmetric``: whether each entry has its mirror image, to within ``tol``."""
    back = entries.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("t"))
    both = entries.join(back, ["i", "j"], "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.coalesce(F.abs(F.col("s") - F.col("t")) <= tol, F.lit(False))), F.lit(True)).alias("symmetric"))


def signal_to_noise(df: DataFrame, signal: str, noise: str) -> DataFrame:
    """Ratio of population variances; infinite without noise."""
    s, n = F.var_pop(signal), F.var_pop(noise)
    return df.agg(F.when(n == 0, F.lit(float("inf"))).otherwise(s / n).alias("snr"))


def add_noise(df: DataFrame, snr: float, key: list[str], seed: int = 0) -> DataFrame:
    """sqrt(snr) x + sqrt(1 - snr) sd e with hash-normal e."""
    sd = F.stddev_samp("x").over(Window.partitionBy())
    e = normal(F.lit(f"noise{seed}"), *(F.col(c).cast("string") for c in key))
    return df.withColumn("x", snr**0.5 * F.col("x") + (1 - snr) ** 0.5 * sd * e)


def double_centred(entries: DataFrame) -> DataFrame:
    """``i, j, s`` less row and column means plus the mean of all."""
    row, col, every = Window.partitionBy("i"), Window.partitionBy("j"), Window.partitionBy()
    return entries.withColumn("s", F.col("s") - F.avg("s").over(row) - F.avg("s").over(col) + F.avg("s").over(every))


def trend_similarity(curves: DataFrame) -> DataFrame:
    """``a, b, r``: correlation over p of the curves of k, from ``k, p, i``."""
    other = curves.select("p", F.col("k").alias("b"), F.col("i").alias("y"))
    return curves.withColumnRenamed("k", "a").join(other, "p").groupBy("a", "b").agg(F.coalesce(F.corr("i", "y"), F.lit(0.0)).alias("r"))


def trend_groups(similar: DataFrame, threshold: float, window: int) -> DataFrame:
    """``node, component`` of ranks whose trends correlate and that lie near to each other."""
    from simloom.operators.components import connected_components

    edges = similar.where((F.col("a") < F.col("b")) & (F.col("r") >= threshold) & (F.col("b") - F.col("a") <= window))
    return connected_components(edges, "a", "b")


def signal_floor(curves: DataFrame, q: float = 0.1) -> DataFrame:
    """``floor, mad``: low quantile of overlaps, and their median absolute deviation."""
    m = curves.agg(F.percentile("i", F.lit(0.5)).alias("m"), F.percentile("i", F.lit(q)).alias("floor"))
    return curves.crossJoin(F.broadcast(m)).agg(F.first("floor").alias("floor"), (F.percentile(F.abs(F.col("i") - F.col("m")), F.lit(0.5)) + 1e-12).alias("mad"))


def co_association(labels: DataFrame) -> DataFrame:
    """``i, j, c``: share of runs that put two items together, from ``run, id, label``.

    Where many pairs are together somewhere, labels are compared in the block
    grid of all pairs, and no pair is shuffled; else items are joined by label.
    """
    runs = labels.agg(F.count_distinct("run").alias("n"))
    there = labels.where("run is not null and id is not null and label is not null")
    n, of, most = there.groupBy("run", "id").count().agg(F.count_distinct("id"), F.count_distinct("run"), F.max("count")).first()
    together = there.groupBy("run", "label").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    if most == 1 and of <= MOST_RUNS and dict(labels.dtypes)["id"] in ("int", "bigint") and together * COMPARED >= n * (n - 1) / 2 * of:
        m = kernels.pairs(_coded(there), _same, positive=True).withColumnRenamed("s", "m")
    else:
        two = there.select("run", "label", F.col("id").alias("j"))
        m = there.withColumnRenamed("id", "i").join(two, ["run", "label"]).where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("m"))
    return m.crossJoin(F.broadcast(runs)).select("i", "j", (F.col("m") / F.col("n")).alias("c"))


#: Runs whose labels an item takes along, and labels compared in the time that a joined pair takes.
MOST_RUNS, COMPARED = 1000, 64


def _coded(labels: DataFrame) -> DataFrame:
    """``id, v``: numbers of an item's labels by run, NaN where a run lacks it."""
    number = labels.select("label").distinct().withColumn("code", F.row_number().over(Window.orderBy("label")).cast("double"))
    names = [r.run for r in labels.select("run").distinct().orderBy("run").collect()]
    each = labels.join(number, "label").groupBy(F.col("id").cast("long").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("run", "code"))).alias("by"))
    kind = dict(labels.dtypes)["run"]
    return each.select("id", F.transform(F.array(*(F.lit(r).cast(kind) for r in names)), lambda r: F.coalesce(F.try_element_at("by", r), F.lit(float("nan")))).alias("v"))


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)), np.int16)
    for a, b in zip(x.T, y.T, strict=True):
        out += a[:, None] == b[None]
    return out.astype(float)


def dispersion(pairs: DataFrame, n: int) -> DataFrame:
    """1 - 4 mean(c (1 - c)) over all pairs of n items; pairs without a row have c 0."""
    return pairs.agg((1 - 4 * F.sum(F.col("c") * (1 - F.col("c"))) / (n * (n - 1) / 2)).alias("dispersion"))


def impute_neighbours(pairs: DataFrame, k: int = 5) -> DataFrame:
    """``i, j, guess`` of hidden pairs: mean of the entry in the k nearest columns, averaged over both directions.

    Distances are root mean squares over rows that both columns show.
    """
    both = pairs.where("shown").select("i", "j", "s")
    full = both.unionByName(both.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    near = full.select(F.col("i").alias("row"), F.col("j").alias("a"), "s").join(full.select(F.col("i").alias("row"), F.col("j").alias("b"), F.col("s").alias("t")), "row")
    dist = near.where("a != b").groupBy("a", "b").agg(F.sqrt(F.avg((F.col("s") - F.col("t")) ** 2)).alias("d"))
    hidden = pairs.where("not shown").select("i", "j")
    ways = hidden.select("i", "j", F.col("i").alias("row"), F.col("j").alias("a")).unionByName(hidden.select("i", "j", F.col("j").alias("row"), F.col("i").alias("a")))
    donors = ways.join(dist, "a").join(full.select(F.col("i").alias("row"), F.col("j").alias("b"), "s"), ["row", "b"])
    rank = F.row_number().over(Window.partitionBy("row", "a").orderBy("d", "b"))
    means = donors.withColumn("k", rank).where(F.col("k") <= k).groupBy("i", "j", "row").agg(F.avg("s").alias("g"))
    return means.groupBy("i", "j").agg(F.avg("g").alias("guess"))


def permutation_test(df: DataFrame, a: str, b: str, key: str, n: int, *, seed: int = 0) -> DataFrame:
    """``r, p`` of a vector's correlation against hash permutations of it."""
    from simloom.operators.correlation import p_value, permutations

    perm = permutations(df.select(F.col(key).alias("id")), n, seed=seed)
    moved = perm.join(df.select(F.col(key).alias("id"), F.col(a).alias("x")), "id").join(df.select(F.col(key).alias("to"), F.col(b).alias("y")), "to")
    r = moved.groupBy("perm").agg(F.abs(F.corr("x", "y")).alias("r"))
    seen = r.where("perm = 0").select(F.col("r").alias("observed"))
    return r.where("perm > 0").crossJoin(F.broadcast(seen)).groupBy("observed").agg(p_value(F.col("observed"), F.col("r")).alias("p")).withColumnRenamed("observed", "r")
