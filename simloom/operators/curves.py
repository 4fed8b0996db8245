"""Curves over ranks: summaries, selection rules, window operators and change points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_stats(curve: DataFrame) -> DataFrame:
    """``rank, mean, std, n, sem`` of ``rank, val_mse``."""
    n = F.count(F.lit(1))
    return curve.groupBy("rank").agg(F.avg("val_mse").alias("mean"), F.stddev_samp("val_mse").alias("std"), n.alias("n"), (F.stddev_samp("val_mse") / F.sqrt(F.greatest(n, F.lit(1)))).alias("sem"))


def selected(stats: DataFrame) -> DataFrame:
    """``argmin_rank, one_se_rank, edge``: of the lowest mean, of the one-standard-error rule, and where the former lies."""
    best = stats.agg(F.min_by("rank", F.struct("mean", "rank")).alias("argmin_rank"), F.min(F.struct("mean", "rank", "sem")).alias("b"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    within = stats.crossJoin(F.broadcast(best)).agg(F.min(F.when(F.col("mean") <= F.col("b.mean") + F.col("b.sem"), F.col("rank"))).alias("one_se_rank"), *(F.first(c).alias(c) for c in ("argmin_rank", "low", "high")))
    edge = F.when(F.col("argmin_rank") == F.col("low"), "first").when(F.col("argmin_rank") == F.col("high"), "last").otherwise("interior")
    return within.select("argmin_rank", "one_se_rank", edge.alias("edge"))


def complete_ranks(curve: DataFrame, expected: int) -> DataFrame:
    return curve.where(~F.isnan("val_mse")).groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= expected)


def merged(curves: DataFrame, priority: str) -> DataFrame:
    """All rows of the file with the greatest ``priority`` for each rank."""
    best = curves.groupBy("rank").agg(F.max(priority).alias(priority))
    return curves.join(best, ["rank", priority], "left_semi")


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def relative(stats: DataFrame) -> DataFrame:
    """Means divided by the least; the spread is the raw deviation, or the error's if there is none."""
    w = Window.partitionBy()
    return stats.select("rank", (F.col("mean") / F.min("mean").over(w)).alias("relative"), F.coalesce("std", F.col("sem") * F.sqrt("n")).alias("spread"))


def quantile_bin(df: DataFrame, x: str, q: int) -> DataFrame:
    """``df`` with ``bin``: intervals between quantiles, closed on the right; equal edges are one."""
    edges = df.agg(F.array_distinct(F.percentile(x, F.array(*(F.lit(k / q) for k in range(q + 1))))).alias("edges"))
    above = F.size(F.filter(F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))), lambda e: F.col(x) > e))
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", above.cast("long")).drop("edges")


def summary(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean, deviation, standard error, median and half width of the 95 % band by group."""
    sem = F.stddev_samp(x) / F.sqrt(F.count(x))
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), sem.alias("sem"), F.percentile(x, F.lit(0.5)).alias("median"), (1.96 * sem).alias("half"), F.count(x).alias("n"))


def smooth_median(df: DataFrame, order: str, x: str, width: int, by: list[str] | None = None) -> Column:
    """Centred rolling median, cut off at the ends."""
    half = width // 2
    return F.percentile(x, F.lit(0.5)).over(Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-half, half))


def jump(order: str, x: str | Column, by: list[str] | None = None) -> Column:
    return F.lead(x).over(Window.partitionBy(*(by or [])).orderBy(order)) - (F.col(x) if isinstance(x, str) else x)


def running(order: str, x: str, by: list[str] | None = None) -> tuple[Column, Column, Column]:
    """Prefix sum of squares, running mean of it, and its increment."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    square = F.sum(F.col(x) * F.col(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return square, square / F.row_number().over(w), F.col(x) * F.col(x)


def first_run(df: DataFrame, order: str, x: str, threshold: float, run: int, by: list[str]) -> DataFrame:
    """First ``order`` from which ``run`` values in a row reach the threshold; null if none do."""
    w = Window.partitionBy(*by).orderBy(order)
    ok = (F.col(x) >= threshold).cast("int")
    hit = (F.sum(ok).over(w.rowsBetween(0, run - 1)) == run) & (F.count(F.lit(1)).over(w.rowsBetween(0, run - 1)) == run)
    return df.withColumn("hit", hit).groupBy(*by).agg(F.min(F.when(F.col("hit"), F.col(order))).alias("first"))


def forward_fill(order: str, x: str, by: list[str] | None = None, start: float = 0.0) -> Column:
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(x, ignorenulls=True).over(w), F.lit(start))


def expanding_correlation(df: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """``order, r``: correlation over all rows up to each; running sums, no self-join."""
    return df.select(order, F.corr(a, b).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).alias("r"))


def top_k(df: DataFrame, by: list[str], value: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(value), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def poles(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The ``n`` lowest and highest rows, as ``pole`` low and high; fewer than 2 n rows are an error."""
    if df.count() < 2 * n:
        raise ValueError("too few rows for two poles")
    low = df.orderBy(value, key).limit(n).withColumn("pole", F.lit("low"))
    return low.unionByName(df.orderBy(F.desc(value), key).limit(n).withColumn("pole", F.lit("high")))


def outer_in(ranks: DataFrame) -> DataFrame:
    """Ranks in the order lowest, highest, second lowest, ... as ``place``."""
    w = Window.orderBy("rank")
    numbered = ranks.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    place = F.when(2 * F.col("k") <= F.col("n") + 1, 2 * F.col("k") - 1).otherwise(2 * (F.col("n") - F.col("k") + 1))
    return numbered.select("rank", place.cast("long").alias("place"))


def rank_grid(spark, start: int, stop: int, step: int) -> DataFrame:
    """Inclusive grid of ranks."""
    return spark.range(start, stop + 1, step).withColumnRenamed("id", "rank")


def bisect_around(stats: DataFrame, gap: int) -> DataFrame:
    """Midpoints between the best rank and its neighbours that lie more than ``gap`` away."""
    w = Window.orderBy("rank")
    near = stats.select("rank", "mean", F.lag("rank").over(w).alias("before"), F.lead("rank").over(w).alias("after"))
    best = near.orderBy("mean", "rank").limit(1)
    mid = lambda a, b: F.when(F.abs(F.col(a) - F.col(b)) > gap, F.floor((F.col(a) + F.col(b)) / 2))
    return best.select(F.explode(F.array(mid("before", "rank"), mid("rank", "after"))).alias("rank")).where("rank is not null")


def histogram_entropy(df: DataFrame, x: str, by: list[str], bins: int, *, bits: bool = True) -> DataFrame:
    """Entropy of values in 0 .. 1 over equal bins, the last one closed."""
    b = F.least(F.floor(F.col(x) * bins), F.lit(bins - 1))
    return entropy_of_counts(df.groupBy(*by, b.alias("b")).agg(F.count(F.lit(1)).alias("n")), by, bits=bits)


def entropy_of_counts(counts: DataFrame, by: list[str], *, bits: bool = True) -> DataFrame:
    """Entropy of positive counts ``n`` of the bins of each group."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * (F.log2("p") if bits else F.log("p")))).alias("entropy"))


def baseline_corrected(i: Column, k: Column, n: int) -> Column:
    return F.least(F.greatest((i - k / n) / (1 - k / n), F.lit(0.0)), F.lit(1.0))


def kappa(curves: DataFrame, quantile: float = 0.85) -> DataFrame:
    """``k, kappa``: median over the upper band of p of (1 - I) p / (1 - p), from ``k, p, i``."""
    cut = curves.select("p").distinct().agg(F.percentile("p", F.lit(quantile)).alias("cut"))
    leak = (1 - F.col("i")) * F.col("p") / (1 - F.col("p"))
    return curves.crossJoin(F.broadcast(cut)).where("p >= cut and p < 1").groupBy("k").agg(F.percentile(leak, F.lit(0.5)).alias("kappa"))


def change_point(kappas: DataFrame, *, width: int = 5, relative_jump: bool = False, least_k: int = 1) -> DataFrame:
    """``k``: where the smoothed curve jumps most; of fewer than three the last."""
    smooth = kappas.withColumn("s", smooth_median(kappas, "k", "kappa", width))
    step = jump("k", "s")
    step = step / F.greatest(F.abs("s"), F.lit(1e-12)) if relative_jump else step
    best = smooth.withColumn("d", step).where(F.col("d").isNotNull() & (F.col("k") >= least_k)).agg(F.max_by("k", F.struct("d", -F.col("k"))).alias("k"), F.max("d").alias("jump"))
    last = kappas.agg(F.max("k").alias("last"), F.count(F.lit(1)).alias("n"))
    return best.crossJoin(last).select(F.when(F.col("n") < 3, F.col("last")).otherwise(F.coalesce("k", "last")).alias("k"), "jump")


def knee(values: DataFrame) -> DataFrame:
    """``k`` of a falling convex curve ``k, v`` that lies farthest below its chord; 1 if none does."""
    span = values.agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    gap = 1 - (F.col("k") - F.col("k0")) / (F.col("k1") - F.col("k0")) - (F.col("v") - F.col("v0")) / (F.col("v1") - F.col("v0"))
    return values.crossJoin(F.broadcast(span)).withColumn("gap", gap).agg(F.coalesce(F.max_by("k", F.struct("gap", -F.col("k"))), F.lit(1)).alias("k"))


def mad(x: str) -> tuple[Column, Column]:
    return F.percentile(x, F.lit(0.5)), F.percentile(x, F.lit(0.5))
