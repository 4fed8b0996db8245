"""Feature transforms on long tables ``id, dim, x``: one row for each entry.

``axis`` 0 works on each feature (``dim``), 1 on each item (``id``).  Nulls and
NaNs are missing: they stay so and don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.operators.orderstats import quantiles
from simloom.scratch import Scratch

EPS = 1e-8


def _over(axis: int) -> Window:
    return Window.partitionBy("dim" if axis == 0 else "id")


def _finite(x: str = "x") -> Column:
    return F.when(~F.isnan(x), F.col(x))


def _put(df: DataFrame, x: Column) -> DataFrame:
    return df.withColumn("x", x)


def center(df: DataFrame, axis: int = 0) -> DataFrame:
    return _put(df, F.col("x") - F.avg(_finite()).over(_over(axis)))


def standardize(df: DataFrame, axis: int = 0) -> DataFrame:
    """Population standard scores; a constant feature divides by one."""
    sd = F.stddev_pop(_finite()).over(_over(axis))
    return _put(df, (F.col("x") - F.avg(_finite()).over(_over(axis))) / F.when(sd == 0, 1.0).otherwise(sd))


def normalize_l2(df: DataFrame, axis: int = 0, eps: float = EPS) -> DataFrame:
    return _put(df, F.col("x") / (F.sqrt(F.sum(_finite() * _finite()).over(_over(axis))) + eps))


def normalize_l1(df: DataFrame, axis: int = 0, eps: float = EPS) -> DataFrame:
    return _put(df, F.col("x") / (F.sum(F.abs(_finite())).over(_over(axis)) + eps))


def positive_shift(df: DataFrame, axis: int = 0) -> DataFrame:
    """Less the minimum of the whole table, whatever the axis."""
    low = df.agg(F.min(_finite()).alias("low"))
    return _put(df.crossJoin(F.broadcast(low)), F.col("x") - F.col("low")).drop("low")


def softmax(df: DataFrame, axis: int = 1) -> DataFrame:
    w = _over(axis)
    e = F.exp(F.col("x") - F.max("x").over(w))
    return _put(_put(df, e), F.col("x") / F.sum("x").over(w))


def log_softmax(df: DataFrame, axis: int = 1) -> DataFrame:
    return _put(softmax(df, axis), F.log("x"))


def relu(df: DataFrame, axis: int = 0) -> DataFrame:
    return _put(df, F.greatest(F.col("x"), F.lit(0.0)))


def log(df: DataFrame, axis: int = 0) -> DataFrame:
    return _put(df, F.log("x"))


TRANSFORMS: dict[str, Callable[..., DataFrame]] = {
    "center": center, "standardize": standardize, "normalize_l2": normalize_l2, "normalize_l1": normalize_l1,
    "positive_shift": positive_shift, "softmax": softmax, "log_softmax": log_softmax, "relu": relu, "log": log,
}


def apply_transform(df: DataFrame, transform: str | Sequence[str] | None, axis: int = 0) -> DataFrame:
    """Named transforms from left to right."""
    for name in [transform] if isinstance(transform, str) else transform or ():
        if name not in TRANSFORMS:
            raise ValueError(f"unknown transform {name!r}; there are {', '.join(sorted(TRANSFORMS))}")
        df = TRANSFORMS[name](df, axis)
    return df


def one_hot(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """Each row of ``df`` with each class of ``classes`` (``c``) and ``x`` 1 or 0; classes are few."""
    return df.crossJoin(F.broadcast(classes)).withColumn("x", (F.col(label) == F.col("c")).cast("double"))


def log_likelihood(x: Column, mean: Column, std: Column) -> Column:
    """Gaussian log density."""
    z = (x - mean) / std
    return -0.5 * z * z - F.log(std) - 0.5 * F.log(F.lit(2.0) * F.pi())


def normal_pdf(x: Column, mean: Column, std: Column) -> Column:
    return F.exp(log_likelihood(x, mean, std))


def fisher_z(r: Column, eps: float = 1e-7) -> Column:
    """atanh of r clipped short of one; null if not finite."""
    good = F.when(~F.isnan(r) & (F.abs(r) < F.lit(float("inf"))), r)
    return F.atanh(F.least(F.greatest(good, F.lit(eps - 1)), F.lit(1 - eps)))


def average_r(r: Column, eps: float = 1e-7) -> Column:
    """Aggregate: mean correlation by way of Fisher's z."""
    return F.tanh(F.avg(fisher_z(r, eps)))


def spearman_brown(r: Column, factor: float) -> Column:
    return factor * r / (1 + (factor - 1) * r)


def rss(y: Column, p: Column) -> Column:
    """Aggregate: residual sum of squares."""
    return F.sum((y - p) * (y - p))


def aic(y: Column, p: Column, predictors: int) -> Column:
    """Aggregate: n ln(rss / n) + 2 (k + 1)."""
    n = F.count(F.lit(1))
    return n * F.log(rss(y, p) / n) + 2 * (predictors + 1)


def explained(y: Column, p: Column) -> Column:
    """Aggregate: 1 - |y - p| / |y|, in Frobenius norms."""
    return 1 - F.sqrt(rss(y, p)) / F.sqrt(F.sum(y * y))


def explained_variance(y: Column, p: Column) -> Column:
    """Aggregate: 1 - var(y - p) / var(y), population variances."""
    return 1 - F.var_pop(y - p) / F.var_pop(y)


def harmonic_mean(a: Column, b: Column) -> Column:
    """Null unless both are positive."""
    return F.when((a > 0) & (b > 0), 2 * a * b / (a + b))


def sparseness(df: DataFrame) -> DataFrame:
    """Share of entries below the mean, of zeros, and mean purity of items; null share if an entry is negative."""
    mean = df.agg(F.avg("x").alias("m"), F.min("x").alias("low"))
    share = df.crossJoin(F.broadcast(mean)).agg(
        F.when(F.min("low") >= 0, F.avg((F.col("x") < F.col("m")).cast("double"))).alias("below_mean"), F.avg((F.col("x") == 0).cast("double")).alias("zeros")
    )
    purity = df.groupBy("id").agg((F.max("x") / (F.sum("x") + 1e-10)).alias("p")).agg(F.avg("p").alias("purity"))
    return share.crossJoin(purity)


def gram(df: DataFrame) -> DataFrame:
    """``a, b, g`` with g the dot product of dimensions a and b, by a join on the item."""
    other = df.select("id", F.col("dim").alias("b"), F.col("x").alias("y"))
    return df.withColumnRenamed("dim", "a").join(other, "id").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))


def orthogonality(df: DataFrame) -> DataFrame:
    """|W'W - I| / |I| in Frobenius norms."""
    d = F.col("g") - (F.col("a") == F.col("b")).cast("double")
    return gram(df).agg((F.sqrt(F.sum(d * d)) / F.sqrt(F.sum((F.col("a") == F.col("b")).cast("double")))).alias("orthogonality"))


def split_at(pairs: DataFrame, how: str = "median", *, middle: float | None = None) -> DataFrame:
    """Positive and negative parts of ``s`` about its median or zero, with the mask of the former; with the median given as ``middle`` nothing is written."""
    t = 0.0 if how != "median" else middle
    if how == "median" and middle is None:
        pairs = Scratch(pairs.sparkSession, "split").table(pairs, "pairs")
        t = quantiles(pairs.select("s"), [0.5])[0]
    pairs, zero = pairs.withColumn("t", F.lit(t).cast("double")), F.lit(0.0)
    return pairs.select(
        "*", F.greatest(F.col("s") - F.col("t"), zero).alias("pos"), F.greatest(F.col("t") - F.col("s"), zero).alias("neg"), (F.col("s") >= F.col("t")).alias("mask")
    )
