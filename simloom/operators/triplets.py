"""Odd-one-out judgements ``a, b, c`` (a and b chosen as the pair, c odd) to similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.hashing import uniform
from simloom.operators import kernels
from simloom.scratch import Scratch

#: Triplets whose products a task makes; a small table of vectors is one task's until they are dealt out.
DRAWS = 1 << 18


def pair_wins(triplets: DataFrame) -> DataFrame:
    """``i, j, wins, trials``: times the pair was chosen, and shown; i < j."""
    shown = [("a", "b", 1), ("a", "c", 0), ("b", "c", 0)]
    each = F.explode(F.array(*(F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), F.lit(w).alias("w")) for x, y, w in shown)))
    return triplets.select(each.alias("p")).groupBy("p.i", "p.j").agg(F.sum("p.w").cast("long").alias("wins"), F.count(F.lit(1)).alias("trials"))


def laplace(wins: Column, trials: Column, alpha: float = 1.0) -> Column:
    return (wins + alpha) / (trials + 2 * alpha)


def similarity(wins: DataFrame, alpha: float = 1.0, *, items: DataFrame | None = None, fill: float | None = None) -> DataFrame:
    """``i, j, s`` of observed pairs; of all pairs of ``items`` (``id``) if ``fill`` is given."""
    seen = wins.select("i", "j", laplace(F.col("wins"), F.col("trials"), alpha).alias("s"))
    if fill is None:
        return seen
    if dict(items.dtypes)["id"] in ("int", "bigint") and items.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        return kernels.filled(items.select(F.col("id").cast("long").alias("id")), seen, fill)
    grid = items.select(F.col("id").alias("i")).join(items.select(F.col("id").alias("j")), F.col("i") < F.col("j"))
    return grid.join(seen, ["i", "j"], "left").withColumn("s", F.coalesce("s", F.lit(fill)))


def bias_prior(wins: DataFrame, *, alpha: float = 1.0, weight_mode: str = "fisher", clip: float = 1e-3, steps: int = 50, tol: float = 1e-6) -> tuple[float, DataFrame]:
    """Intercept and item biases ``id, b`` of a weighted least-squares fit to the pairs' logits.

    Jacobi updates, centred; each step is one aggregation of the pair table, and
    lineage is cut every few steps.
    """
    if wins.isEmpty():
        raise ValueError("no observed pair")
    scratch = Scratch(wins.sparkSession, "bias")
    m = F.least(F.greatest(laplace(F.col("wins"), F.col("trials"), alpha), F.lit(clip)), F.lit(1 - clip))
    weight = F.col("trials") * F.col("m") * (1 - F.col("m")) if weight_mode == "fisher" else F.col("trials").cast("double")
    pairs = scratch.table(wins.withColumn("m", m).select("i", "j", F.log(F.col("m") / (1 - F.col("m"))).alias("y"), weight.alias("w")), "pairs")
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "y", "w"))
    mean = pairs.agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("m")).first().m
    bias = both.select(F.col("i").alias("id")).distinct().withColumn("b", F.lit(0.0))
    for k in range(steps):
        there = bias.select(F.col("id").alias("j"), F.col("b").alias("bj"))
        new = both.join(there, "j").groupBy(F.col("i").alias("id")).agg((F.sum(F.col("w") * (F.col("y") - mean - F.col("bj"))) / F.sum("w")).alias("b"))
        centred = scratch.table(new.crossJoin(F.broadcast(new.agg(F.avg("b").alias("c")))).select("id", (F.col("b") - F.col("c")).alias("b")), f"bias_{k}")
        change = centred.join(bias.withColumnRenamed("b", "old"), "id").agg(F.max(F.abs(F.col("b") - F.col("old"))).alias("d")).first().d
        bias = centred
        if k:
            scratch.drop(f"bias_{k - 1}")
        if change < tol:
            break
    return mean, bias


def prior_of(pairs: DataFrame, mean: float, bias: DataFrame) -> DataFrame:
    """``pairs`` with ``prior``, the expit of the intercept and both biases."""
    one, two = (bias.select(F.col("id").alias(k), F.col("b").alias(f"b{k}")) for k in "ij")
    z = F.lit(mean) + F.col("bi") + F.col("bj")
    return pairs.join(F.broadcast(one), "i").join(F.broadcast(two), "j").withColumn("prior", 1 / (1 + F.exp(-z))).drop("bi", "bj")


def bias_aware(wins: DataFrame, mean: float, bias: DataFrame, *, alpha: float = 1.0, strength: float = 10.0) -> DataFrame:
    """``i, j, s``: (wins + alpha + strength prior) / (trials + 2 alpha + strength)."""
    s = (F.col("wins") + alpha + strength * F.col("prior")) / (F.col("trials") + 2 * alpha + strength)
    return prior_of(wins, mean, bias).select("i", "j", s.alias("s"))


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)


def with_dots(triplets: DataFrame, items: DataFrame) -> DataFrame:
    """Triplets with the dot products ``ab, ac, bc`` of their items' vectors."""
    out = triplets
    for k in "abc":
        out = out.join(items.select(F.col("id").alias(k), F.col("v").alias(f"v{k}")), k)
    return out.select(*triplets.columns, *(_dot(f"v{x}", f"v{y}").alias(x + y) for x, y in ("ab", "ac", "bc")))


def accuracy(triplets: DataFrame, items: DataFrame) -> DataFrame:
    """Share of triplets whose pair is strictly the most similar."""
    hit = (F.col("ab") > F.col("ac")) & (F.col("ab") > F.col("bc"))
    return with_dots(triplets, items).agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def sampled(items: DataFrame, per_item: int) -> DataFrame:
    """Hash-drawn triplets over items numbered from 0, their most similar pair first."""
    n = items.count()
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, n * per_item // DRAWS)
    at = lambda k: F.floor(uniform(F.lit(k), F.col("i").cast("string"), F.col("r").cast("string")) * n).cast("long")
    drawn = items.select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(per_item - 1))).alias("r")).select("i", "r", at("j").alias("j"), at("k").alias("k")).where("i != j and i != k and j != k").repartition(tasks, "i", "r")
    dots = with_dots(drawn.withColumnsRenamed({"i": "a", "j": "b", "k": "c"}), items)
    best = F.greatest("ab", "ac", "bc")
    return dots.select(
        F.when(F.col("ab") == best, F.col("a")).when(F.col("ac") == best, F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(F.col("ab") == best, F.col("b")).otherwise(F.col("c")).alias("b"),
        F.when(F.col("ab") == best, F.col("c")).when(F.col("ac") == best, F.col("b")).otherwise(F.col("a")).alias("c"),
    )


def hash_split(df: DataFrame, key: list[str], share: float, seed: int = 0) -> DataFrame:
    """``df`` with ``train``: a hash split that gives about ``share`` of the rows."""
    return df.withColumn("train", uniform(F.lit(f"split{seed}"), *(F.col(c).cast("string") for c in key)) < share)


def partitions(df: DataFrame, key: list[str], parts: int) -> DataFrame:
    """``df`` with ``part``: equal partitions in hash order; the remainder is dropped."""
    n = df.count() // parts
    order = [uniform(F.lit("part"), *(F.col(c).cast("string") for c in key)), *key]
    return df.withColumn("k", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("k") < n * parts).withColumn("part", F.floor(F.col("k") / n).cast("long")).drop("k")
