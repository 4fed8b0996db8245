"""Fits to odd-one-out judgements scored on held-out ones, and how the score grows with the judgements used."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.hashing import uniform
from simloom.operators import rowblocks as B
from simloom.operators import triplets as T
from simloom.scratch import Scratch


def nested_wins(triplets: DataFrame, fractions: list[float], *, seed: int = 0) -> DataFrame:
    """``fraction, i, j, wins, trials``: pair counts of nested hash samples of ``a, b, c``, all from one aggregation of the pairs.

    A triplet is in every sample whose fraction lies above its hash; a pair has
    rows from the first sample on that shows it.
    """
    shares = sorted(set(map(float, fractions)))
    u = uniform(F.lit(f"fraction{seed}"), *(F.col(c).cast("string") for c in "abc"))
    from_ = F.lit(0)
    for f in shares:
        from_ = from_ + (u >= f).cast("int")  # the first sample that has the triplet
    shown = [("a", "b", 1), ("a", "c", 0), ("b", "c", 0)]
    each = F.explode(F.array(*(F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), F.lit(w).alias("w")) for x, y, w in shown)))
    pairs = triplets.select(each.alias("p"), from_.alias("first")).where(F.col("first") < len(shares))
    sums = [F.struct(F.lit(f).alias("fraction"), F.sum(F.when(F.col("first") <= k, F.col("p.w")).otherwise(0)).alias("wins"), F.count_if(F.col("first") <= k).alias("trials")) for k, f in enumerate(shares)]
    counted = pairs.groupBy("p.i", "p.j").agg(F.array(*sums).alias("of"))
    return counted.select("i", "j", F.explode("of").alias("of")).where("of.trials > 0").select("of.fraction", "i", "j", "of.wins", "of.trials")


def fit_and_score(wins: DataFrame, test: DataFrame, ranks: list[int], *, alpha: float = 1.0, seed: int = 0, **solver) -> DataFrame:
    """``rank, mse, accuracy, n``: factorisations of the smoothed similarity, and the share of test triplets they tell; triplets with an item unseen are left out."""
    spark = wins.sparkSession
    of = B.blocks(T.similarity(wins, alpha), Scratch(spark, "lowdata"))
    fits = [B.Fit(k, seed) for k in ranks]
    out = []
    for fit, (w, error) in zip(fits, B.factorize(of, fits, **solver), strict=True):
        items = spark.createDataFrame(pd.DataFrame({"id": of.ids, "v": w.tolist()}), "id long, v array<double>")
        out.append(T.accuracy(test, items).select(F.lit(fit.rank).cast("long").alias("rank"), F.lit(error / max(1, 2 * of.pairs)).alias("mse"), "accuracy", "n"))
    return reduce(DataFrame.unionByName, out)


def low_data_curve(train: DataFrame, test: DataFrame, fractions: list[float], ranks: list[int], *, alpha: float = 1.0, seed: int = 0, **solver) -> DataFrame:
    """``fraction, rank, mse, accuracy, n`` for each nested sample of the training triplets."""
    scratch = Scratch(train.sparkSession, "fractions")
    counts, held = scratch.table(nested_wins(train, fractions, seed=seed), "counts"), scratch.table(test.select("a", "b", "c"), "test")
    each = [fit_and_score(counts.where(F.col("fraction") == f), held, ranks, alpha=alpha, seed=seed, **solver).withColumn("fraction", F.lit(f)) for f in sorted(set(map(float, fractions)))]
    return reduce(DataFrame.unionByName, each).select("fraction", "rank", "mse", "accuracy", "n")
