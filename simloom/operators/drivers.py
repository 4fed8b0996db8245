"""Estimates and validations that go on where a killed run left off.

What a run has done is an append-only table in a folder of the caller's: a row
for each finished task, with the settings it was run under.  Spark's commit
makes the rows of a batch appear together or not at all, so a task is either
done or not; a run begun again takes what its settings ask for, less what is
there by an anti-join.  Several runs with different settings may share a folder.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.operators import curves as C
from simloom.operators import rowblocks as B


class Ledger:
    """Finished tasks under ``path``: ``settings``, the tasks' ``keys`` and their results."""

    def __init__(self, spark: SparkSession, path: str, settings: dict, keys: list[str], schema: str) -> None:
        self.spark, self.path, self.keys, self.schema = spark, path, keys, f"settings string, {schema}"
        self.settings = hashlib.md5(json.dumps(settings, sort_keys=True).encode(), usedforsecurity=False).hexdigest()

    def rows(self) -> DataFrame:
        """Results under these settings, without the column that names them."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        table = self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)
        return table.where(F.col("settings") == self.settings).drop("settings")

    def missing(self, tasks: DataFrame) -> DataFrame:
        return tasks.join(self.rows().select(*self.keys), self.keys, "left_anti")

    def add(self, results: DataFrame) -> None:
        """Append the results of a batch of tasks, all at once."""
        names = [x.split()[0] for x in self.schema.split(", ")]
        results.withColumn("settings", F.lit(self.settings)).select(*names).write.mode("append").parquet(self.path)

    def run(self, tasks: DataFrame, work: Callable[[list[tuple]], DataFrame], batch: int) -> int:
        """Do the tasks that are missing, ``batch`` at a time in the order of ``tasks``; how many there were."""
        todo = [tuple(r) for r in self.missing(tasks.select(*self.keys)).collect()]
        order = {tuple(r): k for k, r in enumerate(tasks.select(*self.keys).collect())}
        todo.sort(key=order.__getitem__)
        for at in range(0, len(todo), batch):
            self.add(work(todo[at : at + batch]))
        return len(todo)


def validate(of: B.Blocks, path: str, ranks: list[int], *, folds: int = 5, repeats: int = 1, rate: float = 1.0, gap: int = 1, rounds: int = 4, seed: int = 0, **solver) -> DataFrame:
    """``rep, fold, rank, val_mse`` of the given ranks, and of the ranks halfway to the best one's neighbours until those are within ``gap`` or the rounds are over.

    Ranks go from the outermost in, a batch each.
    """
    spark = of.spark
    settings = {"items": len(of.ids), "pairs": of.pairs, "folds": folds, "rate": rate, "seed": seed, **solver}
    ledger = Ledger(spark, path, settings, ["rep", "fold", "rank"], "rep long, fold long, rank long, val_mse double")
    wanted = sorted(set(ranks))
    for turn in range(rounds + 1):
        order = [r.rank for r in C.outer_in(spark.createDataFrame([(k,) for k in wanted], "rank long")).orderBy("place").collect()]
        tasks = spark.createDataFrame([(r, f, k) for k in order for r in range(repeats) for f in range(folds)], "rep long, fold long, rank long")
        ledger.run(tasks, lambda cells: B.cross_validate(of, [], folds=folds, rate=rate, seed=seed, cells=cells, **solver), folds * repeats)
        found = ledger.rows().where(F.col("rank").isin(wanted) & (F.col("rep") < repeats))
        more = {r.rank for r in C.bisect_around(C.rank_stats(found), gap).collect()} - set(wanted)
        if not more or turn == rounds:
            return found
        wanted = sorted({*wanted, *more})
    raise AssertionError


def estimate(of: B.Blocks, path: str, *, k: int, rates: list[float], boots: int, seed: int = 0) -> DataFrame:
    """``p, b, k, i, null``: masked subspace overlaps, a task each rate, from which a rank follows by ``curves.kappa`` and ``curves.change_point``."""
    settings = {"items": len(of.ids), "pairs": of.pairs, "k": k, "boots": boots, "seed": seed}
    ledger = Ledger(of.spark, path, settings, ["p"], "p double, b long, k long, i double, null double")
    tasks = of.spark.createDataFrame([(float(p),) for p in sorted(set(rates), reverse=True)], "p double")
    ledger.run(tasks, lambda batch: B.subspace_overlap(of, k, [p for (p,) in batch], boots, seed=seed)[0], 1)
    return ledger.rows().where(F.col("p").isin([float(p) for p in rates]))
