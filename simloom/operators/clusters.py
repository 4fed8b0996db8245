"""Cluster agreement, mutual information and TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.numeric import hungarian


def metrics(df: DataFrame, true: str, found: str) -> DataFrame:
    """``purity, ari, nmi, entropy`` of two labellings, from their contingency table; the entropy of classes in clusters is 0 to 1."""
    n = df.groupBy(F.col(true).alias("t"), F.col(found).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    full = n.withColumn("a", F.sum("n").over(Window.partitionBy("t"))).withColumn("b", F.sum("n").over(Window.partitionBy("p"))).withColumn("s", F.sum("n").over(Window.partitionBy()))
    full = full.withColumn("best", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("n")))).withColumn("ka", F.count(F.lit(1)).over(Window.partitionBy("t"))).withColumn("kb", F.count(F.lit(1)).over(Window.partitionBy("p")))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    out = full.agg(
        F.first("s").alias("s"),
        F.sum(F.when(F.col("best") == 1, F.col("n"))).alias("top"),
        F.sum(pairs("n")).alias("i"),
        F.sum(pairs("a") / F.col("ka")).alias("x"),
        F.sum(pairs("b") / F.col("kb")).alias("y"),
        F.sum(F.col("n") / F.col("s") * F.log(F.col("n") * F.col("s") / (F.col("a") * F.col("b")))).alias("mi"),
        (-F.sum(F.col("n") / F.col("s") * F.log(F.col("a") / F.col("s")))).alias("ht"),
        (-F.sum(F.col("n") / F.col("s") * F.log(F.col("b") / F.col("s")))).alias("hp"),
        (-F.sum(F.col("n") * F.log2(F.col("n") / F.col("b")))).alias("mixed"),
        F.count_distinct("t").alias("classes"),
    )
    chance = F.col("x") * F.col("y") / (F.col("s") * (F.col("s") - 1) / 2)
    return out.select((F.col("top") / F.col("s")).alias("purity"), ((F.col("i") - chance) / ((F.col("x") + F.col("y")) / 2 - chance)).alias("ari"), (F.col("mi") / ((F.col("ht") + F.col("hp")) / 2)).alias("nmi"), (F.col("mixed") / (F.col("s") * F.log2("classes"))).alias("entropy"))


def mapped_accuracy(df: DataFrame, true: str, found: str, most: int = 2000) -> DataFrame:
    """``accuracy``: share of rows whose cluster is assigned to their label, by the assignment with most rows.

    Rows with a null label count as wrong; over ``most`` labels or clusters raise an error.
    """
    n = df.groupBy(F.col(true).alias("t"), F.col(found).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sizes = n.agg(F.count_distinct("t").alias("t"), F.count_distinct("p").alias("p")).first()
    if max(sizes) > most:
        raise ValueError("more labels than the assignment holds")
    rows = n.collect()
    kept = [r for r in rows if r.t is not None and r.p is not None]
    t, p = ({v: k for k, v in enumerate(sorted({r[c] for r in kept}))} for c in ("t", "p"))
    count = np.zeros((max(len(t), len(p)),) * 2)
    for r in kept:
        count[t[r.t], p[r.p]] = r.n
    right = count[np.arange(len(count)), hungarian(-count)].sum() if kept else 0.0
    total = sum(r.n for r in rows)
    return df.sparkSession.createDataFrame([(float(right / total) if total else None,)], "accuracy double")


def width_bins(df: DataFrame, bins: int | None = None) -> DataFrame:
    """``id, dim, b``: equally wide bins of each dimension, as many as given or by Freedman and Diaconis (2 to 50; 5 without spread)."""
    quartile = lambda q: F.percentile("x", F.lit(q))
    ends = df.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("top"), (quartile(0.75) - quartile(0.25)).alias("iqr"), F.count(F.lit(1)).alias("n"))
    rule = F.ceil((F.col("top") - F.col("lo")) / (2 * F.col("iqr") * F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3))))
    nb = F.lit(max(2, bins)) if bins else F.when(F.col("iqr") <= 0, 5).otherwise(F.greatest(F.least(rule, F.lit(50)), F.lit(2)))
    width = (F.col("top") + 1e-12 - F.col("lo")) / F.col("nb")
    return df.join(ends.withColumn("nb", nb), "dim").select("id", "dim", F.least(F.floor((F.col("x") - F.col("lo")) / width), F.col("nb") - 1).alias("b"))


def mutual_information(df: DataFrame, bins: int | None = 10, *, normalize: str | None = None) -> DataFrame:
    """``d1, d2, mi`` of each pair of dimensions: over equally full bins, or without ``bins`` over those of ``width_bins``.

    In nats, or over the root of the product of the entropies (``sqrt``) or the lesser of them (``min``).
    """
    if normalize not in (None, "sqrt", "min"):
        raise ValueError(f"unknown normalisation {normalize!r}; there are sqrt, min")
    b = df.select("id", "dim", (F.ntile(bins).over(Window.partitionBy("dim").orderBy("x", "id")) - 1).alias("b")) if bins else width_bins(df)
    two = b.select("id", F.col("dim").alias("d2"), F.col("b").alias("q"))
    j = b.select("id", F.col("dim").alias("d1"), F.col("b").alias("p")).join(two, "id").where("d1 < d2").groupBy("d1", "d2", "p", "q").agg(F.count(F.lit(1)).cast("double").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy("d1", "d2", *c))
    share = lambda top, low: F.sum(F.col("n") / F.col("s") * F.log(top / low))
    full = j.withColumn("s", over()).withColumn("r", over("p")).withColumn("c", over("q")).groupBy("d1", "d2")
    mi = full.agg(share(F.col("n") * F.col("s"), F.col("r") * F.col("c")).alias("mi"), share(F.col("s"), F.col("r")).alias("h1"), share(F.col("s"), F.col("c")).alias("h2"))
    if normalize is None:
        return mi.drop("h1", "h2")
    below = F.sqrt(F.greatest(F.col("h1") * F.col("h2"), F.lit(1e-12))) if normalize == "sqrt" else F.greatest(F.least("h1", "h2"), F.lit(1e-12))
    return mi.select("d1", "d2", F.greatest(F.least(F.col("mi") / below, F.lit(1.0)), F.lit(0.0)).alias("mi"))


def information_of_pairs(df: DataFrame, bins: int) -> DataFrame:
    """``d1, d2, mi`` in nats of each pair of dimensions of ``id, dim, x``, over equally full bins with ties by ``id``.

    An item's bins travel as one array.  A task counts pairs of bins for some
    items at once and sends the counts, ``bins`` squared numbers a pair of
    dimensions however many items there are.
    """
    place = F.row_number().over(Window.orderBy("dim")) - 1
    dims = df.select("dim").distinct().withColumn("k", place.cast("int"))
    names = [r.dim for r in dims.orderBy("k").collect()]
    if not names:
        return df.sparkSession.createDataFrame([], "d1 long, d2 long, mi double")
    b = df.select("id", "dim", (F.ntile(bins).over(Window.partitionBy("dim").orderBy("x", "id")) - 1).alias("b"))
    lists = b.join(F.broadcast(dims), "dim").groupBy("id").agg(F.collect_list(F.struct("k", "b")).alias("r")).select(F.col("r.k").alias("k"), F.col("r.b").alias("b"))
    many = len(names)
    if many * bins > 8192:
        raise ValueError("more pairs of bins than a task holds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint = np.zeros((many * bins,) * 2, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                k, own = (c.slice(at, 1024) for c in batch.columns)
                row = np.repeat(np.arange(len(k)), np.asarray(k.value_lengths()))
                held = np.zeros((len(k), many * bins), np.float32)
                np.add.at(held, (row, k.flatten().to_numpy() * bins + own.flatten().to_numpy()), 1)  # an id twice counts as in a join
                joint += (held.T @ held).astype(np.int64)
        p, q = np.nonzero(joint)
        later = p // bins < q // bins
        p, q = p[later], q[later]
        yield pa.RecordBatch.from_pydict({"d1": p // bins, "d2": q // bins, "p": p % bins, "q": q % bins, "n": joint[p, q]})

    n = lists.mapInArrow(run, "d1 long, d2 long, p long, q long, n long").groupBy("d1", "d2", "p", "q").agg(F.sum("n").cast("double").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy("d1", "d2", *c))
    full = n.withColumn("s", over()).withColumn("r", over("p")).withColumn("c", over("q"))
    mi = full.groupBy("d1", "d2").agg(F.sum(F.col("n") / F.col("s") * F.log(F.col("n") * F.col("s") / (F.col("r") * F.col("c")))).alias("mi"))
    name = F.lit(names)
    return mi.select(F.get(name, F.col("d1").cast("int")).alias("d1"), F.get(name, F.col("d2").cast("int")).alias("d2"), "mi")


def tfidf(docs: DataFrame, key: str, text: str, *, features: int, token: str, least_df: int = 2, most_df: float = 0.95) -> DataFrame:
    """``key, word, x``: smooth inverse document frequency, rows of unit length, the most frequent words only."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(0))).alias("word"))
    tf = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    n = docs.count()
    kept = df.where((F.col("df") >= least_df) & (F.col("df") <= most_df * n)).orderBy(F.desc("total"), "word").limit(features)
    idf = kept.select("word", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    x = tf.join(F.broadcast(idf), "word").withColumn("x", F.col("tf") * F.col("idf"))
    return x.select(key, "word", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))).alias("x"))
