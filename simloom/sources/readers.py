"""Readers, catalogues and writers; everything stays a lazy DataFrame."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = f
        return f

    return put


def load(spark: SparkSession, name: str, *args: object, **more: object) -> DataFrame:
    """A registered source by name."""
    if name not in REGISTRY:
        raise ValueError(f"unknown source {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](spark, *args, **more)


@register("triplets")
def triplets(spark: SparkSession, *paths: str) -> DataFrame:
    """``a, b, c`` of white-space separated text, files one after the other."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(list(paths)).where("trim(value) != ''").select(*(parts[k].cast("long").alias(c) for k, c in enumerate("abc")))


SPLITS = {"train": ("trainset.txt",), "validation": ("validationset.txt",), "train+validation": ("trainset.txt", "validationset.txt")}
SIZES = {"4.7mio": "triplets_47", "14.7mio": "triplets_147"}


@register("triplet_splits")
def triplet_splits(spark: SparkSession, root: str, *, size: str = "4.7mio", split: str = "train") -> DataFrame:
    """``a, b, c`` of a split of a triplet set, or of both splits together."""
    for name, known in ((size, SIZES), (split, SPLITS)):
        if name not in known:
            raise ValueError(f"unknown {name!r}; there are {', '.join(known)}")
    return triplets(spark, *(f"{root}/{SIZES[size]}/{f}" for f in SPLITS[split]))


@register("association_strengths")
def association_strengths(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a tab-separated file of associations, with ``count`` and ``strength`` of all responses, else of the first."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    c = next((c for c in ("R123", "R1") if f"{c}.Strength" in rows.columns), None)
    if c is None:
        raise ValueError("no column of strengths")
    return rows.withColumns({"count": F.col(f"`{c}`").cast("double"), "strength": F.col(f"`{c}.Strength`").cast("double")})


@register("associations")
def associations(spark: SparkSession, path: str, *, all_responses: bool = False) -> DataFrame:
    """``cue, response, count, strength`` of a tab-separated file; rows without a response go."""
    c = "R123" if all_responses else "R1"
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select("cue", "response", F.col(f"`{c}`").cast("double").alias("count"), F.col(f"`{c}.Strength`").cast("double").alias("strength")).na.drop(subset=["response"])


RATINGS = ("arousal", "valence", "dominance", "concreteness", "imageability", "familiarity", "aoa", "size", "gender")


@register("ratings")
def ratings(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path).withColumnRenamed("semsize", "size")
    return rows.select(F.lower("word").alias("word"), *(F.col(c).cast("double").alias(c) for c in RATINGS))


@register("edges")
def edges(spark: SparkSession, path: str, *, source: str = "source", target: str = "target", weight: str | None = None) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(source).alias("src"), F.col(target).alias("dst"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))


@register("vectors")
def vectors(spark: SparkSession, path: str, *, id_col: str = "id", vector_col: str = "v", clamp: bool = False) -> DataFrame:
    """``id, v`` of a parquet table; negative components become 0 if clamped."""
    v = F.col(vector_col).cast("array<double>")
    v = F.transform(v, lambda x: F.greatest(x, F.lit(0.0))) if clamp else v
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), v.alias("v"))


@register("json")
def json_results(spark: SparkSession, *paths: str, schema: str) -> DataFrame:
    """Rows of JSON files; broken files give no rows."""
    return spark.read.option("mode", "DROPMALFORMED").option("multiLine", True).schema(schema).json(list(paths))


@register("matrix")
def matrix(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, s`` with i < j of square ``.npy`` files, one file a task; the lower triangle isn't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                m = np.load(io.BytesIO(content), allow_pickle=False)
                if m.ndim != 2 or m.shape[0] != m.shape[1]:
                    raise ValueError("not a square matrix")
                for i in range(len(m)):
                    j = np.arange(i + 1, len(m))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i)), pa.array(j), pa.array(m[i, i + 1 :].astype(float))], names=["i", "j", "s"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "i long, j long, s double")


@register("word_vectors")
def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``id, v`` of white-space separated text; a first line of two numbers, rows and width, is left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) != ''").select(parts.alias("p")).where(F.size("p") > 2)
    return rows.select(F.col("p")[0].alias("id"), F.slice("p", F.lit(2), F.size("p") - 1).cast("array<double>").alias("v"))


def cached(df_of: Callable[[], DataFrame], spark: SparkSession, path: str, *, force: bool = False) -> DataFrame:
    """The table at ``path``, which is made from ``df_of()`` where it isn't there yet or if forced.

    A write cut short has no success mark and counts as not there.
    """
    context = spark.sparkContext
    mark = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not mark.getFileSystem(context._jsc.hadoopConfiguration()).exists(mark):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def reliable(responses: DataFrame, reliability: DataFrame, least: float | None = 0.3, *, average: bool = False) -> DataFrame:
    """``stim, channel, x`` of channels whose reliability, averaged over splits, is at least ``least``.

    ``reliability`` has ``channel, r``, a row for each split.  If averaged, rows
    of a stimulus become their mean.
    """
    kept = reliability.groupBy("channel").agg(F.avg("r").alias("r"))
    rows = responses.join((kept if least is None else kept.where(F.col("r") >= least)).select("channel"), "channel").select("stim", "channel", "x")
    return rows.groupBy("stim", "channel").agg(F.avg("x").alias("x")) if average else rows


def repetitions(*sessions: DataFrame) -> DataFrame:
    """``stim, rep, channel, x`` of trials ``stim, trial, channel, x``: repetitions counted from 1, those of later sessions after earlier ones."""
    tagged = [t.select("stim", F.lit(k).alias("session"), "trial", "channel", "x") for k, t in enumerate(sessions)]
    rows = reduce(DataFrame.unionByName, tagged)
    order = Window.partitionBy("stim", "channel").orderBy("session", "trial")
    return rows.withColumn("rep", F.row_number().over(order).cast("long")).select("stim", "rep", "channel", "x")


def run_catalogue(paths: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with ``stamp``, ``rank`` and ``name`` read from the parts of a path."""
    found = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit(""))
    return paths.withColumns({"stamp": found(r"(\d{8}_\d{6})"), "rank": found(r"rank_(\d+)").cast("long"), "name": found(r"([^/]+)$")})


def first_of(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each group: first hit, first image of a category, first match."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def first_match(words: DataFrame, listed: DataFrame, renames: dict[str, str]) -> DataFrame:
    """``word, position``: the position of the (renamed) word's first place in ``listed`` (``name, position``)."""
    names = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair)) if renames else F.create_map().cast("map<string,string>")
    named = words.withColumn("name", F.coalesce(names[F.col("word")], F.col("word")))
    return named.join(listed.groupBy("name").agg(F.min("position").alias("position")), "name", "left").select("word", "position")


def with_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column contains the pattern as it stands."""
    return df.where(F.col(column).contains(pattern))


def session_scores(trials: DataFrame) -> DataFrame:
    """``session, unit, stim, x`` to ``stim, unit, x``: population z-scores in each session, then the mean of a stimulus's trials."""
    w = Window.partitionBy("session", "unit")
    sd = F.stddev_pop("x").over(w)
    z = (F.col("x") - F.avg("x").over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
    return trials.withColumn("x", z).groupBy("stim", "unit").agg(F.avg("x").alias("x"))


def write(df: DataFrame, path: str, kind: str = "parquet", *, append: bool = False) -> None:
    """Through Spark's commit protocol: readers see all of a write or nothing."""
    df.write.mode("append" if append else "overwrite").format(kind).save(path)
