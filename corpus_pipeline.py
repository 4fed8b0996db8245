"""From raw documents to packed sequences, in stages that each keep a written table.

A stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.decontam import leaks
from simloom.llm.minhash import near_duplicates
from simloom.llm.packing import pack
from simloom.llm.queries import tokenizer_path
from simloom.llm.secrets import redact
from simloom.llm.toxicity import toxicity
from simloom.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject.

    A null or empty text has no marks and stays, as does a null id; rows that
    repeat an id go together, if one of them is rejected.  No rows give no rows.
    """
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.join(scored.where("predicted = 1 and doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id, and one row of each document.

    Of rows that repeat an id the first in the order of their columns stays.
    Null and empty texts are alike to nothing and stay.  A null id can't be
    named as another's copy; of rows without one that have equal columns one
    stays.  No rows give no rows.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    if again.isEmpty():
        return left
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    one = left.join(again, same, "left_semi").withColumn("of", F.when(F.col("doc_id").isNull(), F.xxhash64(*COLUMNS)))
    row = F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("row")
    return left.join(again, same, "left_anti").unionByName(one.groupBy("doc_id", "of").agg(row).select("doc_id", "row.*").select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts and null ids stay; rows that repeat an id go together.
    No benchmark, no change; no rows give no rows.
    """
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and ``n_chars`` counted anew where one was.

    Null and empty texts stay as they are; repeated rows and ids are each
    judged by their own text.  No rows give no rows.
    """
    out = redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("redacted"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids.

    A null or empty text is a piece of its end id alone; repeated rows are
    documents of their own.  No rows give no pieces.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]
#: The stages use learned models, signatures and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k > 1:
            scratch.drop(f"{k - 2}_{STAGES[k - 2][0]}")
    return docs
