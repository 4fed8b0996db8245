"""Where queries and their SQL are put down side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the DuckDB query with the same rows."""

    def put(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, v, label`` of the embeddings, in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, dim, x`` of the embeddings; dim counts from 1."""
    return vectors(spark, sf_dir).select("id", F.posexplode("v").alias("p", "x")).select("id", (F.col("p") + 1).cast("long").alias("dim"), "x")


def u_sql(key: str) -> str:
    """The hash uniform of a string expression, in DuckDB."""
    return f"(('0x' || substr(md5({key}), 1, 8))::bigint / 4294967296.0)"


def r_sql(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


V_SQL = "v as (select vec_id::bigint as id, embedding::double[] as v, label::bigint as label from embeddings)"
CELLS_SQL = f"{V_SQL}, c as (select id, unnest(range(1, len(v) + 1))::bigint as dim, unnest(v) as x from v)"
