"""All registered queries of the library, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions.hashing import r6
from simloom.operators import transforms
from simloom.operators.nearest import nearest
from simloom.plans import curves as _curves  # noqa: F401  registers its queries
from simloom.plans import further as _further  # noqa: F401
from simloom.plans import inputs as _inputs  # noqa: F401
from simloom.plans import models as _models  # noqa: F401
from simloom.plans import relations as _relations  # noqa: F401
from simloom.plans import vectors as _vectors  # noqa: F401
from simloom.plans.registry import QUERIES, SQL, cells, query, table
from simloom.scratch import Scratch

__all__ = ["QUERIES", "SQL", "flagship"]


def neighbours(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Nearest items of each item by Pearson similarity of standardised features, and whether labels agree."""
    standard = transforms.standardize(cells(spark, sf_dir))
    items = standard.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r.x).alias("v"))
    items = Scratch(spark, "neighbours").table(items, "standard")  # read a few times
    top = nearest(items, k)
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.col("label").alias("label"))
    named = top.join(label, "i").join(label.select(F.col("i").alias("j"), F.col("label").alias("other")), "j")
    return named.select("i", F.col("rank").cast("long").alias("rank"), "j", r6(F.col("s")).alias("s"), (F.col("label") == F.col("other")).alias("same_label"))


_SQL = """
with c as (select vec_id::bigint as id, label, unnest(range(1, 65)) as dim, unnest(embedding)::double as x from embeddings),
z as (select id, label, dim, (x - avg(x) over (partition by dim)) / stddev_pop(x) over (partition by dim) as x from c),
v as (select id, label, list(x order by dim) as v from z group by 1, 2),
n as (select id, label, list_transform(v, lambda t: t - list_avg(v)) as v from v),
p as (select a.id as i, b.id as j, list_cosine_similarity(a.v, b.v) as s, a.label = b.label as same_label from n a join n b on a.id <> b.id),
r as (select *, row_number() over (partition by i order by s desc, j) as rank from p)
select i, rank, j, round(s, 6) + 0.0 as s, same_label from r where rank <= 5"""


@query("flagship_neighbours", _SQL)
def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir)


def flagship(spark: SparkSession) -> DataFrame:
    return neighbours(spark, "/root/testdata/sf0.001")
