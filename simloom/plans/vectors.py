"""Transforms and kernels over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions.hashing import r6
from simloom.operators import kernels as K
from simloom.operators import pairstats
from simloom.operators import transforms as T
from simloom.plans.registry import CELLS_SQL, V_SQL, cells, query, r_sql, vectors


def _cells_out(df):
    return df.select("id", "dim", r6(F.col("x")).alias("x"))


def _transform(name, transform, axis, sql):
    @query(name, f"with {CELLS_SQL} select id, dim, {r_sql(sql)} as x from c")
    def run(spark, d):
        return _cells_out(T.apply_transform(cells(spark, d), transform, axis))


_sd = "stddev_pop(x) over (partition by dim)"
_transform("v2_center", "center", 0, "x - avg(x) over (partition by dim)")
_transform("v3_standardize", "standardize", 0, f"(x - avg(x) over (partition by dim)) / case when {_sd} = 0 then 1 else {_sd} end")
_transform("v4_normalize_l2", "normalize_l2", 1, "x / (sqrt(sum(x * x) over (partition by id)) + 1e-8)")
_transform("v4_normalize_l1", "normalize_l1", 0, "x / (sum(abs(x)) over (partition by dim) + 1e-8)")
_transform("v5_positive_shift", "positive_shift", 0, "x - (select min(x) from c)")
_transform("v6_softmax", "softmax", 1, "exp(x) / sum(exp(x)) over (partition by id)")
_transform("v6_log_softmax", "log_softmax", 1, "ln(exp(x) / sum(exp(x)) over (partition by id))")
_transform("v6_relu", "relu", 0, "greatest(x, 0)")


@query("v1_apply_transform", f"with {CELLS_SQL}, y as (select id, dim, x - avg(x) over (partition by dim) as y from c) select id, dim, {r_sql('greatest(y / (sqrt(sum(y * y) over (partition by dim)) + 1e-8), 0)')} as x from y")
def v1(spark, d):
    return _cells_out(T.apply_transform(cells(spark, d), ["center", "normalize_l2", "relu"], 0))


@query("v6_log", f"with {CELLS_SQL} select id, dim, {r_sql('ln(abs(x) + 1)')} as x from c")
def v6_log(spark, d):
    return _cells_out(T.log(cells(spark, d).withColumn("x", F.abs("x") + 1)))


@query("v7_one_hot", f"with {V_SQL}, k as (select distinct label as c from v) select id, c, (label = c)::int::double as x from v, k")
def v7(spark, d):
    v = vectors(spark, d)
    return T.one_hot(v.select("id", "label"), "label", v.select(F.col("label").alias("c")).distinct()).select("id", "c", "x")


@query("v8_log_likelihood", f"with {CELLS_SQL}, m as (select dim, avg(x) as m, stddev_pop(x) as s from c group by 1) select id, dim, {r_sql('-0.5 * ((x - m) / s) * ((x - m) / s) - ln(s) - 0.5 * ln(2 * pi())')} as ll, {r_sql('exp(-0.5 * ((x - m) / s) * ((x - m) / s) - ln(s) - 0.5 * ln(2 * pi()))')} as pdf from c join m using (dim)")
def v8(spark, d):
    c = cells(spark, d)
    m = c.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    both = c.join(F.broadcast(m), "dim")
    return both.select("id", "dim", r6(T.log_likelihood(F.col("x"), F.col("m"), F.col("s"))).alias("ll"), r6(T.normal_pdf(F.col("x"), F.col("m"), F.col("s"))).alias("pdf"))


@query("v9_fisher_average", f"with {CELLS_SQL}, r as (select a.dim as dim, b.dim as other, corr(a.x, b.x) as r from c a join c b on a.id = b.id group by 1, 2) select dim, {r_sql('tanh(avg(atanh(least(greatest(r, 1e-7 - 1), 1 - 1e-7))))')} as r, count(*) as n from r where dim <> other group by 1")
def v9(spark, d):
    from simloom.operators.correlation import column_correlations

    r = column_correlations(cells(spark, d)).where("a != b")
    return r.groupBy(F.col("a").alias("dim")).agg(r6(T.average_r(F.col("r"))).alias("r"), F.count(F.lit(1)).alias("n"))


@query("v10_spearman_brown", f"with {CELLS_SQL}, r as (select a.dim, corr(a.x, b.x) as r from c a join c b on a.id = b.id and b.dim = a.dim + 32 group by 1) select dim, {r_sql('2 * r / (1 + r)')} as sb from r")
def v10(spark, d):
    c = cells(spark, d)
    r = c.join(c.select("id", (F.col("dim") - 32).alias("dim"), F.col("x").alias("y")), ["id", "dim"]).groupBy("dim").agg(F.corr("x", "y").alias("r"))
    return r.select("dim", r6(T.spearman_brown(F.col("r"), 2)).alias("sb"))


@query("v11_rss_aic", "select o_orderpriority as g, round(sum((o_totalprice - p) * (o_totalprice - p)) / 1e6, 2) as rss_m, round(count(*) * ln(sum((o_totalprice - p) * (o_totalprice - p)) / count(*)) + 2 * (1 + 1), 4) as aic from (select *, avg(o_totalprice) over (partition by o_orderpriority) as p from orders) group by 1")
def v11(spark, d):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("p", F.avg("o_totalprice").over(Window.partitionBy("o_orderpriority")))
    y, p = F.col("o_totalprice"), F.col("p")
    return o.groupBy(F.col("o_orderpriority").alias("g")).agg(F.round(T.rss(y, p) / 1e6, 2).alias("rss_m"), F.round(T.aic(y, p, 1), 4).alias("aic"))


@query("v12_explained", "select l_returnflag as g, " + r_sql("1 - sqrt(sum((y - p) * (y - p))) / sqrt(sum(y * y))") + " as evar, " + r_sql("1 - var_pop(y - p) / var_pop(y)") + " as ev, " + r_sql("2 * avg(l_tax) * avg(l_discount) / (avg(l_tax) + avg(l_discount))") + " as hm from (select *, l_extendedprice as y, l_quantity * 1500.0 as p from lineitem) group by 1")
def v12(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("y", F.col("l_extendedprice")).withColumn("p", F.col("l_quantity") * 1500.0)
    y, p = F.col("y"), F.col("p")
    return li.groupBy(F.col("l_returnflag").alias("g")).agg(r6(T.explained(y, p)).alias("evar"), r6(T.explained_variance(y, p)).alias("ev"), r6(T.harmonic_mean(F.avg("l_tax"), F.avg("l_discount"))).alias("hm"))


@query("v13_sparseness", f"with {CELLS_SQL}, w as (select id, dim, greatest(x, 0) as x from c), m as (select avg(x) as m from w) select {r_sql('avg((x < m)::int)')} as below_mean, {r_sql('avg((x = 0)::int)')} as zeros, (select {r_sql('avg(p)')} from (select max(x) / (sum(x) + 1e-10) as p from w group by id)) as purity from w, m")
def v13(spark, d):
    out = T.sparseness(T.relu(cells(spark, d)))
    return out.select(*(r6(F.col(c)).alias(c) for c in ("below_mean", "zeros", "purity")))


@query("v13_orthogonality", f"with {CELLS_SQL}, g as (select a.dim as a, b.dim as b, sum(a.x * b.x) as g from c a join c b on a.id = b.id group by 1, 2) select round(sqrt(sum((g - (a = b)::int) * (g - (a = b)::int))) / sqrt(sum((a = b)::int)), 4) as orthogonality from g")
def v13b(spark, d):
    return T.orthogonality(cells(spark, d)).select(F.round("orthogonality", 4).alias("orthogonality"))


_COS = "case when na * nb > 0 then greatest(least(list_dot_product(a.v, b.v) / (na * nb), 1), -1) else 0 end"
_PAIR = "select a.id as i, b.id as j, {s} as s from n a join n b on a.id < b.id"


def _norms(v="v"):
    return f"n as (select id, label, {v} as v, sqrt(list_dot_product({v}, {v})) as norm from v)"


def _pair_sql(s, v="v"):
    s = s.replace("na", "a.norm").replace("nb", "b.norm")
    return f"with {V_SQL}, {_norms(v)} select i, j, {r_sql('s')} as s from ({_PAIR.format(s=s)})"


_CENTRED = "list_transform(v, lambda t: t - list_avg(v))"
_SQL = {
    "pearson": _pair_sql(_COS, _CENTRED),
    "cosine": _pair_sql(_COS),
    "euclidean": _pair_sql("1 / (1 + list_distance(a.v, b.v))"),
    "manhattan": _pair_sql("1 / (1 + list_sum(list_transform(list_zip(a.v, b.v), lambda t: abs(t[1] - t[2]))))"),
    "dot": _pair_sql("list_dot_product(a.v, b.v)"),
}
_NAMES = {"pearson": "k1", "cosine": "k2", "euclidean": "k3", "manhattan": "k4", "dot": "k5"}
for _metric, _sql in _SQL.items():

    @query(f"{_NAMES[_metric]}_{_metric}_similarity", _sql)
    def _pairs(spark, d, metric=_metric):
        return K.pairs(vectors(spark, d).select("id", "v"), metric).select("i", "j", r6(F.col("s")).alias("s"))


_DIST = f"with {V_SQL}, d as (select a.id as i, b.id as j, list_distance(a.v, b.v) as s from v a join v b on a.id < b.id)"


@query("k3_euclidean_distance", f"{_DIST} select i, j, {r_sql('s')} as s from d")
def k3(spark, d):
    return K.pairs(vectors(spark, d).select("id", "v"), "euclidean", kind="distance").select("i", "j", r6(F.col("s")).alias("s"))


@query("k2_cosine_distance", _pair_sql(f"1 - ({_COS})"))
def k2(spark, d):
    return K.pairs(vectors(spark, d).select("id", "v"), "cosine", kind="distance").select("i", "j", r6(F.col("s")).alias("s"))


@query("k0_compute_rdm", _pair_sql(f"1 - ({_COS})", _CENTRED))
def k0(spark, d):
    return K.pairs(vectors(spark, d).select("id", "v"), "pearson", kind="distance").select("i", "j", r6(F.col("s")).alias("s"))


@query("k6_gaussian_kernel", f"{_DIST}, e as (select s from d union all select s from d union all select 0.0 from v), g as (select quantile_cont(s, 0.5) as sigma from e) select i, j, {r_sql('exp(-s * s / (2 * sigma * sigma))')} as s from d, g")
def k6(spark, d):
    return K.pairs(vectors(spark, d).select("id", "v"), "gaussian_kernel").select("i", "j", r6(F.col("s")).alias("s"))


@query("k7_rbf_median_bandwidth", f"{_DIST}, g as (select quantile_cont(s, 0.5) as sigma from d) select i, j, {r_sql('exp(-s * s / (2 * sigma * sigma))')} as s, {r_sql('sigma')} as sigma from d, g")
def k7(spark, d):
    v = vectors(spark, d).select("id", "v")
    return K.rbf(K.pairs(v, "euclidean", kind="distance"), middle=pairstats.quantiles_of(v, [0.5])[0]).select("i", "j", r6(F.col("s")).alias("s"), r6(F.col("sigma")).alias("sigma"))


@query("k8_reexponentiate", f"{_DIST}, g as (select quantile_cont(s, 0.5) as sigma from d), k as (select i, j, exp(-s * s / (2 * sigma * sigma)) as s from d, g) select alpha, {r_sql('avg(p)')} as mean, {r_sql('min(p)')} as low, {r_sql('max(p)')} as high from (select alpha, exp(greatest(ln(s) / (alpha * alpha), -50)) as p from k, (values (0.5::double), (1.0::double), (2.0::double)) as a(alpha)) group by 1")
def k8(spark, d):
    v, alphas = vectors(spark, d).select("id", "v"), [0.5, 1.0, 2.0]
    sigma = pairstats.quantiles_of(v, [0.5])[0]
    if sigma and pairstats.plain(v):
        t = pairstats.kernel_tallies(v, sigma, alphas).groupBy("alpha")
        return t.agg(r6(F.sum("total") / F.sum("n")).alias("mean"), r6(F.min("least")).alias("low"), r6(F.max("most")).alias("high"))
    k = K.rbf(K.values(v, "euclidean", kind="distance"), middle=sigma)
    return K.reexponentiate(k, alphas).groupBy("alpha").agg(*(r6(f("s")).alias(n) for f, n in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"))))


def _group(fisher, metric):
    """Four subjects with 16 dimensions each."""

    def run(spark, d):
        subjects = vectors(spark, d).select("id", F.slice("v", 1, 64).alias("v"))
        return K.pairs(subjects, K.group(metric, 4, fisher=fisher)).select("i", "j", r6(F.col("s")).alias("s"))

    return run


def _group_sql(agg, v):
    return f"with {V_SQL}, q as (select id, k, v[k * 16 + 1 : k * 16 + 16] as v from v, range(4) as r(k)), n as (select id, k, {v} as v from q), p as (select a.id as i, b.id as j, list_cosine_similarity(a.v, b.v) as s from n a join n b on a.k = b.k and a.id < b.id) select i, j, {r_sql(agg)} as s from p group by 1, 2"


query("k10_group_rsm_cosine", _group_sql("avg(s)", "v"))(_group(False, "cosine"))
query("k10_group_rsm_pearson", _group_sql("tanh(avg(atanh(least(greatest(s, 1e-6 - 1), 1 - 1e-6))))", _CENTRED))(_group(True, "pearson"))


@query("k13_listed_cosine", f"with {V_SQL}, l as (select o_orderkey, o_custkey::bigint as a, (o_orderkey % 500)::bigint as b from orders where o_custkey <> o_orderkey % 500) select o_orderkey, a, b, {r_sql('list_cosine_similarity(x.v, y.v)')} as s from l join v x on x.id = a join v y on y.id = b")
def k13(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("long").alias("a"), (F.col("o_orderkey") % 500).cast("long").alias("b")).where("a != b")
    return K.listed_cosine(vectors(spark, d).select("id", "v"), o).select("o_orderkey", "a", "b", r6(F.col("s")).alias("s"))


@query("k9_softmax_rsm")
def k9(spark, d):
    return K.softmax_triplet_similarity(vectors(spark, d).select("id", "v")).select("i", "j", r6(F.col("s")).alias("s"))


@query("v15_median_split", f"{_DIST}, m as (select quantile_cont(s, 0.5) as t from d) select i, j, {r_sql('greatest(s - t, 0)')} as pos, {r_sql('greatest(t - s, 0)')} as neg, s >= t as mask from d, m")
def v15(spark, d):
    v = vectors(spark, d).select("id", "v")
    return T.split_at(K.pairs(v, "euclidean", kind="distance"), middle=pairstats.quantiles_of(v, [0.5])[0]).select("i", "j", r6(F.col("pos")).alias("pos"), r6(F.col("neg")).alias("neg"), "mask")


@query("k14_pair_percentile", f"{_DIST} select {r_sql('quantile_cont(s, 0.98)')} as p98, {r_sql('quantile_cont(s, 0.02)')} as p02, count(*) as n from d")
def k14(spark, d):
    v = vectors(spark, d).select("id", "v")
    p98, p02 = pairstats.quantiles_of(v, [0.98, 0.02])
    n = F.col("count")
    pairs = (F.sum(n) * F.sum(n) - F.sum(n * n)) / 2  # of different ids
    return v.groupBy("id").count().agg(r6(F.lit(p98)).alias("p98"), r6(F.lit(p02)).alias("p02"), F.coalesce(pairs, F.lit(0)).cast("long").alias("n"))
