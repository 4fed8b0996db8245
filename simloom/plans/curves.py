"""Curve, aggregation and window queries over lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions.hashing import r6
from simloom.operators import correlation as R
from simloom.operators import curves as C
from simloom.operators import kernels as K
from simloom.operators import pairstats
from simloom.plans.registry import CELLS_SQL, V_SQL, cells, query, r_sql, table, u_sql, vectors
from simloom.scratch import Scratch

_CV = "cv as (select l_quantity::bigint as rank, l_linenumber::bigint as rep, (l_suppkey % 5)::bigint as fold, avg(l_tax + abs(l_quantity - 20) / 100) as val_mse from lineitem group by 1, 2, 3)"
_ST = f"{_CV}, st as (select rank, avg(val_mse) as mean, stddev_samp(val_mse) as std, count(*) as n, stddev_samp(val_mse) / sqrt(greatest(count(*), 1)) as sem from cv group by 1)"


def curve(spark, d):
    li = table(spark, d, "lineitem")
    keys = [F.col("l_quantity").cast("long").alias("rank"), F.col("l_linenumber").cast("long").alias("rep"), (F.col("l_suppkey") % 5).alias("fold")]
    return li.groupBy(*keys).agg(F.avg(F.col("l_tax") + F.abs(F.col("l_quantity") - 20) / 100).alias("val_mse"))


def _r(df, *names):
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" and (not names or c in names) else F.col(c) for c, t in df.dtypes))


@query("a1_rank_stats", f"with {_ST} select rank, {r_sql('mean')} as mean, {r_sql('std')} as std, n, {r_sql('sem')} as sem from st")
def a1(spark, d):
    return _r(C.rank_stats(curve(spark, d)))


@query("a2_select_rank", f"with {_ST}, b as (select min_by(rank, (mean, rank)) as argmin_rank, min((mean, rank, sem)) as b, min(rank) as low, max(rank) as high from st) select argmin_rank, (select min(rank) from st, b where mean <= b.b[1] + b.b[3]) as one_se_rank, case when argmin_rank = low then 'first' when argmin_rank = high then 'last' else 'interior' end as edge from b")
def a2(spark, d):
    return C.selected(C.rank_stats(curve(spark, d)))


@query("a3_complete_ranks", f"with {_CV} select rank, count(*) as n from cv group by 1 having count(*) >= 33")
def a3(spark, d):
    return C.complete_ranks(curve(spark, d), 33)


@query("a3_scores_matrix", f"with {_CV} select rank, rep, {', '.join(f'{r_sql(f'max(val_mse) filter (fold = {k})')} as f{k}' for k in range(5))} from cv group by 1, 2")
def a3m(spark, d):
    wide = curve(spark, d).groupBy("rank", "rep").pivot("fold", [0, 1, 2, 3, 4]).agg(F.max("val_mse"))
    return wide.select("rank", "rep", *(r6(F.col(str(k))).alias(f"f{k}") for k in range(5)))


@query("a3_merge_later_file", f"with {_CV}, m as (select rank, max(rep) as rep from cv group by 1) select rank, rep, fold, {r_sql('val_mse')} as val_mse from cv join m using (rank, rep)")
def a3f(spark, d):
    return _r(C.merged(curve(spark, d), "rep")).select("rank", "rep", "fold", "val_mse")


@query("a3_relative_curve", f"with {_ST} select rank, {r_sql('mean / (select min(mean) from st)')} as relative, {r_sql('coalesce(std, sem * sqrt(n))')} as spread from st")
def a3r(spark, d):
    return _r(C.relative(C.rank_stats(curve(spark, d))))


@query("a4_power_pivot", f"select o_orderpriority as snr, {', '.join(f'{r_sql(f'''avg((o_totalprice > 150000)::int) filter (o_orderstatus = '{s}')''')} as {s.lower()}' for s in 'FOP')} from orders group by 1")
def a4(spark, d):
    hit = (F.col("o_totalprice") > 150000).cast("double")
    wide = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("snr")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg(hit))
    return wide.select("snr", *(r6(F.col(s)).alias(s.lower()) for s in "FOP"))


@query("a5_power_by_quantile", "with e as (select quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) as e from orders), b as (select o_totalprice as x, (o_orderpriority < '3')::int as hit, len(list_filter(e, lambda t: o_totalprice > t))::bigint as bin from orders, e) select bin, count(*) as n, " + r_sql("avg(hit)") + " as power, " + r_sql("1.96 * stddev_samp(hit) / sqrt(count(*))") + " as half from b group by 1")
def a5(spark, d):
    o = table(spark, d, "orders").withColumn("hit", (F.col("o_orderpriority") < "3").cast("double"))
    return C.summary(C.quantile_bin(o, "o_totalprice", 5), ["bin"], "hit").select("bin", "n", r6(F.col("mean")).alias("power"), r6(F.col("half")).alias("half"))


@query("a6_group_summary", "select event_type, " + ", ".join(f"{r_sql(x)} as {n}" for n, x in (("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("sem", "stddev_samp(value) / sqrt(count(value))"), ("median", "quantile_cont(value, 0.5)"), ("half", "1.96 * stddev_samp(value) / sqrt(count(value))"))) + ", count(value) as n from events group by 1")
def a6(spark, d):
    return _r(C.summary(table(spark, d, "events"), ["event_type"], "value"))


@query("a7_tuning_grid", "select l_returnflag, l_linestatus, l_linenumber::bigint as k, " + r_sql("avg(l_discount)") + " as mean, " + r_sql("stddev_samp(l_discount)") + " as std, max(l_discount) as best from lineitem group by 1, 2, 3 order by 4 desc, 3, 6 desc")
def a7(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("long").alias("k"))
    return g.agg(r6(F.avg("l_discount")).alias("mean"), r6(F.stddev_samp("l_discount")).alias("std"), F.max("l_discount").alias("best")).orderBy(F.desc("mean"), "k", F.desc("best"))


@query("a8_count_above", "select l_shipdate::date::varchar as day, count(*) filter (l_discount > 0.05) as above, count(*) as n, (count(*) * (count(*) - 1) * (count(*) - 2) // 6)::bigint as triplets from lineitem group by 1")
def a8(spark, d):
    n = F.count(F.lit(1))
    g = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day"))
    return g.agg(F.count_if(F.col("l_discount") > 0.05).alias("above"), n.alias("n"), F.floor(n * (n - 1) * (n - 2) / 6).alias("triplets"))


@query("a9_stimulus_average", "select user_id, event_type, " + r_sql("avg(value)") + " as x, count(*) as n from events group by 1, 2")
def a9(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(r6(F.avg("value")).alias("x"), F.count(F.lit(1)).alias("n"))


@query("a11_distinct_counts", "select event_type, count(distinct user_id) as users, count(distinct props) as props from events group by 1")
def a11(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"))


_KERNEL = f"{V_SQL}, d as (select a.id as i, b.id as j, list_distance(a.v, b.v) as s from v a join v b on a.id < b.id), g as (select quantile_cont(s, 0.5) as sigma from d), k as (select i, j, exp(-s * s / (2 * sigma * sigma)) as s from d, g)"


def _kernel(spark, d, alphas):
    """Tallies of the kernel in 100 bins; or None, and the kernel itself, where numbers aren't plain."""
    v = vectors(spark, d).select("id", "v")
    sigma = pairstats.quantiles_of(v, [0.5])[0]
    if sigma and pairstats.plain(v):
        return pairstats.kernel_tallies(v, sigma, alphas, 100), None
    return None, K.rbf(K.values(v, "euclidean", kind="distance"), middle=sigma).select("s")


def _counts(tallies):
    return tallies.groupBy("alpha", "b").agg(F.sum("n").alias("n")).where("n > 0")


@query("a12_histogram_entropy", f"with {_KERNEL}, b as (select least(floor(s * 100), 99) as b, count(*)::double as n from k group by 1) select {r_sql('-sum(n / t * log2(n / t))')} as bits, {r_sql('-sum(n / t * ln(n / t))')} as nats from b, (select sum(n) as t from b)")
def a12(spark, d):
    t, k = _kernel(spark, d, [1.0])
    if t is None:
        h = C.histogram_entropy(k.withColumn("all", F.lit(1)), "s", ["all"], 100, bits=False)
    else:
        h = C.entropy_of_counts(_counts(t), ["alpha"], bits=False)
    h = h.select(F.col("entropy").alias("nats"))
    return h.select(r6(F.col("nats") / F.log(F.lit(2.0))).alias("bits"), r6(F.col("nats")).alias("nats"))


_ALPHAS = [0.25, 0.5, 1.0, 2.0, 4.0]


@query("a13_sigma_sweep", f"with {_KERNEL}, a as (select unnest({_ALPHAS}::double[]) as alpha), p as (select alpha, exp(greatest(ln(s) / (alpha * alpha), -50)) as s from k, a), b as (select alpha, least(floor(s * 100), 99) as b, count(*)::double as n from p group by 1, 2), h as (select alpha, -sum(n / t * log2(n / t)) as h from b join (select alpha, sum(n) as t from b group by 1) using (alpha) group by 1), m as (select alpha, avg(s) as mean, avg((s > 0.95)::int) as high, avg((s < 0.05)::int) as low from p group by 1) select alpha, {r_sql('h')} as entropy, {r_sql('mean')} as mean, {r_sql('high')} as high, {r_sql('low')} as low, alpha = (select max_by(alpha, h) from h) as best from h join m using (alpha)")
def a13(spark, d):
    from pyspark.sql import Window

    t, k = _kernel(spark, d, _ALPHAS)
    if t is None:
        p = K.reexponentiate(k, _ALPHAS)
        m = p.groupBy("alpha").agg(F.avg("s").alias("mean"), F.avg((F.col("s") > 0.95).cast("double")).alias("high"), F.avg((F.col("s") < 0.05).cast("double")).alias("low"))
        out = C.histogram_entropy(p, "s", ["alpha"], 100).join(m, "alpha")
    else:
        t = t.groupBy("alpha", "b").agg(*(F.sum(c).alias(c) for c in ("n", "total", "high", "low")))
        t = Scratch(spark, "sweep").table(t, "tallies")  # read twice
        m = t.groupBy("alpha").agg(*((F.sum(c) / F.sum("n")).alias(to) for c, to in (("total", "mean"), ("high", "high"), ("low", "low"))))
        out = C.entropy_of_counts(t.where("n > 0"), ["alpha"]).join(m, "alpha")
    return _r(out.withColumn("best", F.col("entropy") == F.max("entropy").over(Window.partitionBy())), "entropy", "mean", "high", "low").select("alpha", "entropy", "mean", "high", "low", "best")


@query("w1_smooth_median", f"with {_ST} select rank, {r_sql('quantile_cont(mean, 0.5) over (order by rank rows between 2 preceding and 2 following)')} as s from st")
def w1(spark, d):
    st = C.rank_stats(curve(spark, d))
    return st.select("rank", r6(C.smooth_median(st, "rank", "mean", 5)).alias("s"))


@query("w2_jump", f"with {_ST} select rank, {r_sql('lead(mean) over (order by rank) - mean')} as jump from st")
def w2(spark, d):
    return C.rank_stats(curve(spark, d)).select("rank", r6(C.jump("rank", "mean")).alias("jump"))


@query("w3_average_rank", "select o_orderkey, o_orderpriority, rank() over (partition by o_orderpriority order by o_orderdate) + (count(*) over (partition by o_orderpriority, o_orderdate) - 1) / 2.0 as rk from orders")
def w3(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", R.average_rank("o_orderdate", ["o_orderpriority"]).alias("rk"))


@query("w4_running_sums", f"with {_ST} select rank, {r_sql('sum(mean * mean) over (order by rank)')} as total, {r_sql('sum(mean * mean) over (order by rank) / row_number() over (order by rank)')} as running, {r_sql('mean * mean')} as increment from st")
def w4(spark, d):
    total, run, step = C.running("rank", "mean")
    return C.rank_stats(curve(spark, d)).select("rank", r6(total).alias("total"), r6(run).alias("running"), r6(step).alias("increment"))


_DAYS = "dd as (select user_id, ts::date::varchar as day, sum(value) as x from events group by 1, 2)"


def _days(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.sum("value").alias("x"))


@query("w5_first_run", f"with {_DAYS}, h as (select *, sum((x >= 40)::int) over w = 2 and count(*) over w = 2 as hit from dd window w as (partition by user_id order by day rows between current row and 1 following)) select user_id, min(day) filter (hit) as first from h group by 1")
def w5(spark, d):
    return C.first_run(_days(spark, d), "day", "x", 40, 2, ["user_id"])


@query("w6_forward_fill", f"with {_DAYS} select user_id, day, {r_sql('coalesce(last_value(case when x > 50 then x end ignore nulls) over (partition by user_id order by day rows unbounded preceding), 0)')} as x from dd")
def w6(spark, d):
    return _days(spark, d).withColumn("y", F.when(F.col("x") > 50, F.col("x"))).select("user_id", "day", r6(C.forward_fill("day", "y", ["user_id"])).alias("x"))


@query("w7_expanding_correlation", f"with {_ST} select rank, {r_sql('corr(mean, std) over (order by rank)')} as r from st qualify row_number() over (order by rank) > 2")
def w7(spark, d):
    return C.expanding_correlation(C.rank_stats(curve(spark, d)), "rank", "mean", "std").where("rank > 2").select("rank", r6(F.col("r")).alias("r"))


@query("w8_top_k_per_dimension", f"with {CELLS_SQL} select dim, id, row_number() over (partition by dim order by x desc, id) as place, {r_sql('x')} as x from c qualify place <= 10")
def w8(spark, d):
    return C.top_k(cells(spark, d), ["dim"], "x", "id", 10).select("dim", "id", F.col("place").cast("long").alias("place"), r6(F.col("x")).alias("x"))


@query("w9_poles", "select * from (select o_orderkey, o_totalprice, 'low' as pole from orders order by o_totalprice, o_orderkey limit 50) union all select * from (select o_orderkey, o_totalprice, 'high' from orders order by o_totalprice desc, o_orderkey limit 50)")
def w9(spark, d):
    return C.poles(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50)


@query("w10_outer_in", f"with {_ST}, k as (select rank, row_number() over (order by rank) as k, count(*) over () as n from st) select rank, (case when 2 * k <= n + 1 then 2 * k - 1 else 2 * (n - k + 1) end)::bigint as place from k")
def w10(spark, d):
    return C.outer_in(C.rank_stats(curve(spark, d)).select("rank"))


@query("w11_bisect", f"with {_ST}, s as (select * from st where rank % 5 = 0), k as (select rank, mean, lag(rank) over (order by rank) as a, lead(rank) over (order by rank) as b from s order by mean, rank limit 1) select ((a + rank) // 2)::bigint as rank from (select * from (select rank, mean, lag(rank) over (order by rank) as a from s) order by mean, rank limit 1) where rank - a > 2 union all select ((rank + b) // 2)::bigint from (select * from (select rank, mean, lead(rank) over (order by rank) as b from s) order by mean, rank limit 1) where b - rank > 2")
def w11(spark, d):
    st = C.rank_stats(curve(spark, d))
    return C.bisect_around(st.join(C.rank_grid(spark, 5, 50, 5), "rank"), 2)


@query("j8_replace_rank", f"with {_CV} select rank, count(*) as n, {r_sql('sum(val_mse)')} as total from (select rank, val_mse from cv where rank not in (select rank from cv where rep = 7) union all select rank, val_mse * 2 from cv where rep = 7) group by 1")
def j8(spark, d):
    c = curve(spark, d)
    new = c.where("rep = 7").withColumn("val_mse", F.col("val_mse") * 2)
    return C.replace_by_key(c, new, ["rank"]).groupBy("rank").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("val_mse")).alias("total"))


_BOOT = f"""bt as (select k::bigint as k, p::double / 20 as p, 1 - (1 - p::double / 20) * (0.2 + (k > 6)::int * 2 + 0.1 * {u_sql("concat_ws('|', 'boot', k, p)")}) as i from range(1, 16) as a(k), range(1, 20) as b(p)),
cut as (select quantile_cont(p, 0.85) as cut from (select distinct p from bt)), kp as (select k, quantile_cont((1 - i) * p / (1 - p), 0.5) as kappa from bt, cut where p >= cut and p < 1 group by 1)"""


def _boot(spark):
    from simloom.functions.hashing import uniform

    g = spark.range(1, 16).withColumnRenamed("id", "k").crossJoin(spark.range(1, 20).withColumnRenamed("id", "q"))
    u = uniform(F.lit("boot"), F.col("k").cast("string"), F.col("q").cast("string"))
    p = F.col("q").cast("double") / 20
    return g.select("k", p.alias("p"), (1 - (1 - p) * (0.2 + (F.col("k") > 6).cast("int") * 2 + 0.1 * u)).alias("i"))


@query("s9_kappa", f"with {_BOOT} select k, {r_sql('kappa')} as kappa from kp")
def s9(spark, d):
    return C.kappa(_boot(spark)).select("k", r6(F.col("kappa")).alias("kappa"))


@query("s10_change_point", f"with {_BOOT}, s as (select k, quantile_cont(kappa, 0.5) over (order by k rows between 2 preceding and 2 following) as s from kp), j as (select k, lead(s) over (order by k) - s as d from s) select max_by(k, (d, -k)) as k, {r_sql('max(d)')} as jump from j where d is not null")
def s10(spark, d):
    return C.change_point(C.kappa(_boot(spark))).select("k", r6(F.col("jump")).alias("jump"))


@query("s7_baseline_corrected", f"with {_BOOT} select k, {r_sql('p')} as p, {r_sql('least(greatest((i - k / 100.0) / (1 - k / 100.0), 0), 1)')} as i from bt")
def s7(spark, d):
    return _boot(spark).select("k", r6(F.col("p")).alias("p"), r6(C.baseline_corrected(F.col("i"), F.col("k").cast("double"), 100)).alias("i"))


@query("s15_knee", f"with {_ST}, v as (select row_number() over (order by mean desc, rank) as k, mean as v from st), s as (select min(k) as k0, max(k) as k1, min(v) as v0, max(v) as v1 from v) select max_by(k, (1 - (k - k0) / (k1 - k0) - (v - v0) / (v1 - v0), -k)) as k from v, s")
def s15(spark, d):
    from pyspark.sql import Window

    st = C.rank_stats(curve(spark, d))
    return C.knee(st.select(F.row_number().over(Window.orderBy(F.desc("mean"), "rank")).cast("long").alias("k"), F.col("mean").alias("v")))


# Correlation and permutation tests.
@query("c2_column_correlations", f"with {CELLS_SQL} select a.dim as a, b.dim as b, {r_sql('corr(a.x, b.x)')} as r from c a join c b using (id) group by 1, 2")
def c2(spark, d):
    return R.column_correlations(cells(spark, d)).select("a", "b", r6(F.col("r")).alias("r"))


@query("c3_spearman", f"with {CELLS_SQL}, k as (select id, dim, rank() over (partition by dim order by x) + (count(*) over (partition by dim, x) - 1) / 2 as x from c) select a.dim as a, b.dim as b, {r_sql('corr(a.x, b.x)')} as r from k a join k b using (id) group by 1, 2")
def c3(spark, d):
    return R.spearman(cells(spark, d)).select("a", "b", r6(F.col("r")).alias("r"))


_TWO = f"{V_SQL}, p as (select a.id as i, b.id as j, list_distance(a.v[1:32], b.v[1:32]) as x, list_distance(a.v[33:64], b.v[33:64]) as y from v a join v b on a.id < b.id)"


def _halves(spark, d):
    return vectors(spark, d).select("id", "label", F.slice("v", 1, 32).alias("v"), F.slice("v", 33, 32).alias("w"))


def _two(spark, d):
    v = vectors(spark, d)
    return tuple(K.pairs(v.select("id", F.slice("v", at, 32).alias("v")), "euclidean", kind="distance") for at in (1, 33))


@query("r1_correlate_rsms", f"with {_TWO} select {r_sql('corr(x, y)')} as r, count(*) as n from p")
def r1(spark, d):
    v = vectors(spark, d).select("id", "v")
    sizes = v.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] == sizes[1] and sizes[0] >= 64 and pairstats.plain(v):
        return pairstats.distances_correlated(v.select("id", F.slice("v", 1, 64).alias("v")), 32).select(r6(F.col("r")).alias("r"), "n")
    return R.correlate_pairs(*_two(spark, d)).select(r6(F.col("r")).alias("r"), "n")


_PERM = """pm as (select id, perm from v, range({n}) as q(perm)), dr as (select *, case when perm > 0 then {u} else 0 end as u from pm),
ka as (select perm, {s} id, row_number() over (partition by perm{b} order by id) as k from dr{j}), kb as (select perm, {s} id as t, row_number() over (partition by perm{b} order by u, id) as k from dr{j}), mp as (select perm, ka.id, kb.t from ka join kb using (perm, {s} k)),
al as (select i, j, x, y from p), rr as (select m.perm, corr(q.x, o.y) as r from al q join mp m on m.id = q.i join mp n on n.perm = m.perm and n.id = q.j join al o on o.i = least(m.t, n.t) and o.j = greatest(m.t, n.t) group by 1)"""


def _perm_sql(n, strata=False):
    u = u_sql("concat_ws('|', 'perm0', perm, id)")
    return _PERM.format(n=n + 1, u=u, s="label, " if strata else "", b=", label" if strata else "", j=" join (select id, label from v) using (id)" if strata else "")


@query("r2_mantel_test", f"with {_TWO}, {_perm_sql(1000)} select {r_sql('(select abs(r) from rr where perm = 0)')} as r, {r_sql('(count(*) filter (abs(r) >= (select abs(r) from rr where perm = 0)) + 1) / (count(*) + 1)')} as p from rr where perm > 0")
def r2(spark, d):
    return R.mantel_of(_halves(spark, d), 1000).select(r6(F.col("r")).alias("r"), r6(F.col("p")).alias("p"))


@query("r4_mantel_within_strata", f"with {_TWO}, {_perm_sql(1000, True)} select {r_sql('(select r from rr where perm = 0)')} as r, {r_sql('(count(*) filter (r >= (select r from rr where perm = 0)) + 1) / (count(*) + 1)')} as p from rr where perm > 0")
def r4(spark, d):
    return R.mantel_of(_halves(spark, d), 1000, two_sided=False, strata="label").select(r6(F.col("r")).alias("r"), r6(F.col("p")).alias("p"))


@query("r7_bh_fdr", f"with k as (select o_orderpriority as g, o_orderkey, {u_sql('''concat_ws('|', 'p', o_orderkey)''')} * (o_totalprice / 600000) as p from orders), r as (select *, row_number() over (partition by g order by p) as rk, count(*) over (partition by g) as m from k), a as (select g, o_orderkey, least(min(p * m / rk) over (partition by g order by rk desc rows unbounded preceding), 1) as a from r) select g, o_orderkey, {r_sql('a')} as p_adjusted, a <= 0.05 as rejected from a")
def r7(spark, d):
    from simloom.functions.hashing import uniform

    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey", (uniform(F.lit("p"), F.col("o_orderkey").cast("string")) * (F.col("o_totalprice") / 600000)).alias("p"))
    return R.bh_adjust(o, "p", ["g"]).select("g", "o_orderkey", r6(F.col("p_adjusted")).alias("p_adjusted"), "rejected")


_HALF = f"""tr as (select user_id as stim, event_type as channel, event_id as rep, value as x from events), dr as (select *, {u_sql("concat_ws('|', split, stim, rep)")} as u from tr, range(10) as s(split)),
hh as (select *, row_number() over (partition by split, stim, channel order by u, rep) as k, count(*) over (partition by split, stim, channel) // 2 as h from dr),
mm as (select split, stim, channel, avg(x) filter (k <= h) as a, avg(x) filter (k > h) as b from hh where k <= 2 * h group by 1, 2, 3),
rr as (select split, channel, least(greatest(corr(a, b), -0.9999), 0.9999) as r from mm group by 1, 2), zz as (select channel, tanh(avg(atanh(r))) as r from rr group by 1)"""


@query("r11_split_half_reliability", f"with {_HALF} select channel, {r_sql('2 * r / (1 + r)')} as reliability from zz")
def r11(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("stim"), F.col("event_type").alias("channel"), F.col("event_id").alias("rep"), F.col("value").alias("x"))
    return R.split_half(t, 10).select("channel", r6(F.col("reliability")).alias("reliability"))


@query("r13_trial_windows", "with e as (select user_id, event_type, value, hour(ts) as h from events) select user_id, event_type, " + r_sql("avg(value) filter (h > 12 and h <= 18) - avg(value) filter (h >= 0 and h < 8)") + " as response, count(*) as n from e group by 1, 2")
def r13(spark, d):
    h = F.hour("ts")
    answer = F.avg(F.when((h > 12) & (h <= 18), F.col("value"))) - F.avg(F.when((h >= 0) & (h < 8), F.col("value")))
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(r6(answer).alias("response"), F.count(F.lit(1)).alias("n"))
