"""Queries for the operators that the other modules leave."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from simloom.functions.hashing import r6
from simloom.functions.numeric import correlation_p
from simloom.operators import curves as C
from simloom.operators import extras as X
from simloom.operators import graph as G
from simloom.operators import kernels as K
from simloom.operators import spectral as S
from simloom.plans.curves import _BOOT, _boot
from simloom.plans.models import _HID, _W, N
from simloom.plans.models import K as RANK
from simloom.plans.registry import CELLS_SQL, V_SQL, cells, query, r_sql, table, u_sql, vectors
from simloom.plans.relations import _STEPS, brand_graph
from simloom.scratch import Scratch


@query("v14_is_symmetric", f"with {_STEPS}, b as (select e.w as s, f.w as t from e full join e f on e.src = f.dst and e.dst = f.src) select coalesce(bool_and(coalesce(abs(s - t) <= 1e-8, false)), true) as symmetric from b")
def v14(spark, d):
    return X.is_symmetric(brand_graph(spark, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("s")))


@query("v16_signal_to_noise", "select " + r_sql("var_pop(l_extendedprice) / var_pop(l_quantity)") + " as snr from lineitem")
def v16(spark, d):
    return X.signal_to_noise(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").select(r6(F.col("snr")).alias("snr"))


_U = lambda k: u_sql(f"concat_ws('|', 'noise0', id, dim, '{k}')")


@query("v16_added_noise", f"with {CELLS_SQL} select id, dim, {r_sql(f'sqrt(0.5) * x + sqrt(0.5) * stddev_samp(x) over () * sqrt(-2 * ln(greatest({_U('a')}, 1e-12))) * cos(2 * pi() * {_U('b')})')} as x from c")
def v16b(spark, d):
    return X.add_noise(cells(spark, d), 0.5, ["id", "dim"]).select("id", "dim", r6(F.col("x")).alias("x"))


@query("v19_rating_join", "with v as (select p_brand as word, min(p_partkey) as idx from part group by 1), r as (select distinct p_brand as word, p_size as rating from part where p_size > 25) select idx, rating from r join v using (word)")
def v19(spark, d):
    p = table(spark, d, "part")
    v = p.groupBy(F.col("p_brand").alias("word")).agg(F.min("p_partkey").alias("idx"))
    return p.where("p_size > 25").select(F.col("p_brand").alias("word"), F.col("p_size").alias("rating")).distinct().join(v, "word").select("idx", "rating")


@query("k12_graph_similarity", f"with {_STEPS} select src as i, dst as j, {r_sql('w / (select case when max(w) > 1 then max(w) else 1 end from e)')} as s from e")
def k12(spark, d):
    e = brand_graph(spark, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("s"))
    return K.graph_similarity(e).select("i", "j", r6(F.col("s")).alias("s"))


@query("g6_strength", f"with {_STEPS} select distinct src, {r_sql('sum(w) over (partition by src)')} as strength from e")
def g6s(spark, d):
    return brand_graph(spark, d).select("src", r6(G.strength(None, "src")).alias("strength")).distinct()


@query("c1_correlation_with_p")
def c1(spark, d):
    row = table(spark, d, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count(F.lit(1)).alias("n")).first()
    return spark.createDataFrame([(float(row.r), correlation_p(row.r, row.n), row.n)], "r double, p double, n long")


@query("r3_permutation_test", f"with e as (select user_id as id, avg(value) as x, count(*)::double as y from events group by 1), pm as (select id, perm from e, range(51) as q(perm)), dr as (select *, case when perm > 0 then {u_sql('''concat_ws('|', 'perm0', perm, id)''')} else 0 end as u from pm), ka as (select perm, id, row_number() over (partition by perm order by id) as k from dr), kb as (select perm, id as t, row_number() over (partition by perm order by u, id) as k from dr), rr as (select perm, abs(corr(a.x, b.y)) as r from ka join kb using (perm, k) join e a on a.id = ka.id join e b on b.id = kb.t group by 1) select {r_sql('(select r from rr where perm = 0)')} as r, {r_sql('(count(*) filter (r >= (select r from rr where perm = 0)) + 1) / (count(*) + 1)')} as p from rr where perm > 0")
def r3(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    return X.permutation_test(e, "x", "y", "id", 50).select(r6(F.col("r")).alias("r"), r6(F.col("p")).alias("p"))


@query("s8_trend_similarity", f"with {_BOOT} select a.k as a, b.k as b, {r_sql('corr(a.i, b.i)')} as r from bt a join bt b using (p) group by 1, 2")
def s8(spark, d):
    return X.trend_similarity(_boot(spark)).select("a", "b", r6(F.col("r")).alias("r"))


@query("s8_trend_groups")
def s8b(spark, d):
    return X.trend_groups(X.trend_similarity(_boot(spark)), 0.99, 3)


@query("s11_signal_floor", f"with {_BOOT}, m as (select quantile_cont(i, 0.5) as m, quantile_cont(i, 0.1) as f from bt) select {r_sql('any_value(f)')} as floor, {r_sql('quantile_cont(abs(i - m), 0.5) + 1e-12')} as mad from bt, m")
def s11(spark, d):
    return X.signal_floor(_boot(spark)).select(r6(F.col("floor")).alias("floor"), r6(F.col("mad")).alias("mad"))


@query("s13_lift_off", f"with {_BOOT}, h as (select k, p, i, sum((i >= 0.5)::int) over w = 2 and count(*) over w = 2 as hit from bt window w as (partition by k order by p rows between current row and 1 following)) select k, {r_sql('min(p) filter (hit)')} as p from h group by 1")
def s13(spark, d):
    return C.first_run(_boot(spark), "p", "i", 0.5, 2, ["k"]).select("k", r6(F.col("first")).alias("p"))


@query("s16_double_centred", f"with {_W}, f as (select i, j, s from p union all select j, i, s from p where i <> j) select i, j, {r_sql('s - avg(s) over (partition by i) - avg(s) over (partition by j) + avg(s) over ()')} as s from f")
def s16(spark, d):
    p = S.planted(spark, N, RANK)
    return X.double_centred(p.unionByName(p.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "s"))).select("i", "j", r6(F.col("s")).alias("s"))


@query("v14_is_psd")
def v14b(spark, d):
    values = np.linalg.eigvalsh(S.dense(S.planted(spark, N, RANK), diagonal=None)[1])
    return spark.createDataFrame([(bool(values.min() >= -1e-8), float(values.min()))], "psd boolean, least double")


_LAB = "lab as (select user_id as id, month(ts) as run, max_by(event_type, (c, event_type)) as label from (select user_id, ts, event_type, count(*) over (partition by user_id, month(ts), event_type) as c from events) group by 1, 2)"


def _labels(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.month("ts").alias("run"), "event_type").agg(F.count(F.lit(1)).alias("c"))
    labels = e.groupBy("id", "run").agg(F.max_by("event_type", F.struct("c", "event_type")).alias("label"))
    return Scratch(spark, "labels").table(labels, "labels")  # read a few times


@query("m7_co_association", f"with {_LAB} select a.id as i, b.id as j, {r_sql('count(*) / (select count(distinct run) from lab)')} as c from lab a join lab b on a.run = b.run and a.label = b.label and a.id < b.id group by 1, 2")
def m7(spark, d):
    return X.co_association(_labels(spark, d)).select("i", "j", r6(F.col("c")).alias("c"))


@query("m7_dispersion", f"with {_LAB}, c as (select count(*) / (select count(distinct run) from lab) as c from lab a join lab b on a.run = b.run and a.label = b.label and a.id < b.id group by a.id, b.id), n as (select count(distinct id) as n from lab) select {r_sql('1 - 4 * (select sum(c * (1 - c)) from c) / (n * (n - 1) / 2)')} as dispersion from n")
def m7b(spark, d):
    labels = _labels(spark, d)
    return X.dispersion(X.co_association(labels), labels.select("id").distinct().count()).select(r6(F.col("dispersion")).alias("dispersion"))


@query("p2_impute_neighbours", f"with {_HID}, f as (select i, j, s from h where shown union all select j, i, s from h where shown and i <> j), dd as (select x.j as a, y.j as b, sqrt(avg((x.s - y.s) * (x.s - y.s))) as d from f x join f y on x.i = y.i and x.j <> y.j group by 1, 2), ways as (select i, j, i as r, j as a from h where not shown union all select i, j, j, i from h where not shown), o as (select ways.i, ways.j, r, f.s, row_number() over (partition by r, ways.a order by d, dd.b) as k from ways join dd on dd.a = ways.a join f on f.i = r and f.j = dd.b), g as (select i, j, r, avg(s) as g from o where k <= 5 group by 1, 2, 3) select i, j, {r_sql('avg(g)')} as guess from g group by 1, 2")
def p2k(spark, d):
    return X.impute_neighbours(S.hidden(S.planted(spark, N, RANK), 0.6)).select("i", "j", r6(F.col("guess")).alias("guess"))


@query("p3_adaptive_rho", f"with {_W} select i, (case when count(*) < 20 then 0.3 when count(*) < 40 then 1.0 else 3.0 end)::double as rho from p group by 1")
def p3r(spark, d):
    n = F.count(F.lit(1))
    return S.planted(spark, N, RANK).groupBy("i").agg(F.when(n < 20, 0.3).when(n < 40, 1.0).otherwise(3.0).alias("rho"))


@query("w14_dominant_dimension", f"with {V_SQL} select id, list_position(v, list_max(v))::bigint as dim from v")
def w14(spark, d):
    return vectors(spark, d).select("id", F.array_position("v", F.array_max("v")).alias("dim"))


@query("t7_select_setting", "with g as (select l_returnflag as mode, l_linenumber::bigint as seed, " + r_sql("avg(l_discount)") + " as score from lineitem group by 1, 2), s as (select mode, avg(score) as mean, max(score) as best from g group by 1) select mode, " + r_sql("mean") + " as mean, best from s order by mean desc, mode limit 1")
def t7(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("mode"), "l_linenumber").agg(r6(F.avg("l_discount")).alias("score"))
    s = g.groupBy("mode").agg(F.avg("score").alias("mean"), F.max("score").alias("best"))
    return s.orderBy(F.desc("mean"), "mode").limit(1).select("mode", r6(F.col("mean")).alias("mean"), "best")


@query("t11_last_logged_value", "with l as (select user_id, ts, event_id, regexp_extract(props, '(\\d+)', 1) as v from events where regexp_matches(props, '\\d')) select user_id, max_by(v, (ts, event_id))::bigint as last from l group by 1")
def t11(spark, d):
    e = table(spark, d, "events").withColumn("v", F.regexp_extract("props", r"(\d+)", 1)).where("v != ''")
    return e.groupBy("user_id").agg(F.max_by("v", F.struct("ts", "event_id")).cast("long").alias("last"))
