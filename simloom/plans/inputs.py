"""Source, join, set and streaming queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from simloom.functions.hashing import r6
from simloom.operators import alignment
from simloom.operators.permuted import rsa_test_of
from simloom.plans.registry import CELLS_SQL, query, r_sql, table, u_sql, vectors
from simloom.sources import readers
from simloom.streaming.cooccurrence import transitions


@query("io10_session_scores", "with z as (select user_id as stim, event_type as unit, (value - avg(value) over w) / case when stddev_pop(value) over w = 0 then 1 else stddev_pop(value) over w end as z from events window w as (partition by month(ts), event_type)) select stim, unit, " + r_sql("avg(z)") + " as x from z group by 1, 2")
def io10(spark, d):
    t = table(spark, d, "events").select(F.month("ts").alias("session"), F.col("event_type").alias("unit"), F.col("user_id").alias("stim"), F.col("value").alias("x"))
    return readers.session_scores(t).select("stim", "unit", r6(F.col("x")).alias("x"))


@query("io13_pattern_filter", "select page_id, url from pages where contains(url, '/en/')")
def io13(spark, d):
    return readers.with_pattern(table(spark, d, "pages").select("page_id", "url"), "url", "/en/")


@query("io16_clamped_vectors", f"with {CELLS_SQL} select id, {r_sql('sum(greatest(x, 0))')} as total, count(*) filter (x > 0) as positive from c group by 1")
def io16(spark, d):
    v = readers.load(spark, "vectors", f"{d}/embeddings.parquet", id_col="vec_id", vector_col="embedding", clamp=True)
    return v.select(F.col("id").cast("long").alias("id"), F.explode("v").alias("x")).groupBy("id").agg(r6(F.sum("x")).alias("total"), F.count_if(F.col("x") > 0).alias("positive"))


@query("io17_first_match", "with l as (select p_brand as name, min(p_partkey) as position from part group by 1), w as (select distinct p_brand as word from part union select 'none') select word, position from w left join l on l.name = case word when 'none' then 'missing' else word end")
def io17(spark, d):
    p = table(spark, d, "part")
    words = p.select(F.col("p_brand").alias("word")).distinct().unionByName(spark.createDataFrame([("none",)], "word string"))
    return readers.first_match(words, p.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("position")), {"none": "missing"})


@query("io18_first_per_category", "select p_type, p_partkey, p_name from part qualify row_number() over (partition by p_type order by p_name, p_partkey) = 1")
def io18(spark, d):
    return readers.first_of(table(spark, d, "part").select("p_type", "p_partkey", "p_name"), ["p_type"], ["p_name", "p_partkey"])


@query("io19_path_catalogue", "select page_id, url as path, nullif(regexp_extract(url, '(\\d{8}_\\d{6})', 1), '') as stamp, nullif(regexp_extract(url, 'rank_(\\d+)', 1), '')::bigint as rank, nullif(regexp_extract(url, '([^/]+)$', 1), '') as name from pages")
def io19(spark, d):
    return readers.run_catalogue(table(spark, d, "pages").select("page_id", F.col("url").alias("path")))


@query("io20_json_fields", "select event_id, coalesce(props::json->>'$.k', props::json->>'$.key') as k from events")
def io20(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.key")).alias("k"))


@query("io21_first_hit_wins", "select user_id, event_type, value from events qualify row_number() over (partition by user_id order by case event_type when 'purchase' then 0 else 1 end, ts, event_id) = 1")
def io21(spark, d):
    e = table(spark, d, "events")
    order = [F.when(F.col("event_type") == "purchase", 0).otherwise(1), "ts", "event_id"]
    return readers.first_of(e, ["user_id"], order).select("user_id", "event_type", "value")


@query("j1_inner_merge", "select o_orderpriority, c_mktsegment, count(*) as n, " + r_sql("avg(o_totalprice)") + " as mean from orders join customer on o_custkey = c_custkey group by 1, 2")
def j1(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return o.groupBy("o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("o_totalprice")).alias("mean"))


@query("j2_foreign_key_gather", "select r_name, n_name, count(*) as suppliers from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def j2(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("j3_semi_join", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def j3(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("j4_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def j4(spark, d):
    large = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


@query("j6_factor_grid", "select a.event_type as a, b.event_type as b, c.r_name as c from (select distinct event_type from events) a, (select distinct event_type from events) b, region c")
def j6(spark, d):
    t = table(spark, d, "events").select("event_type").distinct()
    return t.select(F.col("event_type").alias("a")).crossJoin(t.select(F.col("event_type").alias("b"))).crossJoin(table(spark, d, "region").select(F.col("r_name").alias("c")))


@query("j7_full_outer", "with e as (select l_suppkey as a, l_partkey as b, count(*) as n from lineitem group by 1, 2) select coalesce(x.a, y.b) as a, coalesce(x.b, y.a) as b, x.n as there, y.n as back from e x full join e y on x.a = y.b and x.b = y.a")
def j7(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("back"))
    return e.withColumnRenamed("n", "there").join(back, ["a", "b"], "full_outer")


@query("j9_symmetric_difference", "(select s_nationkey as k from supplier except select c_nationkey from customer where c_acctbal > 9900) union all (select c_nationkey from customer where c_acctbal > 9900 except select s_nationkey from supplier)")
def j9(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    b = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")).distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@query("u1_union_all", "select 'c' as kind, c_custkey as key, c_acctbal as balance from customer union all select 's', s_suppkey, s_acctbal from supplier")
def u1(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")))


@query("u2_jaccard_of_groups", "with s as (select event_type, list(distinct user_id) as u from events group by 1) select a.event_type as a, b.event_type as b, " + r_sql("len(list_intersect(a.u, b.u)) / len(list_distinct(list_concat(a.u, b.u)))") + " as jaccard from s a join s b on a.event_type < b.event_type")
def u2(spark, d):
    s = table(spark, d, "events").select("event_type", "user_id").distinct()
    size = s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    both = s.withColumnRenamed("event_type", "a").join(s.withColumnRenamed("event_type", "b"), "user_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    named = both.join(size.withColumnsRenamed({"event_type": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"event_type": "b", "n": "nb"}), "b")
    return named.select("a", "b", r6(F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))).alias("jaccard"))


@query("st1_windowed_counts", "select date_trunc('day', ts) as start, event_type, count(*) as n, " + r_sql("sum(value)") + " as total from events group by 1, 2")
def st1(spark, d):
    return transitions(table(spark, d, "events")).select("start", "event_type", "n", r6(F.col("total")).alias("total"))


@query("r13_repetitions", "select user_id as stim, row_number() over (partition by user_id, event_type order by hour(ts) >= 12, event_id) as rep, event_type as channel, value as x from events")
def r13r(spark, d):
    """Trials of the morning, then those of the afternoon, as two sessions."""
    t = table(spark, d, "events").select(F.col("user_id").alias("stim"), F.col("event_id").alias("trial"), F.col("event_type").alias("channel"), F.col("value").alias("x"), F.hour("ts").alias("h"))
    return readers.repetitions(t.where("h < 12"), t.where("h >= 12"))


@query("io11_reliable_channels", "with r as (select event_type, avg(r) as r from (select event_type, event_id % 2 as half, avg(value) as r from events group by 1, 2) group by 1), m as (select avg(r) as m from r) select user_id as stim, event_type as channel, " + r_sql("avg(value)") + " as x from events join r using (event_type), m where r >= m group by 1, 2")
def io11(spark, d):
    """Channels whose mean over two halves reaches the mean of all, averaged for each stimulus."""
    e = table(spark, d, "events").select(F.col("user_id").alias("stim"), F.col("event_type").alias("channel"), F.col("value").alias("x"), (F.col("event_id") % 2).alias("half"))
    r = e.groupBy("channel", "half").agg(F.avg("x").alias("r"))
    least = r.groupBy("channel").agg(F.avg("r").alias("r")).agg(F.avg("r")).first()[0]
    return readers.reliable(e, r, least, average=True).select("stim", "channel", r6(F.col("x")).alias("x"))


# Alignment of the last half of the features to the first, and tests with an assignment inside.
def _halves(spark, d):
    half = F.size("v") / 2
    return vectors(spark, d).select("id", F.slice("v", F.lit(1), half.cast("int")).alias("x"), F.slice("v", (half + 1).cast("int"), half.cast("int")).alias("w"))


@query("r8_loo_alignment")
def r8(spark, d):
    """Each dimension's match over all items, its correlation then and with each item aligned by the others, and the items whose own match is another."""
    both = _halves(spark, d)
    whole, left = alignment.aligned(both, leave_out=False), alignment.aligned(both)
    match = whole.limit(1).select(F.posexplode("match").alias("at", "match")).select((F.col("at") + 1).cast("long").alias("dim"), F.col("match").cast("long").alias("match"))
    own = left.select(F.posexplode("match").alias("at", "own")).groupBy((F.col("at") + 1).cast("long").alias("dim"), F.col("own").cast("long").alias("own")).count()
    other = own.join(F.broadcast(match), "dim").groupBy("dim").agg(F.coalesce(F.sum(F.when(F.col("own") != F.col("match"), F.col("count"))), F.lit(0)).alias("others"))
    r = alignment.aligned_correlations(whole).join(alignment.aligned_correlations(left).withColumnRenamed("r", "r_left_out"), "dim")
    return match.join(r, "dim").join(other, "dim").select("dim", "match", r6(F.col("r")).alias("r"), r6(F.col("r_left_out")).alias("r_left_out"), "others")


@query("r10_aligned_dimensions")
def r10(spark, d):
    """Each dimension's match by signed correlation, and its score."""
    whole = alignment.aligned(_halves(spark, d), leave_out=False)
    return alignment.aligned_correlations(whole).select("dim", r6(F.col("r")).alias("score"))


@query("r9_alignment_test")
def r9(spark, d):
    """Dimensions recovered when each item is aligned by the others: 1000 permutations, aligned again each time."""
    return alignment.alignment_test(_halves(spark, d), 1000).select("dim", *(r6(F.col(c)).alias(c) for c in ("r", "p", "p_adjusted")), "rejected")


# A permuted feature's sum over pairs is the form x' S x; sums of x and its squares don't change.
_RSA = f"""{CELLS_SQL}, d as (select a.id as a, b.id as b, list_distance(a.v, b.v) as y from v a, v b where a.id <> b.id),
s as (select row_number() over (order by a) as k, row from (select a, list(y order by b) as row from (select * from d union all select id, id, 0.0 from v) group by 1)),
y as (select count(*) as n, sum(y) as y, sum(y * y) as yy from d where a < b), x as (select dim, (sum(x) * sum(x) - sum(x * x)) / 2 as x, (sum(x * x) * sum(x * x) - sum(x * x * x * x)) / 2 as xx from c group by 1),
dr as (select id, perm, case when perm > 0 then {u_sql("concat_ws('|', 'perm0', perm, id)")} else 0 end as u from v, range(PERMS + 1) as q(perm)),
ka as (select perm, id, row_number() over (partition by perm order by id) as k from dr), kb as (select perm, id as t, row_number() over (partition by perm order by u, id) as k from dr),
z as (select perm, dim, list(x order by t) as z from ka join kb using (perm, k) join c using (id) group by 1, 2), f as (select perm, dim, sum(z[k] * list_dot_product(z, row)) / 2 as xy from z, s group by 1, 2),
r as (select perm, dim, abs((xy - x * y / n) / sqrt((xx - x * x / n) * (yy - y * y / n))) as r from f join x using (dim), y),
o as (select dim, r as observed from r where perm = 0), p as (select dim, observed as r, (count(*) filter (r.r >= observed) + 1) / (count(*) + 1) as p from r join o using (dim) where perm > 0 group by 1, 2),
k as (select *, row_number() over (order by p) as rk, count(*) over () as m from p), j as (select dim, r, p, least(min(p * m / rk) over (order by rk desc rows unbounded preceding), 1) as a from k)"""


@query("r6_rsa_test", f"with {_RSA.replace('PERMS', '1000')} select dim, {r_sql('r')} as r, {r_sql('p')} as p, {r_sql('a')} as p_adjusted, a <= 0.05 as rejected from j")
def r6_(spark, d):
    """Each feature's product matrix against the distances of all features."""
    v = vectors(spark, d).select("id", "v")
    return rsa_test_of(v, 1000).select("dim", *(r6(F.col(c)).alias(c) for c in ("r", "p", "p_adjusted")), "rejected")


@query("r12_dimension_reliability", f"with {CELLS_SQL}, h as (select id, dim, x, {u_sql('''concat_ws('|', 'half', id)''')} < 0.5 as h from c), a as (select p.dim as d1, q.dim as d2, corr(p.x, q.x) filter (p.h) as ra, corr(p.x, q.x) filter (not p.h) as rb from h p join h q on p.id = q.id where p.dim <= 32 and q.dim > 32 group by 1, 2), m as (select d1, d2, rb from a qualify row_number() over (partition by d1 order by abs(ra) desc, d2) = 1) select d1 as dim, d2 as match, {r_sql('2 * abs(rb) / (1 + abs(rb))')} as reliability from m")
def r12(spark, d):
    from pyspark.sql import Window

    from simloom.functions.hashing import uniform
    from simloom.plans.registry import cells

    h = cells(spark, d).withColumn("h", uniform(F.lit("half"), F.col("id").cast("string")) < 0.5)
    both = h.where("dim <= 32").withColumnsRenamed({"dim": "d1"}).join(h.where("dim > 32").select("id", F.col("dim").alias("d2"), F.col("x").alias("y")), "id")
    r = both.groupBy("d1", "d2").agg(F.corr(F.when(F.col("h"), F.col("x")), F.when(F.col("h"), F.col("y"))).alias("ra"), F.corr(F.when(~F.col("h"), F.col("x")), F.when(~F.col("h"), F.col("y"))).alias("rb"))
    best = r.withColumn("k", F.row_number().over(Window.partitionBy("d1").orderBy(F.desc(F.abs("ra")), "d2"))).where("k = 1")
    return best.select(F.col("d1").alias("dim"), F.col("d2").alias("match"), r6(2 * F.abs("rb") / (1 + F.abs("rb"))).alias("reliability"))


@query("w12_leaf_order")
def w12(spark, d):
    """Average-linkage leaf order of labels by the distance of their mean vectors."""
    v = vectors(spark, d).select("label", F.posexplode("v").alias("p", "x")).groupBy("label", "p").agg(F.avg("x").alias("x"))
    pdf = v.toPandas().pivot(index="label", columns="p", values="x").sort_index()
    x = pdf.to_numpy()
    groups = [[k] for k in range(len(x))]
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    while len(groups) > 1:
        pair = min(((float(dist[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[pair[1]] += groups.pop(pair[2])
    return spark.createDataFrame([(int(pdf.index[k]), place) for place, k in enumerate(groups[0])], "label long, place long")


