"""Triplets over the embeddings, graphs over orders and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from simloom.functions.hashing import r6
from simloom.operators import graph as G
from simloom.operators import lowdata
from simloom.operators import triplets as T
from simloom.plans.registry import V_SQL, query, r_sql, table, u_sql, vectors
from simloom.scratch import Scratch

REPS = 20
_AT = lambda k: f"floor({u_sql(f'''concat_ws('|', '{k}', i, r)''')} * (select count(*) from v))::bigint"
_DRAWN = f"""{V_SQL}, d as (select i, r, {_AT("j")} as j, {_AT("k")} as k from (select id as i, unnest(range({REPS})) as r from v)),
e as (select i, j, k, list_dot_product(a.v, b.v) as ij, list_dot_product(a.v, c.v) as ik, list_dot_product(b.v, c.v) as jk
  from d join v a on a.id = i join v b on b.id = j join v c on c.id = k where i <> j and i <> k and j <> k),
t as (select case when ij = greatest(ij, ik, jk) or ik = greatest(ij, ik, jk) then i else j end as a,
  case when ij = greatest(ij, ik, jk) then j else k end as b,
  case when ij = greatest(ij, ik, jk) then k when ik = greatest(ij, ik, jk) then j else i end as c from e)"""
_WINS = f"""{_DRAWN}, p as (select least(a, b) as i, greatest(a, b) as j, 1 as w from t union all select least(a, c), greatest(a, c), 0 from t union all select least(b, c), greatest(b, c), 0 from t),
w as (select i, j, sum(w)::bigint as wins, count(*) as trials from p group by 1, 2)"""


def drawn(spark, d):
    return T.sampled(vectors(spark, d).select("id", "v"), REPS)


@query("t1_pair_wins", f"with {_WINS} select * from w")
def t1(spark, d):
    return T.pair_wins(drawn(spark, d))


@query("t2_similarity_from_triplets", f"with {_WINS} select i, j, {r_sql('(wins + 1.0) / (trials + 2.0)')} as s from w")
def t2(spark, d):
    return T.similarity(T.pair_wins(drawn(spark, d))).select("i", "j", r6(F.col("s")).alias("s"))


@query("t3_laplace_filled", f"with {_WINS} select a.id as i, b.id as j, {r_sql('coalesce((wins + 1.0) / (trials + 2.0), 0.5)')} as s from v a join v b on a.id < b.id left join w on w.i = a.id and w.j = b.id")
def t3(spark, d):
    v = vectors(spark, d)
    return T.similarity(T.pair_wins(drawn(spark, d)), items=v.select("id"), fill=0.5).select("i", "j", r6(F.col("s")).alias("s"))


_STEP = f"""{_WINS}, y as (select i, j, ln(m / (1 - m)) as y, trials * m * (1 - m) as f from (select *, least(greatest((wins + 1.0) / (trials + 2.0), 0.001), 0.999) as m from w)),
o as (select sum(y * f) / sum(f) as mean from y), z as (select i, y, f from y union all select j, y, f from y), b as (select i as id, sum(f * (y - mean)) / sum(f) as b from z, o group by 1)"""


@query("t4_bias_prior_step", f"with {_STEP} select id, {r_sql('b - (select avg(b) from b)')} as b from b")
def t4(spark, d):
    return T.bias_prior(T.pair_wins(drawn(spark, d)), steps=1)[1].select("id", r6(F.col("b")).alias("b"))


@query("t5_bias_aware_similarity")
def t5(spark, d):
    wins = T.pair_wins(drawn(spark, d))
    return T.bias_aware(wins, *T.bias_prior(wins, steps=12)).select("i", "j", r6(F.col("s")).alias("s"))


@query("t6_triplet_accuracy", f"with {_DRAWN}, h as (select id, v[1:16] as v from v) select {r_sql('avg((ab > ac and ab > bc)::int)')} as accuracy, count(*) as n from (select list_dot_product(x.v, y.v) as ab, list_dot_product(x.v, z.v) as ac, list_dot_product(y.v, z.v) as bc from t join h x on x.id = a join h y on y.id = b join h z on z.id = c)")
def t6(spark, d):
    half = vectors(spark, d).select("id", F.slice("v", 1, 16).alias("v"))
    return T.accuracy(drawn(spark, d), half).select(r6(F.col("accuracy")).alias("accuracy"), "n")


_SHARES = [0.05, 0.2, 0.5, 1.0]


@query("t10_nested_pair_counts", f"with {_DRAWN}, u as (select a, b, c, {u_sql("concat_ws('|', 'fraction0', a, b, c)")} as u from t), p as (select u, least(a, b) as i, greatest(a, b) as j, 1 as w from u union all select u, least(a, c), greatest(a, c), 0 from u union all select u, least(b, c), greatest(b, c), 0 from u) select f as fraction, i, j, sum(w)::bigint as wins, count(*) as trials from p, (select unnest({_SHARES}::double[]) as f) where u < f group by 1, 2, 3")
def t10(spark, d):
    return lowdata.nested_wins(drawn(spark, d), _SHARES)


def _split(spark, d):
    both = Scratch(spark, "triplets").table(T.hash_split(drawn(spark, d), ["a", "b", "c"], 0.9), "split")
    return both.where("train"), both.where("not train")


@query("t7_fit_and_score")
def t7(spark, d):
    """Ranks fitted to nine tenths of the triplets, scored on the others."""
    train, test = _split(spark, d)
    return lowdata.fit_and_score(T.pair_wins(train), test, [2, 6, 12], steps=60)


@query("t10_low_data_curve")
def t10b(spark, d):
    train, test = _split(spark, d)
    return lowdata.low_data_curve(train, test, _SHARES, [6], steps=60)


@query("t9_triplet_split", f"with {_DRAWN} select train, count(*) as n, sum(a)::bigint as a, sum(c)::bigint as c from (select *, {u_sql('''concat_ws('|', 'split0', a, b, c)''')} < 0.9 as train from t) group by 1")
def t9(spark, d):
    return T.hash_split(drawn(spark, d), ["a", "b", "c"], 0.9).groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("c").alias("c"))


@query("io24_equal_partitions", f"with n as (select count(*) // 7 as n from orders), k as (select *, row_number() over (order by {u_sql('''concat_ws('|', 'part', o_orderkey)''')}, o_orderkey) - 1 as k from orders) select (k // n)::bigint as part, count(*) as n, sum(o_orderkey)::bigint as keys from k, n where k < n * 7 group by 1")
def io24(spark, d):
    return T.partitions(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


# Brand to next brand over the lines of an order.
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
_STEPS = f"""m as (select l_orderkey, p_brand as src, lead(p_brand) over (partition by l_orderkey order by {_ORDER}) as dst, l_quantity as w, l_shipdate, l_extendedprice, l_linenumber from lineitem join part on l_partkey = p_partkey),
s as (select * from m where dst is not null), e as (select src, dst, sum(w) as w from s group by 1, 2)"""


def _moves(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy(*(c.strip() for c in _ORDER.split(",")))
    return li.select("l_orderkey", F.col("p_brand").alias("src"), F.lead("p_brand").over(w).alias("dst"), F.col("l_quantity").alias("w"), "l_shipdate", "l_extendedprice", "l_linenumber").where("dst is not null")


def brand_graph(spark, d):
    return _moves(spark, d).groupBy("src", "dst").agg(F.sum("w").alias("w"))


@query("g1_last_write_wins", f"with {_STEPS} select src, dst, max_by(w, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) as w from s group by 1, 2")
def g1(spark, d):
    return G.directed(_moves(spark, d).withColumn("o", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")), "o")


@query("g2_clean_sinks", f"with {_STEPS}, k as (select * from e where src <> dst) select src, dst, {r_sql('w')} as w from k where dst in (select src from k)")
def g2(spark, d):
    return G.without_sinks(brand_graph(spark, d)).select("src", "dst", r6(F.col("w")).alias("w"))


@query("g4_adjacency", f"with {_STEPS}, n as (select node, row_number() over (order by node) - 1 as k from (select src as node from e union select dst from e)) select a.k as i, b.k as j, {r_sql('w')} as w from e join n a on a.node = src join n b on b.node = dst")
def g4(spark, d):
    return G.adjacency(brand_graph(spark, d)).select("i", "j", r6(F.col("w")).alias("w"))


_PAIR = f"""{_STEPS}, f as (select least(src, dst) as i, greatest(src, dst) as j, sum(w) filter (src < dst) as f, sum(w) filter (src > dst) as g from e where src <> dst group by 1, 2)"""
_HOW = {"sum": "coalesce(f, 0) + coalesce(g, 0)", "arithmetic_mean": "(coalesce(f, 0) + coalesce(g, 0)) / 2", "max": "greatest(coalesce(f, 0), coalesce(g, 0))", "geometric_mean": "sqrt(coalesce(f, 0) * coalesce(g, 0))"}
for _method, _expr in _HOW.items():

    @query(f"g5_symmetrize_{_method}", f"with {_PAIR} select i, j, {r_sql(_expr)} as s from f")
    def _sym(spark, d, method=_method):
        return G.symmetrize(brand_graph(spark, d), method).select("i", "j", r6(F.col("s")).alias("s"))


@query("g6_vocabulary", f"with {_STEPS}, k as (select src as word, w from e union all select dst, w from e) select word, {r_sql('sum(w)')} as strength from k group by 1 order by sum(w) desc, word limit 10")
def g6(spark, d):
    return G.vocabulary(brand_graph(spark, d), 10).select("word", r6(F.col("strength")).alias("strength"))


# Words of a user's turn to words of the answer.
_WORDS = """u as (select distinct conv_id, turn, unnest(regexp_extract_all(lower(text), '\\p{L}{3,}')) as word, role from conversations),
q as (select a.word as src, b.word as dst, count(*)::double as w from u a join u b on a.conv_id = b.conv_id and b.turn = a.turn + 1 and a.role = 'user' group by 1, 2)"""


def word_graph(spark, d):
    c = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    # A turn's words travel as one array; a word counts once for each role that has it.
    u = c.select("conv_id", "turn", "role", words.alias("words")).where("size(words) > 0").groupBy("conv_id", "turn", "role").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    a = u.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("words").alias("from"))
    both = a.join(u.select("conv_id", "turn", F.col("words").alias("to")), ["conv_id", "turn"])
    each = both.select(F.explode("from").alias("src"), "to").select("src", F.explode("to").alias("dst"))
    return each.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


_PPMI = "{g}, t as (select sum(w) as total from e), r as (select src, sum(w) as row from e group by 1), c as (select dst, sum(w) as col from e group by 1), mi as (select src, dst, log2((w / total) / (greatest(row / total, 1e-7) * greatest(col / total, 1e-7))) as v from e join r using (src) join c using (dst), t where src <> dst and w > 0)"


@query("g7_ppmi", f"with {_PPMI.format(g=_STEPS)} select src, dst, {r_sql('greatest(v, 0)')} as v from mi")
def g7(spark, d):
    return G.ppmi(brand_graph(spark, d)).select("src", "dst", r6(F.col("v")).alias("v"))


@query("g7_ppmi_words", f"with {_PPMI.format(g=_WORDS.replace('q as (', 'e as ('))} select src, count(*) as n, round(sum(greatest(v, 0)), 3) as total, {r_sql('max(v)')} as high from mi group by 1")
def g7w(spark, d):
    counts = Scratch(spark, "words").table(word_graph(spark, d), "counts")  # read four times
    return G.ppmi(counts).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"), r6(F.max("v")).alias("high"))


@query("g7_self_information", f"with {_STEPS}, t as (select sum(w) as total from e) select src as node, {r_sql('-log2(greatest(sum(w) / any_value(total), 1e-7))')} as v from e, t group by 1")
def g7s(spark, d):
    return G.self_information(brand_graph(spark, d)).select("node", r6(F.col("v")).alias("v"))


def _numbered(spark, d):
    return G.adjacency(brand_graph(spark, d)).withColumnRenamed("w", "v")


_NUM = f"{_STEPS}, n as (select node, row_number() over (order by node) - 1 as k from (select src as node from e union select dst from e)), a as (select x.k as i, y.k as j, w as v from e join n x on x.node = src join n y on y.node = dst), l as (select i, j, v / sum(v) over (partition by i) as v from a)"


@query("g8_l1_rows", f"with {_NUM} select i, j, {r_sql('v')} as v from l")
def g8(spark, d):
    return G.l1_rows(_numbered(spark, d)).select("i", "j", r6(F.col("v")).alias("v"))


@query("g8_walk_ppmi", f"with {_NUM} select i, j, {r_sql('greatest(log2(v * (select count(*) from n) / sum(v) over (partition by j)), 0)')} as v from l")
def g8b(spark, d):
    m = _numbered(spark, d)
    return G.walk_ppmi(G.l1_rows(m), m.select("i").distinct().count()).select("i", "j", r6(F.col("v")).alias("v"))


@query("g9_katz_walk")
def g9(spark, d):
    m = _numbered(spark, d)
    return G.katz_dense(G.l1_rows(m)).select("i", "j", r6(F.col("v")).alias("v"))


@query("g10_random_walk_similarity")
def g10(spark, d):
    return G.dense_walk_similarity(_numbered(spark, d)).select("i", "j", r6(F.col("s")).alias("s"))


@query("g11_ppmi_graph", f"with {_PPMI.format(g=_STEPS)} select least(src, dst) as i, greatest(src, dst) as j, {r_sql('sum(greatest(v, 0))')} as s from mi group by 1, 2")
def g11(spark, d):
    return G.symmetrize(G.ppmi(brand_graph(spark, d)).withColumnRenamed("v", "w"), "sum").select("i", "j", r6(F.col("s")).alias("s"))


@query("g12_zeros_as_missing", f"with {_PPMI.format(g=_STEPS)}, z as (select least(src, dst) as i, greatest(src, dst) as j, sum(greatest(v, 0)) as s from mi group by 1, 2) select i, j, {r_sql('s')} as s from z where s <> 0")
def g12(spark, d):
    return G.zeros_as_missing(G.symmetrize(G.ppmi(brand_graph(spark, d)).withColumnRenamed("v", "w"), "sum")).select("i", "j", r6(F.col("s")).alias("s"))


@query("g3_components_of_suppliers")
def g3(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"), F.lit(1.0).alias("w"))
    return G.largest_component(li, strong=False).select("src", "dst").distinct()


@query("g3_strong_component")
def g3s(spark, d):
    return G.largest_component(G.without_sinks(brand_graph(spark, d)), strong=True).select("src", "dst", r6(F.col("w")).alias("w"))


@query("io6_edge_list", "with e as (select least(l_partkey, l_suppkey) as src, greatest(l_partkey, l_suppkey) as dst, max(l_discount) as w from lineitem group by 1, 2), m as (select min(w) as low, max(w) as high from e) select src, dst, " + r_sql("(w - low) / (high - low)") + " as w from e, m")
def io6(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_discount").alias("w"))
    return G.edge_list(e, scale=True).select("src", "dst", r6(F.col("w")).alias("w"))


@query("v18_word_filter", "with w as (select unnest(string_split(lower(text), ' ')) as word, doc_id from documents) select word, max(doc_id) as idx from w where length(word) >= 3 group by 1")
def v18(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return G.min_length(w, ["word"], 3).groupBy("word").agg(F.max("doc_id").alias("idx"))
