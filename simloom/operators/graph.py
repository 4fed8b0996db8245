"""Weighted graphs ``src, dst, w`` and word associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.operators.components import connected_components
from simloom.scratch import Scratch


def directed(rows: DataFrame, order: str) -> DataFrame:
    """One edge for each ``src, dst``; the last in ``order`` gives the weight."""
    return rows.groupBy("src", "dst").agg(F.max_by("w", order).alias("w"))


def edge_list(rows: DataFrame, *, weighted: bool = True, scale: bool = False) -> DataFrame:
    """Undirected edges once, with the greatest weight; scaled to 0 .. 1 unless all are equal."""
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    if not weighted:
        return rows.select(*ends).distinct()
    out = rows.select(*ends, "w").groupBy("src", "dst").agg(F.max("w").alias("w"))
    if scale:
        span = out.agg(F.min("w").alias("low"), F.max("w").alias("high"))
        w = F.when(F.col("high") > F.col("low"), (F.col("w") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.col("w"))
        out = out.crossJoin(F.broadcast(span)).select("src", "dst", w.alias("w"))
    return out


def without_sinks(edges: DataFrame) -> DataFrame:
    """Edges without self-loops and, in one pass, without nodes that have no way out."""
    kept = edges.where("src != dst")
    return kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "w")


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node of the strongly connected component), by colouring.

    Every node takes the smallest colour that reaches it; what reaches a
    colour's root backwards within the colour is a component and leaves.  The
    sweeps are joins and aggregations, cut at each one.
    """
    scratch = Scratch(edges.sparkSession, "strong")
    left = scratch.table(edges.select("src", "dst").where("src != dst").distinct(), "edges_0")
    nodes = scratch.table(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes_0")
    done, k = None, 0
    while not nodes.isEmpty():
        k += 1
        colour = _spread(scratch, nodes.select("node", F.col("node").alias("c")), left, f"f{k}")
        named = left.join(colour.withColumnRenamed("node", "src").withColumnRenamed("c", "cs"), "src").join(colour.withColumnRenamed("node", "dst").withColumnRenamed("c", "cd"), "dst")
        back = scratch.table(named.where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")), f"back_{k}")
        seeds = colour.select("node", F.when(F.col("node") == F.col("c"), F.col("c")).alias("c"))
        reached = _spread(scratch, seeds, back, f"b{k}").where("c is not null")
        found = scratch.table(reached.join(colour.withColumnRenamed("c", "own"), "node").where("c = own").select("node", F.col("c").alias("component")), f"found_{k}")
        done = found if done is None else done.unionByName(found)
        gone = found.select("node")
        nodes = scratch.table(nodes.join(gone, "node", "left_anti"), f"nodes_{k}")
        left = scratch.table(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), f"edges_{k}")
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def _spread(scratch: Scratch, start: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Smallest colour that reaches each node along the edges."""
    now, k = scratch.table(start, f"{name}_0"), 0
    while True:
        k += 1
        come = edges.join(now.select(F.col("node").alias("src"), "c"), "src").where("c is not null").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("n"))
        new = scratch.table(now.join(come, "node", "left").select("node", F.least("c", "n").alias("c"), (F.col("n").isNotNull() & (F.col("c").isNull() | (F.col("n") < F.col("c")))).alias("moved")), f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}")
        moved = new.where("moved").isEmpty()
        now = new.select("node", "c")
        if moved:
            return now


def largest_component(edges: DataFrame, *, strong: bool) -> DataFrame:
    """Edges within the largest component; of equal ones that with the smallest node."""
    named = strong_components(edges) if strong else connected_components(edges)
    best = named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    kept = named.join(F.broadcast(best), "component", "left_semi").select("node")
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """``i, j, w`` with dense node numbers in node order, from 0."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    number = nodes.withColumn("k", (F.row_number().over(Window.orderBy("node")) - 1).cast("long"))
    one, two = (number.select(F.col("node").alias(a), F.col("k").alias(b)) for a, b in (("src", "i"), ("dst", "j")))
    return edges.join(one, "src").join(two, "dst").select("i", "j", "w")


def symmetrize(edges: DataFrame, method: str = "sum", *, both_ways: bool = False) -> DataFrame:
    """``i, j, s`` with i < j from both directions' weights; a missing one is 0; pairs with neither have no row."""
    way = F.col("src") < F.col("dst")
    pair = (
        edges.where("src != dst")
        .groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
        .agg(F.sum(F.when(way, F.col("w"))).alias("f"), F.sum(F.when(~way, F.col("w"))).alias("g"))
    )
    if both_ways:
        pair = pair.where("f is not null and g is not null")
    f, g = F.coalesce("f", F.lit(0.0)), F.coalesce("g", F.lit(0.0))
    how = {"sum": f + g, "arithmetic_mean": (f + g) / 2, "max": F.greatest(f, g), "geometric_mean": F.sqrt(f * g)}
    if method not in how:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(how)}")
    return pair.select("i", "j", how[method].alias("s"))


def vocabulary(edges: DataFrame, top: int | None) -> DataFrame:
    """``word, strength`` of the words with most weight in and out; ties by word; all if ``top`` is none."""
    words = edges.select(F.explode(F.array(F.struct(F.col("src").alias("word"), "w"), F.struct(F.col("dst").alias("word"), "w"))).alias("p"))
    strength = words.groupBy("p.word").agg(F.sum("p.w").alias("strength"))
    return strength.orderBy(F.desc("strength"), "word").limit(top) if top and top > 0 else strength


def ppmi(counts: DataFrame, *, negative_as_null: bool = False, floor: float = 1e-7) -> DataFrame:
    """``src, dst, v``: positive pointwise mutual information of counts, off the diagonal."""
    total = counts.agg(F.sum("w").alias("total"))
    rows = counts.groupBy("src").agg(F.sum("w").alias("row"))
    cols = counts.groupBy("dst").agg(F.sum("w").alias("col"))
    probability = lambda c: F.greatest(F.col(c) / F.col("total"), F.lit(floor))
    v = F.log2((F.col("w") / F.col("total")) / (probability("row") * probability("col")))
    v = F.when(v > 0, v) if negative_as_null else F.greatest(v, F.lit(0.0))
    return counts.where("src != dst and w > 0").join(rows, "src").join(cols, "dst").crossJoin(F.broadcast(total)).select("src", "dst", v.alias("v"))


def self_information(counts: DataFrame, floor: float = 1e-7) -> DataFrame:
    """``node, v``: the diagonal, -log2 of a row's probability."""
    total = counts.agg(F.sum("w").alias("total"))
    return counts.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("row")).crossJoin(F.broadcast(total)).select("node", (-F.log2(F.greatest(F.col("row") / F.col("total"), F.lit(floor)))).alias("v"))


def l1_rows(m: DataFrame) -> DataFrame:
    """Rows of ``i, j, v`` divided by their sums; a row of sum 0 by one."""
    total = F.sum("v").over(Window.partitionBy("i"))
    return m.withColumn("v", F.col("v") / F.when(total == 0, 1.0).otherwise(total))


def walk_ppmi(p: DataFrame, n: int) -> DataFrame:
    """max(log2(P n / column sum), 0) of a stochastic matrix ``i, j, v``."""
    total = F.sum("v").over(Window.partitionBy("j"))
    return p.withColumn("v", F.when((F.col("v") > 0) & (total > 0), F.greatest(F.log2(F.col("v") * n / total), F.lit(0.0))).otherwise(0.0))


def katz(p: DataFrame, nodes: DataFrame, alpha: float = 0.75, tol: float = 1e-9) -> DataFrame:
    """(I - alpha P)^-1 as the sum of (alpha P)^t; a step is one join and aggregation."""
    scratch = Scratch(p.sparkSession, "katz")
    step = scratch.table(p.select(F.col("i").alias("m"), "j", (F.col("v") * alpha).alias("a")).where("a != 0"), "p")
    term = nodes.select(F.col("i"), F.col("i").alias("j"), F.lit(1.0).alias("v"))
    total, k, size = scratch.table(term, "sum_0"), 0, 1.0
    term = total
    while size > tol:
        k += 1
        term = scratch.table(term.select("i", F.col("j").alias("m"), "v").join(step, "m").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("a")).alias("v")), f"term_{k}")
        total = scratch.table(total.unionByName(term).groupBy("i", "j").agg(F.sum("v").alias("v")), f"sum_{k}")
        scratch.drop(f"sum_{k - 1}")
        size = term.agg(F.max(F.abs("v")).alias("x")).first().x or 0.0
    return total


def katz_dense(p: DataFrame, alpha: float = 0.75, most: int = 6000) -> DataFrame:
    """As ``katz``, by one dense inverse in one task; for a checked, small number of nodes."""
    nodes = p.select(F.explode(F.array("i", "j")).alias("n")).distinct().count()
    if nodes > most:
        raise ValueError(f"{nodes} nodes; a task holds {most}")

    def run(pdf):
        import numpy as np
        import pandas as pd

        names = np.unique(np.concatenate([pdf.i.to_numpy(), pdf.j.to_numpy()]))
        m = np.zeros((len(names), len(names)))
        np.add.at(m, (np.searchsorted(names, pdf.i), np.searchsorted(names, pdf.j)), pdf.v)
        walk = np.linalg.inv(np.eye(len(m)) - alpha * m)
        a, b = np.indices(walk.shape).reshape(2, -1)
        return pd.DataFrame({"i": names[a], "j": names[b], "v": walk.reshape(-1)})

    return p.groupBy(F.lit("all").alias("all")).applyInPandas(run, "i long, j long, v double")


def dense_walk_similarity(counts: DataFrame, alpha: float = 0.75, most: int = 6000) -> DataFrame:
    """``i, j, s``: L1, PPMI, L1, Katz walk, PPMI, L1, cosine, in one task; the checked number of nodes bounds its memory."""
    nodes = counts.select(F.explode(F.array("i", "j")).alias("n")).distinct().count()
    if nodes > most:
        raise ValueError(f"{nodes} nodes; a task holds {most}")

    def run(pdf):
        import numpy as np
        import pandas as pd

        names = np.unique(np.concatenate([pdf.i.to_numpy(), pdf.j.to_numpy()]))
        m = np.zeros((len(names), len(names)))
        np.add.at(m, (np.searchsorted(names, pdf.i), np.searchsorted(names, pdf.j)), pdf.v)

        def l1(x):
            t = x.sum(1, keepdims=True)
            return x / np.where(t == 0, 1, t)

        def information(x):
            t = x.sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.nan_to_num(np.maximum(np.log2(x * len(x) / t), 0), nan=0.0, posinf=0.0)

        walk = np.linalg.inv(np.eye(len(m)) - alpha * l1(information(l1(m))))
        x = l1(information(l1(walk)))
        norm = np.linalg.norm(x, axis=1)
        s = (x @ x.T) / np.where(norm == 0, 1, norm)[:, None] / np.where(norm == 0, 1, norm)
        a, b = np.triu_indices(len(m), 1)
        return pd.DataFrame({"i": names[a], "j": names[b], "s": s[a, b]})

    return counts.groupBy(F.lit("all").alias("all")).applyInPandas(run, "i long, j long, s double")


def min_length(words: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Rows whose words all have ``n`` characters or more; nulls go."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.length(c) >= n)
    return words.where(keep)


def zeros_as_missing(m: DataFrame) -> DataFrame:
    """``i, j, s`` without off-diagonal zeros."""
    return m.where((F.col("s") != 0) | (F.col("i") == F.col("j")))


def strength(m: DataFrame, by: Column | str) -> Column:
    return F.sum("w").over(Window.partitionBy(by))
