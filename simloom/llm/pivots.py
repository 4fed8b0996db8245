"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order; the
first ones are its prefix.  Each set of ``shared`` pivots out of a prefix is a
key of the inverted index, so vectors that meet in a list share at least that
many pivots.  Pairs of a list are verified by their cosine in double precision.
A pair that meets in several lists belongs to the list of its lowest shared
pivots and is verified only there, so links are counted without a distinct.

Equal vectors of one label are one class, found by an aggregation beforehand.
A list is dealt into cells of two blocks of bounded size, whichever task they
fall to, so that a hot list is no single task's; a cell sends on sums and a
spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from simloom.llm.arrays import tidy
from simloom.operators.components import connected_components, union_find
from simloom.scratch import Scratch

COSINE = 0.98
#: Reference points, taken from the vectors with the smallest hash of the id; at most 64.
PIVOTS = 64
#: Nearest pivots in a prefix, and pivots that a pair must share.
PREFIX, SHARED = 7, 3
#: Vectors in a block of a list.
BLOCK = 256
#: Pairs verified at once, and the components that their vectors may have together.
_PAIRS, _COMPONENTS = 1 << 15, 1 << 21


def _matrix(column: pa.Array) -> list[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    ends = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1] - 0, ends[1:], strict=True)]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by powers of two beforehand, so that no square overflows or vanishes."""
    most = np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1]
    rows = np.ldexp(rows, -most)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def prefixes(vectors: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    """Indices of the ``size`` nearest pivots by cosine, nearest first; ties to the lower index."""
    return np.argsort(-(_unit(vectors) @ pivots.T).round(12), axis=1, kind="stable")[:, :size]


def _index(pivots: list[list[float]], size: int, shared: int):
    """Postings of class representatives: each key is the mask of its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(3))
            at, keys, masks = [], [], []
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(rows):
                by_dim.setdefault(len(v), []).append(k)
            for dim, of in by_dim.items():
                points = _unit(np.array([np.resize(p, dim) for p in pivots], float))
                near = prefixes(np.stack([rows[k] for k in of]), points, size)
                bit = np.uint64(1) << near.astype(np.uint64)
                whole = np.bitwise_or.reduce(bit, axis=1)
                for pick in combinations(range(near.shape[1]), min(shared, near.shape[1])):
                    at.append(np.array(of))
                    keys.append(np.bitwise_or.reduce(bit[:, list(pick)], axis=1))
                    masks.append(whole)
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            where = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(where),
                    batch.column(1).take(where),
                    batch.column(2).take(where),
                    pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64()),
                    pa.array(np.concatenate(masks).view(np.int64) if masks else [], pa.int64()),
                ],
                names=["label", "rep", "copies", "key", "mask"],
            )

    return run


def _lowest(common: np.ndarray, n: int) -> np.ndarray:
    """Masks of the n lowest bits that are set."""
    out, left = np.zeros_like(common), common.copy()
    for _ in range(n):
        bit = left & (~left + np.uint64(1))
        out |= bit
        left ^= bit
    return out


def _verify(cosine: float, shared: int):
    def links(group: np.ndarray, block: np.ndarray, same: np.ndarray, key: np.ndarray, mask: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        after = np.repeat(np.append(begins[1:], len(group)), np.diff(np.append(begins, len(group)))) - np.arange(len(group)) - 1
        ends = np.cumsum(after)
        most = max(1, min(_PAIRS, _COMPONENTS // max(1, unit.shape[1])))
        at = 0
        while at < len(group):  # so many rows' pairs at once
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            n = after[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            at = to
            mine = same[i] | (block[i] != block[j])
            i, j = i[mine], j[mine]
            own = _lowest(mask[i] & mask[j], shared) == key[i]
            i, j = i[own], j[own]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            yield i[near], j[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by cell; what may go on in the next batch waits.
        held: pa.Table | None = None

        def solve(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            get = lambda name: table.column(name).to_numpy()
            vectors = table.column("vector").combine_chunks()
            rows = _matrix(vectors)
            rep, copies = get("rep"), get("copies")
            dims = np.array([len(r) for r in rows])
            cell = get("cell")
            sums: dict[int, int] = {}
            edges: list[tuple[int, int]] = []
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                unit = _unit(np.stack([rows[k] for k in of]))
                mask, key = (get(x)[of].view(np.uint64) for x in ("mask", "key"))
                for i, j in links(cell[of], get("block")[of], get("same")[of].astype(bool), key, mask, unit):
                    i, j = of[i], of[j]
                    for a, b in ((i, j), (j, i)):
                        ids, inverse = np.unique(rep[a], return_inverse=True)
                        for x, n in zip(ids.tolist(), np.bincount(inverse, copies[b]).astype(np.int64).tolist(), strict=True):
                            sums[x] = sums.get(x, 0) + n
                    edges.extend(zip(rep[i].tolist(), rep[j].tolist(), strict=True))
                    if len(edges) > 4 * _PAIRS:
                        edges = [(x, r) for x, r in union_find(edges).items() if x != r]
            forest = [(x, r) for x, r in union_find(edges).items() if x != r]
            out = [(0, x, n) for x, n in sums.items()] + [(1, x, r) for x, r in forest]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["kind", "x", "y"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            cell = table.column("cell").to_numpy()
            cut = int(np.searchsorted(cell == cell[-1], True)) if len(cell) else 0  # the last cell's rows are the tail
            if cut and table.num_rows:
                yield solve(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def near_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    shared: int = SHARED,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each input row.

    Vectors of one label, not null, are linked if their cosine reaches
    ``cosine``; null, empty and zero vectors, and those with null or non-finite
    components, link with nothing, nor do vectors of different lengths.
    Repeated rows are vectors of their own that link with each other; rows that
    repeat an id share a component; a null id stays alone.  Other columns are
    not read; no rows give no rows.
    """
    scratch = Scratch(vectors.sparkSession, "pivots")
    # Vectors travel as they are stored where that is narrower; they are compared in double precision.
    stored = vectors.schema[vector_col].dataType
    narrow = isinstance(stored, ArrayType) and isinstance(stored.elementType, FloatType)
    v = F.col(vector_col).cast("array<float>" if narrow else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("vector"))
    infinite = F.lit(float("inf")).cast("float" if narrow else "double")
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    digest = [F.xxhash64("vector").alias("h_a"), F.xxhash64(F.lit(17), "vector").alias("h_b")]
    key = ["label", "h_a", "h_b"]
    good = rows.where(sound)
    classes = scratch.table(good.select("*", *digest).groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "classes")
    chosen = [r.vector for r in classes.orderBy(F.xxhash64("rep"), "rep").select("vector").limit(min(pivots, 64)).collect()]
    if not chosen:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    size, common = min(prefix, len(chosen)), min(shared, prefix, len(chosen))
    # Classes that share no key with another are done; the others' keys carry no vectors yet.
    postings = scratch.table(
        classes.select("label", "rep", "copies", "vector").mapInArrow(tidy(_index(chosen, size, common)), "label string, rep long, copies long, key long, mask long"), "postings"
    )
    lists = postings.groupBy("label", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block)
    placed = (
        postings.join(lists, ["label", "key"])
        .withColumn("blocks", blocks.cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    cell = F.xxhash64("label", "key", F.least("block", "other"), F.greatest("block", "other"))
    spread = placed.select(cell.alias("cell"), "rep", "copies", "key", "mask", "block", (F.col("block") == F.col("other")).alias("same"))
    # In a cell of two blocks, pairs within a block belong to that block's own cell.
    spread = spread.withColumn("same", F.col("same").cast("int"))
    full = spread.join(classes.select("rep", "vector"), "rep").select("cell", "rep", "copies", "key", "mask", "block", "same", "vector")
    found = scratch.table(full.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(_verify(cosine, common)), "kind long, x long, y long"), "found")
    scratch.drop("postings")
    sums = found.where("kind = 0").groupBy("x").agg(F.sum("y").alias("n")).withColumnRenamed("x", "rep")
    groups = connected_components(found.where("kind = 1").select(F.col("x").alias("src"), F.col("y").alias("dst")), scratch=scratch)
    named = (
        classes.select(*key, "rep", "copies")
        .join(sums, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*key, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    return (
        rows.select("vec_id", F.when(sound, F.col("label")).alias("label"), *digest)
        .join(named, key, "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
