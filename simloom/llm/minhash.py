"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set is its distinct five-word shingles, each as a 64-bit
fingerprint.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of
one to four words is one shingle; a text without words, or null, has the empty
set and is linked with nothing.

SuperMinHash (Ertl, 2017) gives every element a random rank within a random
permutation of the slots, so a slot's value is ``j + r``.  All elements of a
document take step ``j`` together, and the document stops as soon as each slot
holds a value below ``j + 1``, which no later step can lower.

Documents with equal sets are one class, found by an aggregation before any
candidate work.  Bands of the signature give buckets of class representatives;
buckets are resolved in rounds.  The first rounds test every member against one
centre of its bucket, by full sets: the member that meets most others, summed
over all its buckets, which for a group of copies is near to their origin.
Members that are by now in one component need no more tests among themselves.
The last round takes the pairs of a bucket that are still in two components,
dealt out in cells of bounded size, and tests those that exact bounds on their
intersections leave, so a large bucket of copies mostly costs a test or two a
member instead of one a pair.  Texts and sets stay where they are unless a
sieve says that they may take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.arrays import U64, joined, mix, slices, tidy
from simloom.llm.sieve import sieve, sifted
from simloom.operators.components import connected_components
from simloom.scratch import Scratch

SHINGLE_WORDS = 5
#: Similarity a link needs, in hundredths.
PERCENT = 75
#: Slots of a signature, and slots in a band: a pair at 0.75 shares one of the
#: 42 bands with probability 0.9997, a pair at 0.3 with 0.03.
SLOTS, ROWS = 252, 6

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
_VALUE = _VALUE[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            all_of = np.full(size, base, np.uint64)
            all_of[0] = 1
            _powers[k] = np.multiply.accumulate(all_of)
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first] = inside[first]
    ends[last] = inside[last]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    power, inverse = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[end + 1] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * U64(0xA24BAED4963EE407))
    return hashes, np.diff(np.searchsorted(begin, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, end to end, and their offsets."""
    hashes, counts = words(data, offsets)
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    prime = U64(0x9FB21C651E98DF25)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size if len(rolled) else 0):
        rolled = rolled * prime + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    found, ends = [], np.zeros(len(counts) + 1, np.int64)
    for i, n in enumerate(counts.tolist()):
        a = int(at[i])
        if n >= size:
            found.append(np.unique(rolled[a : a + n - size + 1]))
        elif n:
            few = np.zeros(1, np.uint64)
            for h in hashes[a : a + n]:
                few = few * prime + h
            found.append(mix(few + U64(n)))
        ends[i + 1] = ends[i] + (len(found[-1]) if n else 0)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), ends


def signatures(prints: np.ndarray, ends: np.ndarray, slots: int = SLOTS, chunk: int = 1 << 16) -> np.ndarray:
    """One row of ``slots`` values for each set; all ones for an empty set."""
    out = np.full((len(ends) - 1, slots), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + chunk, "right")) - 1)
        _fill(out[at:to], prints[ends[at] : ends[to]], np.diff(ends[at : to + 1]))
        at = to
    return out


def _fill(out: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> None:
    slots = out.shape[1]
    owner = np.repeat(np.arange(len(counts)), counts)
    order = None
    for j in range(slots):
        if j:
            todo = (out >= U64(j << 32)).any(axis=1)
            keep = todo[owner]
            if not keep.any():
                return
            if order is None:  # the permutations, with the swap of step 0
                prints, owner, place = prints[keep], owner[keep], place[keep]
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(prints), 1))
                order[np.arange(len(prints)), place] = 0
                order[:, 0] = place
            elif not keep.all():
                prints, owner, order = prints[keep], owner[keep], order[keep]
        seed = mix(prints + U64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        place = j + ((seed >> U64(32)) * U64(slots - j) >> U64(32)).astype(np.int64)
        if j:
            row = np.arange(len(prints))
            slot = order[row, place].astype(np.int64)
            order[row, place] = order[:, j]
            order[:, j] = slot
        else:
            slot = place
        np.minimum.at(out.reshape(-1), owner * slots + slot, (seed & U64(0xFFFFFFFF)) | U64(j << 32))


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, slots = signature.shape
    parts = signature.reshape(n, slots // rows, rows)
    key = np.broadcast_to(np.arange(slots // rows, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * U64(0x9FB21C651E98DF25) + parts[:, :, k])
    return key.view(np.int64)


def _describe(slots: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = joined(part.column(1))
            prints, ends = shingle_sets(data, offsets)
            sizes = np.diff(ends)
            signature = signatures(prints, ends, slots)
            keys = bands(signature, rows)
            totals = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(prints + U64(s)))]) for s in (0x1234567, 0x89ABCDEF01)]
            one, two = ((t[ends[1:]] - t[ends[:-1]]).view(np.int64) for t in totals)
            full = sizes > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * keys.shape[1])]).astype(np.int32)), pa.array(keys[full].reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(one), pa.array(two), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    return run


def _sets(passes: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch.filter(pa.array(passes(batch.column(2).to_numpy())))])):
                prints, ends = shingle_sets(*joined(part.column(1)))
                raw = prints.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["doc_id", "prints"])

    return run


def _entries(passes: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).flatten()
            good = passes(keys.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())[good]
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(good)), batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner))], names=["bucket", "rep", "n_shingles"])

    return run


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of the sorted ``y`` whether the sorted ``x`` has it."""
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return x[at] == y


def _mask(bits: np.ndarray) -> np.ndarray:
    """Bits as longs, the first one lowest."""
    padded = np.zeros(-(-len(bits) // 64) * 64, bool)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.int64)


_TESTED = "src long, dst long, linked boolean, common long, src_reach long, dst_reach long, src_mask array<long>, dst_mask array<long>"


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, a_reach, b_reach, one, two = batch.columns
            kept, common, of_one, of_two = [], [], [], []
            for x, y in zip(one, two, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                in_x, in_y = _within(y, x), _within(x, y)
                shared = int(in_x.sum())
                common.append(shared)
                kept.append(100 * shared >= percent * (len(x) + len(y) - shared))
                of_one.append(_mask(in_x))
                of_two.append(_mask(in_y))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [a, b, pa.array(kept, pa.bool_()), pa.array(common, pa.int64()), a_reach, b_reach, pa.array(of_one, longs), pa.array(of_two, longs)],
                names=["src", "dst", "linked", "common", "src_reach", "dst_reach", "src_mask", "dst_mask"],
            )

    return run


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, slots: int = SLOTS, rows: int = ROWS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each input row.

    Null or empty text, and text without words: ``n_shingles`` 0, a component
    of its own, kept.  Rows that repeat an id are one document to the grouping
    and a row each in the result; a null id is never linked and is kept.  Other
    columns, whatever their names, are not read.  No rows give no rows.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = scratch.table(source.mapInArrow(tidy(_describe(slots, rows)), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "described")
    seen = described.drop("bands")
    key = ["n_shingles", "set_a", "set_b"]
    with_words = seen.where("n_shingles > 0 and doc_id is not null")
    one_each = described.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"))
    classes = scratch.table(one_each, "classes")
    # A bucket with a single class can link nothing.
    counts = scratch.table(classes.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    entries = classes.select("rep", "bands", "n_shingles").mapInArrow(tidy(_entries(sieve(counts, F.col("bucket")))), "bucket long, rep long, n_shingles long")
    shared = scratch.table(entries.join(counts, "bucket"), "shared")
    reach = scratch.table(shared.groupBy("rep").agg(F.sum("n").alias("reach")), "reach")
    buckets = scratch.table(shared.join(reach, "rep"), "buckets")
    needed = sieve(reach, F.xxhash64("rep"))
    full = source.select("doc_id", "text", F.xxhash64("doc_id").alias("hash")).mapInArrow(tidy(_sets(needed)), "doc_id long, prints binary")
    sets = scratch.table(full.join(reach.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "sets")
    for done in ("counts", "shared", "reach"):
        scratch.drop(done)
    links = _resolve(scratch, buckets, sets, percent)
    # Same id under two sets: one document.
    twice = with_words.select(F.col("doc_id").alias("src"), *key).join(classes.select(*key, F.col("rep").alias("dst")), key)
    groups = connected_components(links, scratch=scratch)
    repeated = with_words.groupBy("doc_id").agg(F.countDistinct(*key).alias("n")).where("n > 1").select(F.col("doc_id").alias("src"))
    if not repeated.isEmpty():
        groups = connected_components(links.unionByName(twice.join(repeated, "src", "left_semi").select("src", "dst")), scratch=scratch)
    named = classes.select(*key, "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    return (
        seen.select("doc_id", *key)
        .join(named.select(*key, F.coalesce("component", "rep").alias("component")), key, "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _ranked(own: DataFrame, tested: DataFrame) -> DataFrame:
    """``rep, anchor, inside, anchor_reach, mask``: the most central member that each was tested against, or itself.

    ``mask`` has a bit for each shingle of the anchor, set if the member has it
    too; null if the anchor is the member itself.
    """
    named = lambda one, two: tested.select(F.col(one).alias("rep"), F.col(two).alias("anchor"), F.col("common").alias("inside"), F.col(f"{two}_reach").alias("anchor_reach"), F.col(f"{two}_mask").alias("mask"))
    alone = own.select("rep", F.col("rep").alias("anchor"), F.col("n_shingles").alias("inside"), F.col("reach").alias("anchor_reach"), F.lit(None).cast("array<long>").alias("mask"))
    best = F.max(F.struct("anchor_reach", "anchor", "inside", "mask")).alias("b")
    # Joined by the member, not by the anchor that thousands may share.
    ways = named("src", "dst").unionByName(named("dst", "src")).join(own.select("rep"), "rep", "left_semi")
    return ways.unionByName(alone).groupBy("rep").agg(best).select("rep", "b.anchor", "b.inside", "b.anchor_reach", "b.mask")


def _toward_hubs(members: DataFrame, ranked: DataFrame) -> DataFrame:
    """Pairs of each member and the most central anchor of those it shares a bucket with, so that a group's members get one anchor."""
    placed = members.select("bucket", "rep", "reach").join(ranked.select("rep", "anchor", "anchor_reach"), "rep")
    hubs = placed.groupBy("bucket").agg(F.max(F.struct("anchor_reach", "anchor")).alias("h"))
    best = placed.select("bucket", "rep", "reach").join(hubs, "bucket").groupBy("rep", "reach").agg(F.max("h").alias("h"))
    return best.select("rep", "reach", F.col("h.anchor").alias("c_rep"), F.col("h.anchor_reach").alias("c_reach")).where("rep != c_rep")


def _anchored(own: DataFrame, ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """``rep, anchor, inside, mask, spare, known``: what bounds the size of an intersection without looking at it.

    ``inside`` counts the shingles that a member and its anchor both have,
    ``known`` those that another set has as well.  Of the shingles that the
    anchor lacks only ``spare`` are known.  Two members share at most the lesser
    ``known``, and with one anchor at most what their masks share plus the
    lesser ``spare``.  ``sets`` holds the members' sets and their anchors'.
    """
    prints = sets.mapInArrow(tidy(_each_print), "print long, doc_id long")
    alone = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep")).where("n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
    known = F.col("n_shingles") - F.coalesce("alone", F.lit(0))
    spare = F.when(F.col("anchor") == F.col("rep"), 0).otherwise(known - F.col("inside"))
    return own.join(ranked, "rep").join(alone, "rep", "left").select("rep", "anchor", "inside", "mask", spare.alias("spare"), known.alias("known"))


def _each_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("prints"))
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
        for at in range(0, len(ids), 256):
            raw = [np.frombuffer(x.as_buffer(), np.int64) for x in column[at : at + 256]]
            owner = np.repeat(ids[at : at + 256], [len(x) for x in raw])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(raw)), pa.array(owner)], names=["print", "doc_id"])


def _among(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of ``ids``, and perhaps a few others."""
    return sets.withColumn("hash", F.xxhash64("doc_id")).mapInArrow(tidy(sifted(sieve(ids, F.xxhash64("doc_id")))), "doc_id long, prints binary")


def _test(scratch: Scratch, pairs: DataFrame, sets: DataFrame, before: DataFrame | None, percent: int, name: str) -> DataFrame:
    """``src, dst, linked, common, src_reach, dst_reach`` of ``before`` and of each other pair ``rep, reach, c_rep, c_reach``, from the full sets."""
    swap = F.col("rep") > F.col("c_rep")
    way = lambda one, two, to: F.when(swap, F.col(two)).otherwise(F.col(one)).alias(to)
    pairs = pairs.select(way("rep", "c_rep", "src"), way("c_rep", "rep", "dst"), way("reach", "c_reach", "src_reach"), way("c_reach", "reach", "dst_reach")).distinct()
    if before is not None:
        pairs = pairs.join(before.select("src", "dst"), ["src", "dst"], "left_anti")
    pairs = scratch.table(pairs, f"pairs_{name}")
    if before is not None:  # few sets take part
        sets = _among(sets, pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")))
    full = (
        pairs.join(sets.select(F.col("doc_id").alias("src"), F.col("prints").alias("one")), "src")
        .join(sets.select(F.col("doc_id").alias("dst"), F.col("prints").alias("two")), "dst")
        .select("src", "dst", "src_reach", "dst_reach", "one", "two")
    )
    now = full.mapInArrow(tidy(_links(percent)), _TESTED)
    out = scratch.table(now if before is None else before.unionByName(now), f"tested_{name}")
    scratch.drop(f"pairs_{name}")
    return out


#: Rounds in which a bucket has one centre; members of a bucket that one task pairs up in the last round.
CENTRES, BLOCK = 2, 1024


def _able(scratch: Scratch, members: DataFrame, percent: int) -> DataFrame:
    """Those of ``members`` whose known shingles may suffice for a link within their bucket, with ``n``, how many are left there."""
    # Linked sets have a size of at least the similarity times the larger one's.
    least = members.groupBy("bucket").agg(F.min("n_shingles").alias("least"))
    other = F.greatest(F.col("least"), F.col("n_shingles") * percent / 100)
    enough = F.col("known") * (100 + percent) >= (F.col("n_shingles") + other) * percent
    left = scratch.table(members.join(least, "bucket").where(enough).drop("least"), "left")
    mixed = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket", "n")
    return scratch.table(left.join(mixed, "bucket"), "able")


def _cells(members: DataFrame, block: int, *, rows: bool) -> DataFrame:
    """``members`` with ``own`` and ``cell``: a bucket's members in blocks, and blocks in pairs, so that any two members meet in one cell."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    placed = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # A block meets itself and, as the row or as the column, each other block once.
    low, high = (F.col("own"), F.col("other")) if rows else (F.col("other"), F.col("own"))
    return placed.where(low <= high).withColumn("cell", low * blocks + high).drop("other")


def _resolve(scratch: Scratch, buckets: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links that join, directly or not, all pairs of a bucket that have the similarity."""
    tested = used = None
    members = buckets.withColumn("component", F.col("rep"))
    for k in range(CENTRES + 1):
        if k:
            groups = scratch.table(connected_components(tested.where("linked").select("src", "dst"), scratch=scratch), f"groups_{k}").withColumnRenamed("node", "rep")
            members = buckets.join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
            mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
            members = scratch.table(members.join(mixed, "bucket", "left_semi"), f"members_{k}")
            # Only what is in such a bucket is looked at again, and what it was tested against.
            own = scratch.table(members.groupBy("rep").agg(F.max("reach").alias("reach"), F.max("n_shingles").alias("n_shingles")), f"own_{k}")
            ranked = scratch.table(_ranked(own, tested), f"ranked_{k}")
            used_sets = scratch.table(own.select("rep").unionByName(ranked.select(F.col("anchor").alias("rep"))).distinct().select(F.col("rep").alias("doc_id")), f"used_{k}")
            sets = scratch.table(_among(sets, used_sets).join(used_sets, "doc_id", "left_semi"), f"sets_{k}")
            scratch.drop("sets" if k == 1 else f"sets_{k - 1}")
        if k == CENTRES:
            tested = _test(scratch, _toward_hubs(members, ranked), sets, tested, percent, "hubs")
            about = scratch.table(_anchored(own, _ranked(own, tested), sets), "about")
            members = _able(scratch, members.drop("n").join(about, "rep"), percent)
            sides = _cells(members, block, rows=True), _cells(members, block, rows=False)
            on = ["bucket", "cell"]
        else:
            fresh = members.join(used, ["bucket", "rep"], "left_anti") if used is not None else members
            best = F.max(F.struct("reach", (-F.col("rep")).alias("order"), "rep", "n_shingles", "component")).alias("c")
            centres = scratch.table(fresh.groupBy("bucket").agg(best).select("bucket", "c.rep", "c.n_shingles", "c.component", "c.reach"), f"centres_{k}")
            used = centres.select("bucket", "rep")
            sides, on = (members, centres), ["bucket"]
        chosen = sides[1].select(*on, *[F.col(c).alias(f"c_{c}") for c in sides[1].columns if c not in on])
        # Sizes too far apart can't reach the similarity.
        apart = sides[0].join(chosen, on).where("component != c_component").where(
            F.least("n_shingles", "c_n_shingles") * 100 >= F.greatest("n_shingles", "c_n_shingles") * percent
        )
        if k == CENTRES:
            # Nor can intersections that an exact bound keeps too small: shingles that only one member has are in none, and a common anchor bounds the rest.
            enough = lambda most: most * (100 + percent) >= (F.col("n_shingles") + F.col("c_n_shingles")) * percent
            spare, other = F.least("spare", "c_spare"), F.col("anchor") != F.col("c_anchor")
            masks = F.aggregate(F.zip_with("mask", "c_mask", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda a, b: a + b)
            apart = apart.where((F.col("own") != F.col("c_own")) | (F.col("rep") < F.col("c_rep")))
            apart = apart.where(enough(F.least("known", "c_known"))).where(other | enough(F.least("inside", "c_inside") + spare)).where(other | enough(F.coalesce(masks, F.least("inside", "c_inside")) + spare))
        tested = _test(scratch, apart.select("rep", "reach", "c_rep", "c_reach"), sets, tested, percent, f"{k}")
    return tested.where("linked").select("src", "dst")
