"""A filter of fixed size for the keys of one table, applied where another is read.

A join of a wide table with few keys would shuffle all of the wide rows.  A
sieve is one bit for each hash of a key: rows whose bit is not set have no
partner and stay where they are, the others go on to the exact join.  It never
loses a row, and its size is bounded: beyond ``MOST_BITS / 16`` keys it only
lets more rows through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB, in chunks of 32 KB that one task fills.
MOST_BITS, CHUNK_BITS = 1 << 26, 1 << 18


def sieve(keys: DataFrame, hashed: Column, *, most_bits: int = MOST_BITS) -> Callable[[np.ndarray], np.ndarray]:
    """A function that says of each 64-bit hash whether it may be one of ``hashed``; a null key is none."""
    source = keys.select(hashed.cast("long").alias("hash")).where("hash is not null")
    size = min(most_bits, max(1 << 15, 1 << (16 * source.count()).bit_length()))
    chunk = min(size, CHUNK_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column(0).to_numpy()
            for k in np.unique(place // chunk).tolist():
                part = parts.setdefault(k, np.zeros(chunk, bool))
                part[place[place // chunk == k] % chunk] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.packbits(x).tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])

    place = source.select(F.expr(f"hash & {size - 1}L").alias("place"))
    # All rows together are ``size`` bits.
    rows = place.repartition(min(64, size // chunk), F.expr(f"place div {chunk}")).mapInArrow(fill, "part long, bits binary").collect()
    bits = np.zeros(size // 8, np.uint8)
    for part, filled in rows:
        bits[part * (chunk // 8) : (part + 1) * (chunk // 8)] = np.frombuffer(filled, np.uint8)

    def passes(hashes: np.ndarray) -> np.ndarray:
        place = hashes.view(np.uint64) & np.uint64(size - 1)
        return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7))).astype(np.uint8) & 1).astype(bool)

    return passes


def sifted(passes: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """For ``mapInArrow``: the rows whose last column, a hash, may be a key's; without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            good = passes(batch.column(last).to_numpy())
            if good.any():
                yield batch.filter(pa.array(good)).select(list(range(last)))

    return run
