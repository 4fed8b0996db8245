"""Exact order statistics of a column without gathering it: selection by the bits of doubles.

The bits of a double, turned so that their order is that of the numbers, are
read 16 at a time from the top.  A pass counts, in each partition, how many
numbers that begin as the wanted ones have each of the 65,536 continuations;
the counts add up, and each wanted rank goes on within one continuation.  After
four passes all bits are known; once few enough numbers begin as the wanted
ones, a last pass brings those.  A pass shuffles and collects at most 65,536
counts a wanted prefix, or ``FEW`` numbers, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIGN = np.uint64(1 << 63)
_PASSES, _BITS = 4, 16
FEW = 1 << 20  # numbers that the driver takes


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; both zeros are one number."""
    bits = (np.asarray(x, float) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | _SIGN)


def number_of(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(float)[0])


def order_statistics(values: DataFrame, ranks: Sequence[int] | Callable[[int], Sequence[int]], *, times: int = 1, also: dict[float, int] | None = None) -> list[float]:
    """The numbers at ``ranks``, from 0, of the only column of ``values``; null and NaN are left out.

    ``ranks`` may be a function of how many numbers there are.  Each number
    counts ``times``, and those of ``also`` as often as they say there.
    ``values`` is read up to four times: a plan that makes it anew costs time,
    a table of it disk.
    """
    numbers = values.select(F.col(values.columns[0]).cast("double").alias("x")).where("x is not null and not isnan(x)")
    more = [(int(ordered_bits(np.array([x]))[0]), n) for x, n in (also or {}).items()]
    prefix, rest = [0], [] if callable(ranks) else list(ranks)
    few = False
    for step in range(_PASSES):
        if few:
            return _picked(numbers, _BITS * step, prefix, rest, times, more)
        shift, wanted = 64 - _BITS * (step + 1), sorted(set(prefix))

        def count(batches: Iterator[pa.RecordBatch], shift=shift, wanted=wanted, step=step) -> Iterator[pa.RecordBatch]:
            sums = {p: np.zeros(1 << _BITS, np.int64) for p in wanted}
            for batch in batches:
                bits = ordered_bits(batch.column(0).to_numpy())
                head = bits >> np.uint64(shift + _BITS) if step else np.zeros(len(bits), np.uint64)
                part = (bits >> np.uint64(shift) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
                for p in wanted:
                    sums[p] += np.bincount(part[head == np.uint64(p)], minlength=1 << _BITS)
            for p, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), wanted.index(p))), pa.array(at), pa.array(n[at])], names=["prefix", "part", "n"])

        counted = {p: np.zeros(1 << _BITS, np.int64) for p in wanted}
        for r in numbers.mapInArrow(count, "prefix long, part long, n long").groupBy("prefix", "part").agg(F.sum("n").alias("n")).collect():
            counted[wanted[r.prefix]][r.part] += times * r.n
        for bits, n in more:
            if bits >> shift + _BITS in counted:
                counted[bits >> shift + _BITS][bits >> shift & (1 << _BITS) - 1] += n
        if step == 0:
            if callable(ranks):
                rest = list(ranks(int(counted[0].sum())))
            prefix = [0] * len(rest)
        sizes: dict[int, int] = {}
        for k, rank in enumerate(rest):
            below = np.cumsum(counted[prefix[k]])
            if rank < 0 or rank >= below[-1]:
                raise ValueError("no such rank")
            part = int(np.searchsorted(below, rank, "right"))
            rest[k] = rank - (int(below[part - 1]) if part else 0)
            sizes[prefix[k] << _BITS | part] = int(counted[prefix[k]][part])
            prefix[k] = prefix[k] << _BITS | part
        few = sum(sizes.values()) <= FEW
    return [number_of(p) for p in prefix]


def _picked(numbers: DataFrame, known: int, prefix: list[int], rest: list[int], times: int, more: list[tuple[int, int]]) -> list[float]:
    """The numbers at ``rest`` among those that begin with ``prefix``, ``known`` bits long."""
    wanted, shift = np.array(sorted(set(prefix)), np.uint64), np.uint64(64 - known)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = ordered_bits(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bits[np.isin(bits >> shift, wanted)].view(np.int64))], names=["bits"])

    found = numbers.mapInArrow(pick, "bits long").toArrow().column("bits").to_numpy().view(np.uint64)
    bits = np.sort(np.r_[np.repeat(found, times), np.array([b for b, n in more for _ in range(n) if b >> int(shift) in set(prefix)], np.uint64)])
    head = bits >> shift
    return [number_of(int(bits[int(np.searchsorted(head, np.uint64(p))) + rank])) for p, rank in zip(prefix, rest, strict=True)]


def quantiles(values: DataFrame, shares: Sequence[float], *, times: int = 1, also: dict[float, int] | None = None) -> list[float | None]:
    """Interpolated quantiles, as Spark's ``percentile``; None without numbers."""
    sizes = []

    def ranks(n: int) -> list[int]:
        sizes.append(n)
        low = [int(np.floor(q * (n - 1))) for q in shares] if n else []
        return [*low, *(min(k + 1, n - 1) for k in low)]

    found = order_statistics(values, ranks, times=times, also=also)
    if not found:
        return [None] * len(shares)
    at = [q * (sizes[0] - 1) for q in shares]
    return [a if a == b else a + (b - a) * (x - np.floor(x)) for x, a, b in zip(at, found[: len(at)], found[len(at) :], strict=True)]
