"""Statistics of the Euclidean distances of all pairs that are tallied where the distances are made.

A pass goes over the block grid of ``kernels``: a task makes squared distances
tile by tile and keeps a tally, counts or sums of fixed size, and only tallies
leave it.  Order statistics are exact: a pass counts the bits of the squared
distances in an interval that holds a wanted rank, the next one in the
narrower interval found, and the last one brings the few numbers left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.operators import kernels
from simloom.operators.orderstats import FEW, quantiles

#: Items of a block, and rows of one whose distances to another are made at once.
BLOCK, ROWS = 1024, 64
#: Parts of an interval of bits.  The first pass has steps of 2^-10 of a number, and one part for all numbers far below the greatest.
PARTS, FIRST = 1 << 15, 42
#: Numbers beyond this are left to the pair tables.
MOST = 1e140


class Tally(Protocol):
    def add(self, squared: list[np.ndarray]) -> None:
        """Takes squared distances of some pairs, one array for each part of the vectors."""

    def rows(self) -> dict[str, np.ndarray]:
        """Columns to send."""


def plain(items: DataFrame) -> bool:
    """Whether all ids and numbers of ``id, v`` are there and their squares finite; else pairs are left out or NaN, as pair tables have them."""
    odd = F.col("id").isNull() | F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > MOST))
    return not items.agg(F.coalesce(F.sum(odd.cast("int")), F.lit(0))).first()[0]


def tallied(items: DataFrame, start: Callable[[], Tally], schema: str, *, cuts: Sequence[int] = (), block: int = BLOCK) -> DataFrame:
    """The rows of each task's tally over all pairs of ``items`` (``id, v``); vectors are cut before the places ``cuts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, any_pair = start(), False
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].as_py() for c in (0, 1))
                ids, jds = (batch.column(c)[k].values.to_numpy() for c in (2, 4))
                xs = np.split(kernels._rows(batch.column(3), k, len(ids)), cuts, 1)
                ys = np.split(kernels._rows(batch.column(5), k, len(jds)), cuts, 1)
                for at in range(0, len(ids), ROWS):
                    found = [kernels.squares(x[at : at + ROWS], y) for x, y in zip(xs, ys, strict=True)]
                    once = ids[at : at + ROWS, None] < jds[None] if a == b else slice(None)
                    found = [d[once].reshape(-1) for d in found]
                    if len(found[0]):
                        any_pair = True
                        tally.add(found)
        if any_pair:
            yield pa.RecordBatch.from_pydict(tally.rows())

    return kernels._grid(items, block).mapInArrow(run, schema)


class _Bits:
    """Counts of bits by parts of the intervals ``low, high, shift``; numbers below the first part of a pass from 0 count with it."""

    def __init__(self, intervals: list[tuple[int, int, int]], first: bool) -> None:
        self.intervals, self.first = intervals, first
        self.n = np.zeros((len(intervals), PARTS + 1), np.int64)

    def add(self, squared: list[np.ndarray]) -> None:
        bits = squared[0].view(np.int64)
        for own, (low, high, shift) in zip(self.n, self.intervals, strict=True):
            near = np.maximum(bits, low) if self.first else bits[(bits >= low) & (bits < high)]
            if len(near):
                near -= low
                near >>= shift
                own += np.bincount(near, minlength=PARTS + 1)

    def rows(self) -> dict[str, np.ndarray]:
        k, part = np.nonzero(self.n)
        return {"k": k, "part": part, "n": self.n[k, part]}


class _Picked:
    def __init__(self, intervals: list[tuple[int, int, int]]) -> None:
        self.intervals, self.found = intervals, []

    def add(self, squared: list[np.ndarray]) -> None:
        bits = squared[0].view(np.int64)
        self.found += [(np.full(len(near), k), near) for k, (low, high, _) in enumerate(self.intervals) if len(near := bits[(bits >= low) & (bits < high)])]

    def rows(self) -> dict[str, np.ndarray]:
        k, bits = (np.concatenate(c) for c in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 2
        return {"k": k, "bits": bits}


def distance_quantiles(items: DataFrame, shares: Sequence[float], *, times: int = 1, zeros: int = 0, block: int = BLOCK) -> list[float | None]:
    """Interpolated quantiles of the distances of all pairs of ``items``, as Spark's ``percentile``; None without pairs.

    Each distance counts ``times``, and there are ``zeros`` more.  Only for
    ``plain`` items.
    """
    longest = items.agg(F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))).first()[0] or 0.0
    top = int(np.float64(4.1 * longest + 1e-300).view(np.int64))
    low = max(0, ((top >> FIRST) - PARTS + 2) << FIRST)
    intervals, first = [(low, top + 1, FIRST)], True
    wanted: list[tuple[int, int]] = []  # interval of each rank, and the rank within it
    while True:
        counts = np.zeros((len(intervals), PARTS + 1), np.int64)
        passed, at_first = list(intervals), first
        for r in tallied(items, lambda i=passed, f=at_first: _Bits(i, f), "k long, part long, n long", block=block).groupBy("k", "part").agg(F.sum("n").alias("n")).collect():
            counts[r.k, r.part] = r.n
        if first:
            pairs = int(counts.sum())
            n = times * pairs + zeros
            if not n:
                return [None] * len(shares)
            places = [q * (n - 1) for q in shares]
            ranks = [r for x in places for r in (int(np.floor(x)), min(int(np.floor(x)) + 1, n - 1))]
            if not pairs:
                return [0.0] * len(shares)
            wanted = [(0, max(0, (r - zeros) // times)) for r in ranks]
        narrower: dict[tuple[int, int, int], int] = {}
        for w, (k, rank) in enumerate(wanted):
            low, high, shift = intervals[k]
            below = np.cumsum(counts[k])
            part = int(np.searchsorted(below, rank, "right"))
            start = 0 if first and not part else low + (part << shift)
            end = min(high, low + (part + 1 << shift))
            step = max(0, (end - start - 1).bit_length() - PARTS.bit_length() + 1)
            narrower[start, end, step] = int(counts[k, part])
            wanted[w] = (list(narrower).index((start, end, step)), rank - (int(below[part - 1]) if part else 0))
        intervals, first = list(narrower), False
        if sum(narrower.values()) <= FEW or all(b - a == 1 for a, b, _ in intervals):
            break
    if all(b - a == 1 for a, b, _ in intervals):
        found = [intervals[k][0] for k, _ in wanted]
    else:
        passed = list(intervals)
        few = tallied(items, lambda: _Picked(passed), "k long, bits long", block=block).toArrow()
        k, bits = few.column("k").to_numpy(), few.column("bits").to_numpy()
        each = [np.sort(bits[k == own]) for own in range(len(intervals))]
        found = [int(each[own][rank]) for own, rank in wanted]
    at = [0.0 if r < zeros else float(np.sqrt(np.array([b], np.int64).view(float)[0])) for r, b in zip(ranks, found, strict=True)]
    return [a if a == b else a + (b - a) * (x - np.floor(x)) for x, a, b in zip(places, at[::2], at[1::2], strict=True)]


def quantiles_of(items: DataFrame, shares: Sequence[float], *, times: int = 1, zeros: int = 0) -> list[float | None]:
    """As ``distance_quantiles``, by a column of all distances where items aren't ``plain``."""
    if plain(items):
        return distance_quantiles(items, shares, times=times, zeros=zeros)
    return quantiles(kernels.values(items, "euclidean", kind="distance"), shares, times=times, also={0.0: zeros} if zeros else None)


class _Kernel:
    """Of the Gaussian kernel at each alpha: counts in equal bins, sum, extremes, and how many are near 1 and near 0."""

    def __init__(self, scale: float, alphas: list[float], bins: int) -> None:
        self.scale, self.alphas, self.bins = scale, alphas, bins
        self.n = np.zeros((len(alphas), bins + 1), np.int64)
        self.total, self.high, self.low = np.zeros(len(alphas)), np.zeros(len(alphas), np.int64), np.zeros(len(alphas), np.int64)
        self.least, self.most = np.inf, -np.inf

    def add(self, squared: list[np.ndarray]) -> None:
        e = squared[0] * -self.scale
        self.least, self.most = min(self.least, e.min()), max(self.most, e.max())
        s = np.empty_like(e)
        for k, alpha in enumerate(self.alphas):
            np.multiply(e, 1 / (alpha * alpha), out=s)
            np.maximum(s, -50, out=s)
            np.exp(s, out=s)
            self.total[k] += s.sum()
            if self.bins > 1:
                self.high[k] += np.count_nonzero(s > 0.95)
                self.low[k] += np.count_nonzero(s < 0.05)
                s *= self.bins
                self.n[k] += np.bincount(s.astype(np.int64), minlength=self.bins + 1)
            else:
                self.n[k, 0] += len(s)

    def rows(self) -> dict[str, np.ndarray]:
        self.n[:, self.bins - 1] += self.n[:, self.bins]  # the last bin is closed
        alpha, bins = len(self.alphas), self.bins
        once = lambda x: np.concatenate([x[:, None], np.zeros((alpha, bins - 1), x.dtype)], 1).reshape(-1)
        at = lambda e: np.repeat([np.exp(max(e / (a * a), -50.0)) for a in self.alphas], bins)
        return {"alpha": np.repeat(self.alphas, bins), "b": np.tile(np.arange(bins), alpha), "n": self.n[:, :bins].reshape(-1), "total": once(self.total), "high": once(self.high), "low": once(self.low), "least": at(self.least), "most": at(self.most)}


def kernel_tallies(items: DataFrame, sigma: float, alphas: list[float], bins: int = 1, *, block: int = BLOCK) -> DataFrame:
    """``alpha, b, n, total, high, low, least, most`` of exp(-d^2 / 2 (alpha sigma)^2), the exponent -50 at least.

    Rows are to be summed, or the least and the most taken, by ``alpha``: n
    numbers in each of ``bins`` equal bins of 0 .. 1, and with more than one
    bin how many are above 0.95 and below 0.05.
    """
    scale = 1 / (2 * sigma * sigma)
    return tallied(items, lambda: _Kernel(scale, list(alphas), bins), "alpha double, b long, n long, total double, high long, low long, least double, most double", block=block)


class _Products:
    def __init__(self, x: float, y: float) -> None:
        self.middle, self.sums = (x, y), np.zeros(6)

    def add(self, squared: list[np.ndarray]) -> None:
        x, y = (np.sqrt(d) - m for d, m in zip(squared, self.middle, strict=True))
        self.sums += len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y

    def rows(self) -> dict[str, np.ndarray]:
        return {k: np.array([v]) for k, v in zip(("n", "x", "y", "xx", "yy", "xy"), self.sums, strict=True)}


def distances_correlated(items: DataFrame, cut: int, *, block: int = BLOCK) -> DataFrame:
    """``r, n``: correlation over all pairs of ``items`` of the distances of the first ``cut`` numbers of ``v`` and of the others; only for ``plain`` items."""
    some = np.array([r.v for r in items.select("v").limit(50).collect()], float).reshape(-1, 1 if items.isEmpty() else len(items.first().v))
    x, y = (float(kernels._euclid(v, v).mean()) if len(some) else 0.0 for v in (some[:, :cut], some[:, cut:]))  # any number does; sums about one near the mean keep their digits
    sums = tallied(items, lambda: _Products(x, y), "n double, x double, y double, xx double, yy double, xy double", cuts=[cut], block=block).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    c = F.col
    spread = lambda a, b: F.when(c("n") > 1, c(a + b) - c(a) * c(b) / c("n"))
    apart = spread("x", "x") * spread("y", "y")
    return sums.select(F.when(apart > 0, spread("x", "y") / F.sqrt(apart)).alias("r"), c("n").cast("long").alias("n"))
