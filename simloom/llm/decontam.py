"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

Texts are lower-cased and every run of characters that are no letters or digits
becomes one space.  A benchmark item is covered by short windows at a small
stride; a document leaks a window if some stretch of it is within the edit
budget, which a replaced word fits.  An unedited passage of ``window + stride -
1`` characters, 53 as set here, holds a whole window wherever it starts.

Edits of ``e`` characters in ``p`` places destroy at most ``e + p * (q - 1)`` of
a window's ``m + 1 - q`` q-grams; those left are on diagonals (document position
less item position) at most ``e`` apart.  Shared q-grams are therefore counted
in bands of diagonals ``2 * (e + 1)`` wide that overlap by half, so that each
such stretch lies wholly in one band; windows that reach the bound in a band are
verified by an alignment confined to it.  The bound allows for edits in up to
four places of a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrays import U64, joined, kept, mix, slices, tidy

Q, WINDOW, STRIDE, BUDGET, PLACES = 8, 50, 4, 0.12, 4
#: Text bytes worked on and pairs of equal q-grams counted at once.
SLICE_BYTES, BLOCK_PAIRS = 1 << 18, 1 << 17
#: Normalised characters of benchmark items that one pass holds; a larger
#: benchmark takes more passes over the documents.
PASS_CHARS = 4_000_000
_SPACE = 32


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point its lower case if it is a letter or digit, else a space."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of UTF-8 texts end to end, their offsets, and each one's place in its own text."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[offsets]
    folded = _folded()[points]
    keep = folded != _SPACE
    first = np.ones(len(keep), bool)
    first[1:] = keep[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = False  # no leading space
    keep |= first
    places = np.flatnonzero(keep)
    ends = np.searchsorted(places, at)
    return folded[places], ends, places - np.repeat(at[:-1], np.diff(ends))


def _grams(chars: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(max(0, len(chars) - q + 1), np.uint64)
    for k in range(q if len(out) else 0):
        out *= U64(0x9E3779B97F4A7C15)
        out += chars[k : k + len(out)]
    return mix(out)


class Windows:
    """The windows of benchmark items and the postings of the items' q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int, window: int, budget: float, stride: int = STRIDE) -> None:
        self.q = q
        texts, owner, starts, sizes = [], [], [], []
        base = 0
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            folded = normalised(raw, np.array([0, len(raw)]))[0]
            folded = folded[: len(folded) - 1] if len(folded) and folded[-1] == _SPACE else folded
            n = len(folded)
            if n < q:
                continue
            for a in [0] if n <= window else [*range(0, n - window, stride), n - window]:
                owner.append(item)
                starts.append(base + a)
                sizes.append(min(n, window))
            texts.append(folded)
            base += n
        self.text = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        self.owner, self.start, self.size = np.array(owner, np.int64), np.array(starts, np.int64), np.array(sizes, np.int64)
        # An item below a window has no more edits than always leave a shared q-gram.
        self.edits = (self.size * budget).astype(np.int64)
        self.edits = np.where(self.size < window, np.minimum(self.edits, np.maximum(0, (self.size - q) // q)), self.edits)
        self.step = int(self.edits.max()) + 1 if texts else 1
        self.bound = np.maximum(1, self.size + 1 - q - self.edits - (q - 1) * np.minimum(self.edits, PLACES))
        self.last = self.start + self.size - q  # where a window's last q-gram starts
        grams = np.concatenate([_grams(c, q) for c in texts]) if texts else np.zeros(0, np.uint64)
        at = np.concatenate([np.arange(len(c) - q + 1) + k for c, k in zip(texts, np.cumsum([0, *map(len, texts[:-1])]), strict=True)]) if texts else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")
        self.at = at[order]
        self.grams, self.first, self.times = np.unique(grams[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.grams >> U64(42)).astype(np.int64)] = True

    def candidates(self, chars: np.ndarray, ends: np.ndarray, pairs: int = BLOCK_PAIRS) -> Iterator[np.ndarray]:
        """Blocks of rows (text, window, lowest diagonal of the band, a hit's diagonal) that reach the bound; diagonals count from the window's start.

        A block has about ``pairs`` pairs of equal q-grams, and more only if a
        single stretch of text has; blocks overlap by what a leak can span, so
        repetitive texts and items take more blocks, not more memory.
        """
        grams = _grams(chars, self.q)
        hit = np.flatnonzero(self.filter[(grams >> U64(42)).astype(np.int64)])
        where = np.searchsorted(self.grams, grams[hit])
        where[where == len(self.grams)] = 0
        same = self.grams[where] == grams[hit] if len(self.grams) else np.zeros(0, bool)
        hit, where = hit[same], where[same]
        if not len(hit):
            return
        total = np.cumsum(self.times[where])
        span = int(self.size.max() + self.edits.max())
        begin = 0
        while begin < len(hit):
            end = max(int(np.searchsorted(total, (total[begin - 1] if begin else 0) + pairs, "right")), int(np.searchsorted(hit, hit[begin] + 2 * span, "right")))
            yield self._in_bands(hit[begin:end], where[begin:end], ends)
            if end >= len(hit):
                return
            begin = max(begin + 1, int(np.searchsorted(hit, hit[end] - span)))

    def _in_bands(self, hit: np.ndarray, where: np.ndarray, ends: np.ndarray) -> np.ndarray:
        times = self.times[where]
        post = np.repeat(self.first[where] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        position, at = np.repeat(hit, times), self.at[post]
        text = np.searchsorted(ends, position, "right") - 1
        diagonal = position - at
        band = diagonal // self.step  # counts in this band and in the one below
        low = int(band.min()) - 1
        run = text * (int(band.max()) - low + 1) + band - low
        run, at, diagonal = np.concatenate([run, run - 1]), np.tile(at, 2), np.tile(diagonal, 2)
        lowest = np.concatenate([band, band - 1]) * self.step
        text = np.tile(text, 2)
        order = np.unique(run * len(self.text) + at, return_index=True)[1]  # a q-gram of the item counts once
        run, at, diagonal, lowest, text = run[order], at[order], diagonal[order], lowest[order], text[order]
        out = []
        for bound in np.unique(self.bound).tolist():
            # Hits in a row, as many as the bound, and the windows that hold them all.
            head = np.arange(len(run) - bound + 1)
            head = head[run[head] == run[head + bound - 1]]
            head = head[at[head + bound - 1] - at[head] < self.size.max()]
            a, b = np.searchsorted(self.last, at[head + bound - 1], "left"), np.searchsorted(self.start, at[head], "right")
            n = np.maximum(0, b - a)
            head, a, n = head[n > 0], a[n > 0], n[n > 0]
            window = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            head = np.repeat(head, n)
            good = self.bound[window] == bound
            head, window = head[good], window[good]
            first = np.unique(run[head] * len(self.size) + window, return_index=True)[1]
            head, window = head[first], window[first]
            out.append(np.stack([text[head], window, lowest[head] + self.start[window], diagonal[head] + self.start[window]], 1))
        return np.concatenate(out)

    def verify(self, chars: np.ndarray, ends: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each candidate, and where the best stretch begins and ends."""
        edits, begin, end = np.full(len(found), 1 << 20), np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        sizes, budgets = self.size[found[:, 1]], self.edits[found[:, 1]].copy()
        for m in np.unique(sizes).tolist():  # unedited copies need no alignment
            for which in np.array_split(of := np.flatnonzero(sizes == m), len(of) // 8192 + 1):
                a = found[which, 3]
                fits = (a >= ends[found[which, 0]]) & (a + m <= ends[found[which, 0] + 1])
                which, a = which[fits], a[fits]
                if not len(which):
                    continue
                equal = (chars[a[:, None] + np.arange(m)] == self.text[self.start[found[which, 1]][:, None] + np.arange(m)]).all(1)
                which, a = which[equal], a[equal]
                edits[which], begin[which], end[which], budgets[which] = 0, a, a + m, -1
        for m, e in {(int(a), int(b)) for a, b in zip(sizes, budgets, strict=True) if b >= 0}:
            which = np.flatnonzero((sizes == m) & (budgets == e))
            for a in range(0, len(which), 512):
                of = which[a : a + 512]
                edits[of], begin[of], end[of] = self._align(chars, ends, found[of], m, e)
        return edits, begin, end

    def _align(self, chars: np.ndarray, ends: np.ndarray, found: np.ndarray, m: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Cell k of row i is window prefix i against the text up to low + i + k;
        # it holds edits << bits | the cell that the stretch begins in.
        low, wide = found[:, 2] - e, 2 * self.step + 2 * e
        a, b = ends[found[:, 0]], ends[found[:, 0] + 1]
        bits = wide.bit_length()
        one, far = np.int32(1 << bits), np.int32(1 << 28)
        at = low + np.arange(m + wide)[:, None]
        text = chars[np.clip(at, 0, max(0, len(chars) - 1))]
        outside = np.where((at >= a) & (at < b), np.int32(0), far)
        pattern = self.text[self.start[found[:, 1]] + np.arange(m)[:, None]]
        cells = np.arange(wide, dtype=np.int32)[:, None]
        cost = np.where((at[:wide] >= a) & (at[:wide] <= b), cells, far)
        for i in range(m):
            step = (text[i : i + wide] != pattern[i]) * one
            step += outside[i : i + wide]
            step += cost
            np.minimum(step[:-1], cost[1:] + one, out=step[:-1])
            step -= cells * one
            np.minimum.accumulate(step, axis=0, out=step)  # text characters that the window lacks
            step += cells * one
            cost = np.minimum(step, far, out=step)
        cost[low + m + cells > b] = far
        best = cost.argmin(0)
        least = cost[best, np.arange(len(found))]
        return least >> bits, low + (least & (one - 1)), low + m + best


def _scan(items: list[tuple[int, str]], q: int, window: int, budget: float, stride: int):
    digest = hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest()
    # Items below a q-gram are leaked by texts that are nothing else.
    short: dict[str, list[int]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        folded = normalised(raw, np.array([0, len(raw)]))[0]
        plain = folded.tobytes().decode("utf-32-le").strip()
        if 0 < len(plain) < q:
            short.setdefault(plain, []).append(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept(("windows", digest, q, window, budget, stride), lambda: Windows(items, q, window, budget, stride))
        owners, windows = np.unique(index.owner, return_counts=True)
        total = dict(zip(owners.tolist(), windows.tolist(), strict=True))
        for part in slices(batches, limit=SLICE_BYTES):
            chars, ends, places = normalised(*joined(part.column(1)))
            rows: dict[tuple[int, int], list] = {}
            for found in index.candidates(chars, ends):
                edits, begin, end = index.verify(chars, ends, found)
                good = (edits <= index.edits[found[:, 1]]) & (end > begin)
                for (text, w, *_), n, a, b in zip(found[good].tolist(), edits[good].tolist(), begin[good].tolist(), end[good].tolist(), strict=True):
                    a, b = int(places[a]), int(places[b - 1]) + 1
                    row = rows.setdefault((text, int(index.owner[w])), [a, b, n, set()])
                    row[0], row[1], row[2] = min(a, row[0]), max(b, row[1]), min(n, row[2])
                    row[3].add(w)
            if short:
                for text in np.flatnonzero((np.diff(ends) > 0) & (np.diff(ends) <= q)).tolist():
                    of = chars[ends[text] : ends[text + 1]]
                    for item in short.get(of.tobytes().decode("utf-32-le").strip(), ()):
                        letters = places[ends[text] : ends[text + 1]][of != _SPACE]
                        rows[text, item] = [int(letters[0]), int(letters[-1]) + 1, 0, {0}]
                        total[item] = 1
            ids = part.column(0)
            found_rows = sorted(rows.items())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[t].as_py() for (t, _), _ in found_rows], pa.int64()),
                    pa.array([i for (_, i), _ in found_rows], pa.int64()),
                    pa.array([r[0] for _, r in found_rows], pa.int64()),
                    pa.array([r[1] for _, r in found_rows], pa.int64()),
                    pa.array([r[2] for _, r in found_rows], pa.int64()),
                    pa.array([len(r[3]) / float(total[i]) for (_, i), r in found_rows], pa.float64()),
                ],
                names=["doc_id", "item_id", "start", "end", "edits", "coverage"],
            )

    return run


def _passes(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(f"{text_col} is not null")
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((-1 if item is None else item, text))
        size += len(text)
    if block:
        yield block


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    q: int = Q,
    window: int = WINDOW,
    budget: float = BUDGET,
    stride: int = STRIDE,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """``doc_id, item_id, start, end, edits, coverage``: one row for each document and item it leaks.

    ``start`` and ``end`` (code points, end exclusive) bound all leaked windows,
    ``edits`` is the least of them, ``coverage`` the share of the item's windows
    found.  Documents without a leak have no row; null and empty texts have
    none; a repeated row gets its rows again; an item of fewer than ``q`` letters
    and digits is leaked only by a text that is nothing else, one without any,
    or null, by none; an item without id is item -1; no items, no rows.  Other
    columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits long, coverage double"
    out = None
    for items in _passes(benchmark, item_col, item_text_col, pass_chars):
        now = source.mapInArrow(tidy(_scan(items, q, window, budget, stride), keeps=True), schema)
        out = now if out is None else out.unionByName(now)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
