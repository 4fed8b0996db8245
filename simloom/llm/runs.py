"""Periodic runs of words, by Lyndon arrays with reuse of matched extensions.

A run is a stretch of words that has a period of at most half its length and
that no neighbouring word extends.  Each run begins its repetition with a root
that is a Lyndon word, longest from its place on, under the order of the
alphabet or the reverse one; so the next smaller suffix ``j`` of each place
``i`` under both orders gives all candidate periods ``j - i`` (Bannai et al.,
2017), and how far the places ``i`` and ``j`` agree to the right and to the left
says whether a candidate is a run.

The array of next smaller suffixes is computed after Ellert and Fischer (2021):
the suffixes that still wait for a smaller one lie on a stack with the lengths
on which neighbours agree, so most comparisons follow from known lengths; and
the match that reaches furthest to the right is kept, so a comparison inside of
it, to either side, copies the length found at the mirrored place or goes on
from the match's end.
Words are only ever compared with each other: there is no suffix array, tree or
automaton, and no hash.  The first root of a run lies less than a period after
its start, so an extension to the left stops at a period, and a candidate whose
places don't begin with equal words is never a first root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrays import slices, tidy

#: A run has this many words at least.
LEAST_WORDS = 12
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _candidates(w: Sequence, up: bool, least: int, found: set[tuple[int, int, int]]) -> int:
    """Put the runs whose root is a Lyndon word under one order into ``found``; the number of words compared beyond the first."""
    n, scanned = len(w), 0
    nss, agree = [0] * n, [0] * n  # next smaller suffix, and on how many words both agree
    before: dict[int, tuple[int, int]] = {}  # of a place: its previous smaller suffix with an equal first word, and on how many both agree
    lasts: dict[int, int] = {}  # of a period: where its last run ended
    back: dict[int, int] = {}  # of a place: on how many words before it and its next smaller suffix both agree
    places: list[int] = []  # the stack
    left, right, end = 0, 0, 0  # w[left:left + end - right] == w[right:end], of all matches the one with the largest end
    for r in range(n):
        c = w[r]
        if up:
            while places and w[places[-1]] > c:
                nss[places.pop()] = r
        else:
            while places and w[places[-1]] < c:
                nss[places.pop()] = r
        if places and w[places[-1]] == c:
            h, known = 1, False
            first, stop, d = right, end, right - left  # the match before this place's own
            while True:
                x = places[-1]
                if not known:
                    exact = False
                    if first <= r < stop:
                        if x == r - d:
                            h = max(h, stop - r)
                        elif x >= first:
                            if nss[x - d] == r - d:
                                same = agree[x - d]
                            else:
                                y, same = before.get(r - d, (-1, 0))
                                same = same if y == x - d else 0
                            exact = 0 < same < stop - r
                            h = same if exact else max(h, min(same, stop - r))
                    if not exact:
                        at = h
                        while r + h < n and w[x + h] == w[r + h]:
                            h += 1
                        scanned += h - at
                        if r + h > end:
                            left, right, end = x, r, r + h
                if r + h < n and (w[x + h] < w[r + h]) == up:
                    before[r] = (x, h)
                    break
                places.pop()
                nss[x], agree[x] = r, h
                p = r - x
                need = max(least - p, p) - h  # so many words must agree to the left
                if need < p and r >= lasts.get(p, 0):
                    k, most, exact = 0, min(p, x), False
                    if first <= x and r < stop and nss[x - d] == r - d and x - d in back:
                        exact = back[x - d] < x - first
                        k = min(back[x - d], x - first, most)
                    at = k
                    while not exact and k < most and w[x - k - 1] == w[r - k - 1]:
                        k += 1
                    scanned += k - at
                    if k < p:
                        back[x] = k
                    if need <= k < p:
                        lasts[p] = r + h
                        found.add((x - k, k + p + h, p))
                if not places or w[places[-1]] != c:
                    break
                y, below = before.get(x, (-1, 0))
                if below < h:  # the next one differs from x where x and r still agree: smaller than r
                    before[r] = (places[-1], below)
                    break
                known = below > h  # it agrees with x beyond, so it differs from r where x does
        places.append(r)
    return scanned


def runs(w: Sequence, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """``start, length, period`` of each run of at least ``least`` words, by start, then period; words need an order only."""
    found: set[tuple[int, int, int]] = set()
    for up in (True, False):
        _candidates(w, up, least, found)
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(w: Sequence, found: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    kept, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in found):
        if b > at:
            kept += w[at : max(a, at)]
            at = b
    return kept + list(w[at:])


def planted(w: list, doc_id: int | None) -> list:
    """``w``, or for every tenth id by CRC-32 ``w`` with a repetition from some word to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + (w[a : a + p] * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, plant: bool = False) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``: one row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0 and compared as bytes.
    The run told of is the longest, then the one with the smallest start, then
    period; without runs these four are null.  ``runs_sha256`` is that of the
    lines ``start,length,period``; ``collapsed_sha256`` that of the kept words
    joined by a space.  Null and empty texts have no words: no runs, and twice
    the digest of nothing.  Rows stay apart, repeated and null ids too; an empty
    table gives none; other columns are not read.  ``plant`` first repeats
    passages as ``planted`` says (a null id has none).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = (text or "").encode("utf-8", "surrogatepass").split()
                w = planted(w, doc_id) if plant else w
                found = runs(w, least)
                start, length, period = min(found, key=lambda run: (-run[1], run[0], run[2]), default=(None, None, None))
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
                exponent = 1000 * length // period if found else None
                kept = b" ".join(collapsed(w, found) if found else w)
                out.append((doc_id, len(found), start, length, period, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(task), _SCHEMA)
