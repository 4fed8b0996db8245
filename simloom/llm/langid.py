"""Language of texts by cross-parsing entropy over suffix automata.

For each language a suffix automaton holds all substrings of its sample of
labelled text.  A text is parsed greedily: a phrase is the longest match of
what is left (Ziv and Merhav, 1993), so a text in the automaton's language
falls into fewer phrases.  The language with the fewest phrases, normalised by
the length and the sample's logarithm, wins.

The automaton is completed to a table that on a mismatch counts a phrase and
goes on from the root, so that a step is one lookup; the transitions of a large
alphabet are searched instead.  Texts are cut into lanes
that step together; a phrase also ends where a lane does, for every language
alike, and all of a text is parsed.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrays import joined, kept, slices, tidy

#: Labelled rows that a language's sample is taken from, those with the smallest
#: hash of the id.  Of these the shortest go in whole, one at least, as long as
#: they have so many characters together at most.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 40_000
#: Entries of a language's table; with more, as an alphabet of thousands has, its transitions are searched in order.
TABLE_ENTRIES = 1 << 24
LANE = 256
UNKNOWN = "und"
_SPACE = 32


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case, each run of others one space, of texts end to end; their offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[offsets]
    chars = _folded()[points]
    keep = chars != _SPACE
    after = np.zeros(len(keep), bool)
    after[1:] = keep[:-1]
    after[at[:-1][at[:-1] < at[1:]]] = False
    keep |= after
    places = np.flatnonzero(keep)
    return chars[places], np.searchsorted(places, at)


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[now] = copy
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
        last = now
    return go


def _steps(go: list[dict[int, int]], width: int, entries: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """From states times the width and symbols to the next ones, shifted by two bits that count the phrases that end."""
    root, lone = np.zeros(width, np.int64), np.ones(width, np.int64)
    for c, to in go[0].items():
        root[c], lone[c] = to, 0
    state = np.repeat(np.arange(len(go)), [len(x) for x in go])
    place = state * width + np.array([c for x in go for c in x], np.int64)
    to = np.array([t for x in go for t in x.values()], np.int64) * width * 4
    # On a mismatch the phrase ends and the symbol begins the next one, which
    # ends at once if the sample lacks the symbol.
    fresh = root * width * 4 + lone
    if len(go) * width <= entries:
        table = np.tile(fresh + 1, (len(go), 1)).astype(np.int32).reshape(-1)
        table[:width] = fresh
        table[place] = to
        return lambda at, symbol: table[at + symbol]
    order = np.argsort(place)
    place, to = place[order], to[order]

    def step(at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        wanted = at + symbol
        where = np.searchsorted(place, wanted)
        where[where == len(place)] = 0
        return np.where(place[where] == wanted, to[where], fresh[symbol] + (at > 0))

    return step


class Parser:
    """Phrase counts of texts against the samples of all languages."""

    def __init__(self, samples: dict[str, str], entries: int = TABLE_ENTRIES) -> None:
        self.names = sorted(samples)
        texts = [folded(raw := np.frombuffer(samples[x].encode(), np.uint8), np.array([0, len(raw)]))[0] for x in self.names]
        self.symbols, self.steps, self.logs = [], [], []
        for text in texts:
            alphabet = np.unique(np.concatenate([text, np.array([_SPACE], np.uint32)]))
            symbol = np.zeros(0x110000, np.uint8 if len(alphabet) < 256 else np.uint16 if len(alphabet) < 1 << 16 else np.int32)
            symbol[alphabet] = np.arange(1, len(alphabet) + 1)  # symbol 0 is not in the sample
            self.symbols.append(symbol)
            self.steps.append(_steps(suffix_automaton(symbol[text]), len(alphabet) + 1, entries))
            self.logs.append(math.log2(max(2, len(text))))

    def rates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases of each text (rows) and language (columns), and each text's letters."""
        chars, ends = folded(data, offsets)
        sizes = np.diff(ends)
        letters = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(chars != _SPACE)])[ends])
        lanes = (sizes + LANE - 1) // LANE
        owner = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = ends[:-1][owner] + nth * LANE
        length = np.minimum(LANE, ends[1:][owner] - begin)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        active = np.searchsorted(-length, -np.arange(LANE), "left")  # lanes longer than each step
        out = np.zeros((len(sizes), len(self.names)))
        for j, (symbol, step) in enumerate(zip(self.symbols, self.steps, strict=True)):
            symbols = symbol[chars].astype(np.int64)
            state, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
            for k in range(LANE):
                n = active[k]
                if not n:
                    break
                got = step(state[:n], symbols[begin[:n] + k])
                count[:n] += got & 3
                state[:n] = got >> 2
            count += state > 0  # the phrase that the lane's end cuts
            out[:, j] = np.bincount(owner, count, len(sizes)) * self.logs[j]
        return out / np.maximum(1, sizes)[:, None], letters


def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return kept(("parser", samples), lambda: Parser(dict(samples)))


def _runner(samples: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples) if samples else None
        names = np.array([*(x for x, _ in samples), UNKNOWN], object)
        for part in slices(batches):
            if parser is None:
                best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
            else:
                rates, letters = parser.rates(*joined(part.column(1)))
                best = rates.argmin(1)
                share = np.exp2(-8 * (rates - rates.min(1, keepdims=True)))
                score = np.where(letters > 0, share.max(1) / share.sum(1), 0.0)
                best = np.where(letters > 0, best, len(names) - 1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def samples_of(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, parts: int, held_part: int, rows: int, chars: int) -> dict[str, str]:
    """A sample of each language's labelled texts outside the held-out part, whole ones only.

    Of ``rows`` texts, those with the smallest hash of the id, the shortest are
    kept as long as they have at most ``chars`` characters together, and always
    one.  Which those are is found on the cluster from ids and lengths.
    """
    labelled = docs.where(f"`{lang_col}` is not null and `{text_col}` is not null").where(F.expr(f"coalesce(crc32(cast(`{id_col}` as string)) % {parts} != {held_part}, false)"))
    order = F.struct(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"))
    ids = labelled.select(F.col(lang_col).cast("string").alias("lang"), order.alias("o"), F.length(text_col).alias("n"))
    ranked = ids.withColumn("k", F.expr("row_number() over (partition by lang order by o, n)")).where(F.col("k") <= rows)
    summed = ranked.withColumn("sum", F.expr("sum(n) over (partition by lang order by n, o, k rows unbounded preceding)")).withColumn("nth", F.expr("row_number() over (partition by lang order by n, o, k)"))
    chosen = summed.where((F.col("sum") <= chars) | (F.col("nth") == 1)).select("lang", F.col("o.id").alias("id"), F.col("o.h").alias("h"), "n").distinct()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("n", F.length("text")).join(F.broadcast(chosen), ["lang", "id", "n"])
    texts: dict[str, set[str]] = {}
    for r in found.select("lang", "text").distinct().toLocalIterator():
        texts.setdefault(r.lang, set()).add(r.text)
    return {lang: " ".join(sorted(of, key=lambda x: (len(x), x))) for lang, of in texts.items()}


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    parts: int = 4,
    held_part: int = 2,
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: one row for each input row.

    ``score`` is the winner's share of two to the minus eight times the rates.
    A null text or one without letters is ``und`` with score 0, as is any text
    if no row is labelled.  Ties go to the language that sorts first.  A null id
    is not held out and teaches nothing.  Other columns are not read.
    """
    samples = tuple(sorted(samples_of(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, parts=parts, held_part=held_part, rows=rows, chars=chars).items()))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(_runner(samples), keeps=True), "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.expr(f"crc32(cast(doc_id as string)) % {parts} = {held_part}"), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
