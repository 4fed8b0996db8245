"""Packing documents into fixed windows by minimum bin slack.

A document's full windows are sequences of their own; its remainder waits in a
multiset of remainders.  The largest remainder opens a bin, and a subset-sum
dynamic program over bitsets (one bit for each length that the rest can add up
to) finds the multiset of other remainders that comes closest to the capacity;
the stored bitsets are walked back to the counts, and a found pattern is used
as often as the counts allow.  A bin that no multiset fills is closed by
cutting one more remainder, whose rest goes back to the multiset.

Each task packs its own rows in blocks of bounded size and hands what a block
can't fill on to the next, so that at most one sequence of a task is padded and
nothing is shuffled.  Sequence ids hold the task's partition number.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import insort
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrays import kept, slices, tidy

CAPACITY = 2048
#: The id that ends a document.
END_ID = 1
#: Text bytes whose new words are learned together, ids held before a block is packed, and words whose ids a worker remembers.
SLICE_BYTES, BLOCK_IDS, KNOWN_WORDS = 1 << 20, 1 << 21, 450_000


def closest_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of the lengths (ascending list) whose sum comes closest to ``room`` from below."""
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in reversed(lengths):
        if length > room:
            continue
        left, k = min(counts[length], room // length), 1
        while left and not bits >> room & 1:
            k = min(k, left)
            steps.append((length, k, bits))
            bits |= bits << (length * k) & mask
            left -= k
            k *= 2
        if bits >> room & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


class Packer:
    """Pieces of a task's documents, in the order in which their sequences close."""

    def __init__(self, capacity: int, first_id: int, emit: Callable[[tuple, int, int], None]) -> None:
        self.capacity, self.next_id, self.emit = capacity, first_id, emit
        self.waiting: dict[int, list[tuple]] = {}  # length: (doc, start, ids, doc_tokens)

    def add(self, doc: object, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.capacity
        for start in range(0, whole, self.capacity):
            self.emit((doc, start, ids[start : start + self.capacity], n), self.next_id, 0)
            self.next_id += 1
        if whole < n:
            self._wait((doc, whole, ids[whole:], n))

    def _wait(self, piece: tuple) -> None:
        self.waiting.setdefault(len(piece[2]), []).append(piece)

    def close(self, *, last: bool) -> None:
        """Fill sequences until the rest fits into one; that one goes only if ``last``."""
        counts = {length: len(of) for length, of in self.waiting.items()}
        lengths = sorted(counts)
        while lengths:
            top = lengths[-1]
            self._take(counts, lengths, top, 1)
            used = closest_fill(lengths, counts, self.capacity - top)
            slack = self.capacity - top - sum(length * k for length, k in used.items())
            times = 1 + counts.get(top, 0) // (1 + used.get(top, 0)) if used.get(top, 0) == 0 else 1 + (counts[top] - used[top]) // (1 + used[top])
            times = min([times, *(counts[length] // k for length, k in used.items() if length != top)])
            self._take(counts, lengths, top, times - 1 + times * used.get(top, 0))
            for length, k in used.items():
                if length != top:
                    self._take(counts, lengths, length, times * k)
            need = {**used, top: used.get(top, 0) + 1}
            if slack and not lengths:  # of several alike, all but one can be filled by cutting the last
                if times > 1:
                    self._put(counts, lengths, need, times // 2)
                    times -= times // 2
                elif not last:
                    return
            for _ in range(times):
                self._sequence(need, slack, counts, lengths)

    def _take(self, counts: dict[int, int], lengths: list[int], length: int, n: int) -> None:
        if n:
            counts[length] -= n
            if not counts[length]:
                del counts[length]
                lengths.remove(length)

    def _put(self, counts: dict[int, int], lengths: list[int], need: dict[int, int], times: int) -> None:
        for length, k in need.items():
            if length not in counts:
                insort(lengths, length)
            counts[length] = counts.get(length, 0) + k * times

    def _sequence(self, need: dict[int, int], slack: int, counts: dict[int, int], lengths: list[int]) -> None:
        offset = 0
        for length in sorted(need, reverse=True):
            for _ in range(need[length]):
                self._place(self._pop(length), offset)
                offset += length
        while slack and lengths:
            longest = lengths[-1]
            self._take(counts, lengths, longest, 1)
            doc, start, ids, n = self._pop(longest)
            cut = min(slack, longest)
            self._place((doc, start, ids[:cut], n), offset)
            if cut < longest:
                self._wait((doc, start + cut, ids[cut:], n))
                self._put(counts, lengths, {longest - cut: 1}, 1)
            offset, slack = offset + cut, slack - cut
        self.next_id += 1

    def _pop(self, length: int) -> tuple:
        of = self.waiting[length]
        piece = of.pop()
        if not of:
            del self.waiting[length]
        return piece

    def _place(self, piece: tuple, offset: int) -> None:
        self.emit(piece, self.next_id, offset)

    def hold(self) -> None:
        """Own copies of what waits, so that a block's ids can go."""
        self.waiting = {length: [(d, s, ids.copy(), n) for d, s, ids, n in of] for length, of in self.waiting.items()}


#: Lower-case letters of one code point that no normalisation changes, then marks: two tokens' worth of text.
_SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?%*#$&|@+-]*)")
# The rules of the vocabularies whose words can be looked up one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The byte alphabet of the vocabulary: printable bytes stand for themselves, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _plain(text: str) -> str:
    """The text in lower case, if that is sure to leave its ids alone."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text if "<|" in text else text.lower()


def ids_by_words(path: str) -> bool:
    """Whether a tokenizer file has the rules that ``WordIds`` relies on."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    model = rules["model"]
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
    added = all(t["special"] and not t["normalized"] and t["content"].startswith("<|") and t["content"].endswith("|>") for t in rules["added_tokens"])
    return plain and added and rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _PRE_TOKENIZER


class WordIds:
    """Ids of whole texts by way of their words, of which the last ones are remembered.

    The tokenizer drops white space and lets no token span it, so a text's ids
    are its words' ids in order.  Only space, tab and line ends split here; any
    other white space is left for the tokenizer.  It also parts letters from
    marks, so a word of letters with marks behind it has the ids of both.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)[0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _learn(self, unseen: list[str]) -> None:
        """Ids of words: of letters and then marks by the model alone, of others by the whole tokenizer."""
        others, parts, plain = [], {}, []
        for word in unseen:
            if word.isascii() and word.isalpha() and word.islower():
                plain.append(word)
            elif m := _SIMPLE.fullmatch(word):
                parts[word] = m.groups()
            else:
                others.append(word)
        # A run of marks may stand alone as well as behind letters.
        others = list(dict.fromkeys([*others, *(tail for _, tail in parts.values() if tail not in self.known)]))
        self._put(others, [got.ids for got in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)])
        tokenize = self.tokenizer.model.tokenize
        self._put(plain, [[t.id for t in tokenize(x)] for x in plain])
        cores = [x for x in dict.fromkeys(core for core, _ in parts.values()) if x not in self.known]
        self._put(cores, [[t.id for t in tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(_BYTES))] for x in cores])
        both = [(word, self.known[core], self.known[tail]) for word, (core, tail) in parts.items() if tail]
        if both:
            words, *codes = zip(*both, strict=True)
            codes = np.array(codes).T
            self._append(list(words), self.size[codes].sum(1), self._gather(codes.reshape(-1)))

    def _put(self, words: list[str], lists: list[list[int]]) -> None:
        self._append(words, np.fromiter(map(len, lists), np.int64, len(lists)), np.array(list(chain.from_iterable(lists)), np.uint32))

    def _append(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        k, n = len(self.known), len(words)
        while k + n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[k : k + n] = sizes
        self.begin[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(words, range(k, k + n), strict=True))
        if len(self.known) != k + n:
            raise AssertionError("a word was learned twice")

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        """Ids of the words with these numbers, end to end."""
        sizes = self.size[codes]
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.begin[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the number of ids of each text."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        split = [_plain(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        flat = [w for of in split for w in of]
        if unseen := set(flat).difference(self.known):
            self._learn(list(unseen))
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        ids, ends = self._gather(codes), np.cumsum(self.size[codes])
        marks = np.concatenate([np.zeros(1, np.int64), ends])[np.cumsum([0, *map(len, split)])]
        return ids, np.diff(marks)


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return kept(("tokenizer", path), lambda: (Tokenizer.from_file(path), ids_by_words(path)))


class TextIds:
    """Ids of whole texts by any other tokenizer."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)[0]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        lists = [got.ids for got in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


def _runner(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker's next task begins with the words of the last ones; their ids are the same in all tasks.  The tokenizer, made within, is kept beside them.
        encode = kept(("words", path), lambda: WordIds(path)) if _tokenizer(path)[1] else TextIds(path)
        rows: list[tuple] = []

        def emit(piece: tuple, sequence: int, offset: int) -> None:
            doc, start, ids, n = piece
            rows.append((doc, start, len(ids), ids.copy() if with_ids else zlib.crc32(ids), n, sequence, offset))

        packer = Packer(capacity, TaskContext.get().partitionId() << 32, emit)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            what = pa.array(cols[3], pa.list_(pa.int32())) if with_ids else pa.array(cols[3], pa.int64())
            out = [pa.array(cols[k], pa.int64()) if k != 3 else what for k in range(7)]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids" if with_ids else "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        held = 0
        for part in slices(batches, limit=SLICE_BYTES):
            ids, counts = encode(part.column(1).to_pylist())
            ends = np.cumsum(counts + 1)
            block = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
            if len(ids):
                block[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            for doc, a, b in zip(part.column(0).to_pylist(), (ends - counts - 1).tolist(), ends.tolist(), strict=True):
                packer.add(doc, block[a:b])
            held += len(block)
            if held >= BLOCK_IDS:
                packer.close(last=False)
                packer.hold()
                held = 0
            if rows:
                yield flush()
        packer.close(last=True)
        yield flush()

    return run


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: one row a piece.

    With ``with_ids=False`` the ids are replaced by ``ids_crc32``, the CRC of
    their little-endian 32-bit form.  A null or empty text is the end id alone;
    repeated rows and ids, and null ids, are documents of their own; other
    columns are not read; no rows give no pieces.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    what = "ids array<int>" if with_ids else "ids_crc32 long"
    return source.mapInArrow(tidy(_runner(tokenizer, capacity, end_id, with_ids), keeps=True), f"doc_id long, start long, length long, {what}, doc_tokens long, sequence_id long, offset long")
