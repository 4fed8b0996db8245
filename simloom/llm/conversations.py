"""Repair of conversations' structure at least cost, by time-major tensors.

A conversation's roles must read ``(s?(ua)+)?`` by their initials.  Rows are
kept (cost 0), given the other role of user and assistant (2) or deleted (3,
and always if blank or a repetition), and empty user or assistant rows are put
in anywhere (2); a truncated row that stays costs 1 more.  Four states tell
what was written last: nothing, a system row, a user row, an assistant row.

Conversations of like length are laid out as arrays ``[turn, state,
conversation]``.  One pass from the last turn to the first computes the cost of
the rest of all of them at once and stores it; a second follows the edits of
all of them from the first turn on, taking the least letter of those that the
stored costs allow, so ties give the ASCII-least edits.

Rows are dealt out by ranges of conversation and turn, so a conversation of any
length is cut into pieces of bounded size, and no task has to hold one whole.  A
piece acts on the cost of what follows as a 4 x 4 matrix over (min, +), which
the same pass gives for four ends at once.  A fold over the pieces' matrices
from the last one gives each the cost of what follows; a piece then is traced
from each of its four possible states, and a second fold from the first piece
picks the right one.  The digest of a conversation's text is taken piece after
piece.  Conversations in one piece skip all that.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrays import tidy
from simloom.scratch import Scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows and characters of a piece; a single row may have more characters.
PIECE_ROWS, PIECE_CHARS = 2048, 1 << 20
#: Cells ``turns x conversations`` of an array.
CELLS = 1 << 18
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after a role is written, and the role that may follow each state by an edit.
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_FAR = np.int64(1 << 40)
_INITIALS = {"s": 0, "u": 1, "a": 2}
#: Of state and initial (s, u, a, other): the state after a kept row, or -1.
_KEPT = np.array([[_SYSTEM, _USER, -1, -1], [-1, _USER, -1, -1], [-1, -1, _ASSISTANT, -1], [-1, _USER, -1, -1]])
_LEGAL = {"su", "ua", "au"}
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
_TAIL = {_NOTHING: "", _SYSTEM: "II", _USER: "I", _ASSISTANT: ""}

_PIECES = "conv_id long, part int, piece int, alone boolean, roles array<string>, texts array<string>, least long, most long, n_turns long, first_turn long, last_turn long"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Faults(NamedTuple):
    """What the rows of a piece are: initials, rows that must go, truncated rows, and counts."""

    initials: np.ndarray
    gone: np.ndarray
    cut: np.ndarray
    blank: int
    duplicate: int
    truncated: int
    illegal: int


def faults(roles: list[str], texts: list[str], seen: set[bytes] | None = None) -> Faults:
    """The first fault of each row; ``seen`` are digests of rows in earlier pieces."""
    seen, blank, duplicate = set(seen or ()), [], []
    cut = []
    for role, text in zip(roles, texts, strict=True):
        last = _LAST.search(text)
        digest = row_digest(role, text)
        blank.append(last is None)
        duplicate.append(last is not None and digest in seen)
        cut.append(last is not None and digest not in seen and last[0] not in ".!?")
        seen.add(digest)
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
    gone = np.array(blank, bool) | np.array(duplicate, bool)
    return Faults(np.array([_INITIALS.get(x, 3) for x in initials], np.int8), gone, np.array(cut, bool), sum(blank), sum(duplicate), sum(cut), illegal)


def row_digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _inserted(cost: np.ndarray) -> np.ndarray:
    """``cost[state, ...]`` when rows may be put in first; in place."""
    cost[_USER] = np.minimum(cost[_USER], INSERT + cost[_ASSISTANT])
    cost[_ASSISTANT] = np.minimum(cost[_ASSISTANT], INSERT + cost[_USER])
    cost[_NOTHING] = np.minimum(cost[_NOTHING], INSERT + cost[_USER])
    cost[_SYSTEM] = np.minimum(cost[_SYSTEM], INSERT + cost[_USER])
    return cost


def accepted() -> np.ndarray:
    """The cost after the last row, of each state."""
    return _inserted(np.array([0, _FAR, _FAR, 0], np.int64))


class Block:
    """Pieces of at most so many rows, as arrays ``[turn, piece]``; shorter ones have idle turns at the end."""

    def __init__(self, pieces: list[Faults]) -> None:
        self.n = np.array([len(p.initials) for p in pieces])
        turns = int(self.n.max(initial=0))
        self.initials = np.full((turns, len(pieces)), 3, np.int8)
        self.gone, self.cut = np.zeros((turns, len(pieces)), bool), np.zeros((turns, len(pieces)), np.int64)
        for k, p in enumerate(pieces):
            self.initials[: self.n[k], k], self.gone[: self.n[k], k], self.cut[: self.n[k], k] = p.initials, p.gone, p.cut

    def costs(self, after: np.ndarray) -> np.ndarray:
        """``[turn + 1, state, ..., piece]``: the cost of the rest, given ``after[state, ..., piece]`` behind the last turn."""
        turns = len(self.initials)
        out = np.empty((turns + 1, *after.shape), np.int64)
        out[turns] = after
        for t in range(turns - 1, -1, -1):
            rest, stays = out[t + 1], np.where(self.gone[t], _FAR, TRUNCATED * self.cut[t])
            now = DELETE + rest
            now = np.minimum(now, REROLE + stays + rest[_NEXT])
            for state in range(4):
                for initial in range(3):
                    to = _KEPT[state, initial]
                    if to >= 0:
                        now[state] = np.minimum(now[state], np.where(self.initials[t] == initial, KEEP + stays, _FAR) + rest[to])
            out[t] = np.where(t < self.n, np.minimum(_inserted(now), _FAR), rest)
        return out

    def trace(self, costs: np.ndarray, state: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The least cheapest edits of each piece from ``state`` on, and the states they end in; ``costs`` is ``[turn + 1, state, piece]``."""
        state, turn, every = state.copy(), np.zeros(len(self.n), np.int64), np.arange(len(self.n))
        letters = []
        while (busy := every[turn < self.n]).size:
            t, s = turn[busy], state[busy]
            now, rest = costs[t, s, busy], costs[t + 1, :, busy]
            stays = np.where(self.gone[t, busy], _FAR, TRUNCATED * self.cut[t, busy])
            kept, row = _KEPT[s, self.initials[t, busy]], np.arange(len(busy))
            delete = now == DELETE + rest[row, s]
            insert = ~delete & (now == INSERT + costs[t, _NEXT[s], busy])
            keep = ~delete & ~insert & (kept >= 0) & (now == KEEP + stays + rest[row, kept])
            step = np.zeros(len(self.n), np.uint8)
            step[busy] = np.select([delete, insert, keep], [ord("D"), ord("I"), ord("K")], ord("R"))
            letters.append(step)
            state[busy] = np.select([delete, keep], [s, kept], _NEXT[s])
            turn[busy] += ~insert
        both = np.array(letters, np.uint8).reshape(len(letters), len(self.n))
        return [both[both[:, k] > 0, k].tobytes().decode() for k in range(len(self.n))], state


def blocks(sizes: list[int], width: int = 1) -> Iterator[list[int]]:
    """Numbers of pieces of like length, so that an array has a bounded number of cells."""
    by_length = sorted(range(len(sizes)), key=sizes.__getitem__)
    at = 0
    while at < len(by_length):
        to = at + 1
        while to < len(by_length) and (to + 1 - at) * width * (sizes[by_length[to]] + 1) <= CELLS and sizes[by_length[to]] <= 2 * sizes[by_length[at]] + 8:
            to += 1
        yield by_length[at:to]
        at = to


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines ``role:text`` that the edits of a piece leave."""
    out, row = [], 0
    for letter in audit:
        if letter == "K":
            out.append(f"{roles[row]}:{texts[row]}")
            state = _KEPT[state, _INITIALS[roles[row][0]]]
        elif letter in "RI":
            state = int(_NEXT[state])
            out.append(f"{_ROLE[state]}:{texts[row] if letter == 'R' else ''}")
        row += letter != "I"
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn, as pieces; what may go on in another task or piece isn't ``alone``."""
    part = TaskContext.get().partitionId()
    held: list[tuple] = []  # pieces
    now: list = []  # conversation, roles, texts, turns of the piece that is open
    chars = number = 0
    first, single = True, True

    def close(alone: bool) -> None:
        nonlocal number
        turns = [t for t in now[3] if t is not None]
        held.append((now[0], part, number, alone, now[1], now[2], min(turns, default=None), max(turns, default=None), len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None))
        number += 1

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())] + [pa.int64()] * 5
        out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])
        held.clear()
        return out

    for batch in batches:
        for conv, turn, role, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not now or conv != now[0]:
                if now:
                    close(single and not first)
                    first = False
                now, chars, single = [conv, [], [], []], 0, True
            for _ in range(times):
                if len(now[1]) >= PIECE_ROWS or chars + len(text) > PIECE_CHARS and now[1]:
                    single = False
                    close(False)
                    now, chars = [conv, [], [], []], 0
                now[1].append(role)
                now[2].append(text)
                now[3].append(turn)
                chars += len(text)
        if len(held) >= 512:
            yield flush()
    if now:
        close(False)
    if held:
        yield flush()


def _finish(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    for row in rows:
        out.append(row)
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RESULT.split(", ")])
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RESULT.split(", ")])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in one piece, from first to last."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            at = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            found = [faults(r, t) for r, t in zip(at["roles"], at["texts"], strict=True)]
            for chosen in blocks([len(f.initials) for f in found]):
                block = Block([found[k] for k in chosen])
                costs = block.costs(np.repeat(accepted()[:, None], len(chosen), 1))
                audits, ends = block.trace(costs, np.zeros(len(chosen), np.int64))
                for x, k in enumerate(chosen):
                    f = found[k]
                    lines = repaired(audits[x], _NOTHING, at["roles"][k], at["texts"][k])
                    tail = _TAIL[int(ends[x])]
                    lines += [f"{role}:" for role in ("user", "assistant")[2 - len(tail) :]] if tail else []
                    gaps = at["most"][k] - at["least"][k] + 1 - at["n_turns"][k] if at["n_turns"][k] else 0
                    digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
                    yield at["conv_id"][k], gaps, f.blank, f.duplicate, f.truncated, f.illegal, int(costs[0, 0, x]), audits[x] + tail, digest

    return _finish(rows())


_MATRIX = "conv_id long, part int, piece int, matrix array<long>"
_TRACED = "conv_id long, part int, piece int, roles array<string>, texts array<string>, least long, most long, n_turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, cost long, audits array<string>, ends array<int>"


def _columns(batch: pa.RecordBatch) -> dict[str, list]:
    return {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = _columns(batch)
        for conv, part, piece, roles, texts in zip(*(at[n] for n in ("conv_id", "part", "piece", "roles", "texts")), strict=True):
            own = sorted({row_digest(r, t) for r, t in zip(roles, texts, strict=True)})
            if own:
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv] * len(own), pa.int64()), "part": pa.array([part] * len(own), pa.int32()), "piece": pa.array([piece] * len(own), pa.int32()), "digest": pa.array(own, pa.binary())})


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = _columns(batch)
        found = [faults(r, t, set(s or ())) for r, t, s in zip(at["roles"], at["texts"], at["seen"], strict=True)]
        out: list = [None] * len(found)
        ends = np.where(np.eye(4, dtype=bool), 0, _FAR).astype(np.int64)
        for chosen in blocks([len(f.initials) for f in found], 16):
            first = Block([found[k] for k in chosen]).costs(np.repeat(ends[:, :, None], len(chosen), 2))[0]
            for x, k in enumerate(chosen):
                out[k] = first[:, :, x].reshape(-1).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(at["conv_id"], pa.int64()), pa.array(at["part"], pa.int32()), pa.array(at["piece"], pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=[x.split()[0] for x in _MATRIX.split(", ")])


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from a conversation's last to its first, with the cost of what follows each."""
    now, cost = object(), accepted()
    for batch in batches:
        at, out = _columns(batch), []
        for conv, matrix in zip(at["conv_id"], at["matrix"], strict=True):
            if conv != now:
                now, cost = conv, accepted()
            out.append(cost.tolist())
            cost = np.minimum((np.array(matrix, np.int64).reshape(4, 4) + cost).min(axis=1), _FAR)
        yield pa.RecordBatch.from_arrays([pa.array(at["conv_id"], pa.int64()), pa.array(at["part"], pa.int32()), pa.array(at["piece"], pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "part", "piece", "after"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _TRACED.split(", ")]
    for batch in batches:
        at = _columns(batch)
        found = [faults(r, t, set(s or ())) for r, t, s in zip(at["roles"], at["texts"], at["seen"], strict=True)]
        cost: list = [0] * len(found)
        audits, ends = defaultdict(list), defaultdict(list)
        for chosen in blocks([len(f.initials) for f in found], 4):
            block = Block([found[k] for k in chosen])
            costs = block.costs(np.array([at["after"][k] for k in chosen], np.int64).T)
            for state in range(4):
                edits, to = block.trace(costs, np.full(len(chosen), state))
                for x, k in enumerate(chosen):
                    audits[k].append(edits[x])
                    ends[k].append(int(to[x]))
            for x, k in enumerate(chosen):
                cost[k] = int(costs[0, 0, x])
        own = {"blank": [f.blank for f in found], "duplicate": [f.duplicate for f in found], "truncated": [f.truncated for f in found], "illegal": [f.illegal for f in found], "cost": cost, "audits": [audits[k] for k in range(len(found))], "ends": [ends[k] for k in range(len(found))]}
        kinds = {"part": pa.int32(), "piece": pa.int32(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "audits": pa.list_(pa.string()), "ends": pa.list_(pa.int32())}
        yield pa.RecordBatch.from_arrays([pa.array(own[n] if n in own else at[n], kinds.get(n, pa.int64())) for n in names], names=names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from a conversation's first to its last, one after the other."""

    class Open:
        def __init__(self, conv: int | None, cost: int) -> None:
            self.conv, self.cost, self.state, self.audit, self.text, self.some = conv, cost, _NOTHING, [], hashlib.sha256(), False
            self.counts, self.turns, self.least, self.most, self.turn, self.role = [0, 0, 0, 0], 0, None, None, None, None

        def lines(self, lines: list[str]) -> None:
            if lines:
                self.text.update((("\n" if self.some else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
                self.some = True

        def row(self) -> tuple:
            tail = _TAIL[self.state]
            self.lines([f"{role}:" for role in ("user", "assistant")[2 - len(tail) :]] if tail else [])
            return self.conv, self.most - self.least + 1 - self.turns if self.turns else 0, *self.counts, self.cost, "".join(self.audit) + tail, self.text.hexdigest()

    def rows() -> Iterator[tuple]:
        now: Open | None = None
        for batch in batches:
            at = _columns(batch)
            for k, conv in enumerate(at["conv_id"]):
                if now is None or conv != now.conv:
                    if now is not None:
                        yield now.row()
                    now = Open(conv, at["cost"][k])
                roles = at["roles"][k]
                for x, n in enumerate(("blank", "duplicate", "truncated", "illegal")):
                    now.counts[x] += at[n][k]
                if roles:
                    if now.role is not None:
                        now.counts[3] += now.role[:1] + roles[0][:1] not in _LEGAL
                    now.role = roles[-1]
                if at["n_turns"][k]:
                    now.turns += at["n_turns"][k] - (now.turn == at["first_turn"][k])
                    now.least, now.most, now.turn = at["least"][k] if now.least is None else now.least, at["most"][k], at["last_turn"][k]
                audit = at["audits"][k][now.state]
                now.lines(repaired(audit, now.state, roles, at["texts"][k]))
                now.audit.append(audit)
                now.state = at["ends"][k][now.state]
        if now is not None:
            yield now.row()

    return _finish(rows())


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times``: rows after damage, how often each stands there (0: dropped)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), times.alias("times"))


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: one row for each conversation of ``rows``.

    ``rows`` has ``conv_id, turn, role, text, times`` as ``damaged`` gives them;
    other columns are not read.  Rows go by turn, null turns first, rows of one
    turn by role, then text; null ids are one conversation.  A row is blank, or
    else a repetition of an earlier one, or else truncated.  A conversation of
    which no row is left has zeros, an empty audit and the digest of nothing;
    an empty table gives no rows.  Rows equal in all columns stay in one task,
    cut into pieces like others.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "times")
    ranges = filled.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    cut = ranges.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(tidy(_pieces), _PIECES)
    pieces = scratch.table(cut, "pieces")
    whole = pieces.where("alone").mapInArrow(tidy(_whole), _RESULT)

    key = ["conv_id", "part", "piece"]
    # A null id is none of the table's own where it takes part in joins.
    others = pieces.where("not alone")
    place = F.struct("part", "piece")
    digests = others.mapInArrow(tidy(_digests), "conv_id long, part int, piece int, digest binary")
    first = digests.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").withColumnsRenamed({"conv_id": "of", "digest": "known"})
    again = digests.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("known")) & (place > F.col("first"))).groupBy("part", "piece").agg(F.collect_set("digest").alias("seen"))
    known = scratch.table(others.join(again, ["part", "piece"], "left"), "others")
    matrices = known.select(*key, "roles", "texts", "seen").mapInArrow(tidy(_matrices), _MATRIX)
    behind = matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("piece")).mapInArrow(tidy(_behind), "conv_id long, part int, piece int, after array<long>")
    traced = known.join(behind.drop("conv_id"), ["part", "piece"]).mapInArrow(tidy(_traced), _TRACED)
    rest = traced.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(tidy(_joined), _RESULT)
    return whole.unionByName(rest)
