"""Conversation repair against an exhaustive search, pieces against whole conversations, edges, and the registered query."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from simloom.llm import conversations as C
from simloom.llm.queries import QUERIES

NOTHING = hashlib.sha256(b"").hexdigest()
LEGAL = re.compile("(s?(ua)+)?")


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def _cheapest(rows):
    """Of all edits, by least cost, then letters: Dijkstra's search over (row, roles written so far as a state), with texts."""
    seen, first = set(), []
    for role, text in rows:
        blank = not re.search("[^\x20\x09-\x0d]", text)
        again = (role, text) in seen
        seen.add((role, text))
        kept = re.sub("[\x20\x09-\x0d]", "", text)
        first.append("blank" if blank else "duplicate" if again else "truncated" if kept[-1] not in ".!?" else "")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return first, cost, audit, lines
        need = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[need]
        heapq.heappush(heap, (cost + 2, audit + "I", i, need, (*lines, f"{name}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if first[i] not in ("blank", "duplicate"):
                more = first[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, need, (*lines, f"{name}:{text}")))
                if role[:1] == need or role[:1] == "s" and last == "":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
    raise AssertionError


def _expected(rows):
    by_conv = {r[0]: [] for r in rows}
    for r in _damage(rows):
        by_conv[r[0]].append(r[1:])
    out = []
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        first, cost, audit, lines = _cheapest([r[1:] for r in own])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        assert LEGAL.fullmatch("".join(x[0] for x in lines))
        out.append((conv, gaps, first.count("blank"), first.count("duplicate"), first.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def _some(rng, conversations, most):
    rows = []
    for conv in range(conversations):
        turn = rng.randrange(3)
        for _ in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            text = rng.choice(["Yes.", "No", "What?", "ok!  \n", " ", "", None, "a.b", "...", f"t{rng.random()}.", f"x{rng.random()}", "é", "\x85"])
            rows.append((conv if conv else None, turn if rng.random() < 0.9 else None, role, text))
            turn += rng.choice((0, 1, 1, 1, 2))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def _run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in C.repair(C.damaged(df)).collect()), key=str)


def test_against_exhaustive_search(spark):
    rows = _some(random.Random(11), 400, 14)
    assert _run(spark, rows) == _expected(rows)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_pieces_are_as_whole_conversations(spark, monkeypatch, size):
    rows = _some(random.Random(size), 60, 40)
    script = f"from simloom.llm import conversations as C\nC.PIECE_ROWS = {size}\n"
    # Workers import the module themselves, so the size goes with the function.
    run = C._pieces

    def small(batches):
        exec(script)  # noqa: S102
        yield from run(batches)

    monkeypatch.setattr(C, "_pieces", small)
    assert _run(spark, rows, 4) == _expected(rows)


def test_one_long_conversation(spark):
    rng = random.Random(5)
    rows = [(7, t // 2, rng.choice(("user", "assistant", "system")), f"t{rng.randrange(4000)}" + rng.choice(".?x")) for t in range(9000)]
    ((got,), (expected,)) = _run(spark, rows), _expected(rows)
    assert got == expected


def test_query_and_edges(spark, tmp_path):
    rows = [(1, 0, None, None), (2, 5, "user", "Hi."), (2, 6, "assistant", "Yes."), (3, None, "user", "x"), (None, 1, "user", "Hello."), (None, 1, "user", "Hello.")]
    rows += [(c, t, "user" if t % 2 else "assistant", "word. " * 3000) for c in range(4, 40) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cost", "'x' as audit", "2 as times")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()), key=str)
    assert got == _expected(rows)
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert _run(spark, [(dropped, 0, "user", "Hi.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", NOTHING)]
    assert C.repair(C.damaged(df.where("false"))).collect() == []
