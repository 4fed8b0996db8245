"""Periodic runs against brute force over all periods, the number of comparisons, edges, and the registered query."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest

from simloom.llm.queries import QUERIES
from simloom.llm.runs import _candidates, collapsed, periodic_runs, runs

NOTHING = hashlib.sha256(b"").hexdigest()


def _brute(w, least):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, 2 * p) and not any(all(w[k] == w[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda run: (run[0], run[2]))


def _brute_collapsed(w, found):
    return [x for i, x in enumerate(w) if not any(a + p <= i < a + size for a, size, p in found)]


@pytest.mark.parametrize(("letters", "most"), [("ab", 13), ("abc", 8)])
def test_all_short_words(letters, most):
    for n in range(most):
        for w in itertools.product(letters, repeat=n):
            assert runs(w, 2) == _brute(w, 2)


def test_random_texts_with_repetitions():
    rng = random.Random(13)
    for _ in range(1500):
        w = [rng.choice("abcdefgh"[: rng.choice((1, 2, 3, 4, 8))]) for _ in range(rng.randrange(1, 70))]
        a, p = rng.randrange(len(w)), rng.randrange(1, 9)
        w = (w[:a] + w[a : a + p] * 70)[: len(w)]
        for least in (2, 12):
            found = runs(w, least)
            assert found == _brute(w, least)
            assert collapsed(w, found) == _brute_collapsed(w, found)


def _fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [lambda n: "a" * n, _fibonacci, lambda n: _fibonacci(n)[::-1], lambda n: ["ab"[i.bit_count() & 1] for i in range(n)], lambda n: (("a" * 140 + "b") * n)[:n], lambda n: (list(range(n // 30)) * 31)[:n]])
def test_comparisons_grow_with_the_text(make):
    for n in (3000, 60000):
        for up in (True, False):
            assert _candidates(make(n), up, 2, set()) <= 4 * n


def _expected(doc_id, text):
    w = text.encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = _brute(w, 12)
    best = sorted(found, key=lambda run: (-run[1], run[0], run[2]))[:1]
    told = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(_brute_collapsed(w, found))).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = ["ä", "b", "c d", "e", "f"]
    texts = [" ".join(rng.choice(words[: 1 + i % 5]) for _ in range(rng.randrange(90))) for i in range(300)]
    texts[:3] = ["", " \t\n\x0b\x0c\r ", "one two " * 20]
    frame = spark.createDataFrame([(i * 37, t) for i, t in enumerate(texts)], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    ours = sorted(tuple(x) for x in QUERIES["op13_lyndon_runs"](spark, str(tmp_path)).collect())
    assert ours == sorted(_expected(i * 37, t) for i, t in enumerate(texts))
    assert sum(zlib.crc32(str(i * 37).encode()) % 10 == 0 for i in range(300)) > 10


def test_edges(spark):
    long = "a b c " * 50000
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x " * 30, 5), (4, long, 5), (4, long, 5), (5, "word", None)], "doc_id long, text string, n_runs long")
    got = sorted((tuple(x) for x in periodic_runs(docs).collect()), key=str)
    by_id = {x[0]: x for x in got}
    assert len(got) == 6
    assert by_id[1][1:] == by_id[2][1:] == (0, None, None, None, None, NOTHING, NOTHING)
    assert by_id[None][1:6] == (1, 0, 30, 1, 30000)
    assert by_id[4] == (4, 1, 0, 150000, 3, 50_000_000, hashlib.sha256(b"0,150000,3\n").hexdigest(), hashlib.sha256(b"a b c").hexdigest())
    assert by_id[5][-1] == hashlib.sha256(b"word").hexdigest()
    assert periodic_runs(docs.where("false")).collect() == []
