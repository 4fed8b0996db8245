"""Personal numbers, dates and addresses replaced by format-preserving pseudonyms.

Each value is found by its pattern and validated (check digits, ranges,
calendar), numbered within the set of all values of its format, and permuted in
that set by a keyed balanced Feistel network with cycle walking.  A pseudonym
is thus a valid value of the same format, punctuation and letter case kept;
equal values get equal pseudonyms in all documents, different ones different
ones, and the key's owner can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.arrays import slices, tidy

#: A key for tests and the registered query; real ones come from the caller, who keeps them.
TEST_KEY = b"simloom test key"
ROUNDS = 8
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date")


def permute(x: int, n: int, key: bytes, tweak: str, *, back: bool = False) -> int:
    """A keyed permutation of 0 .. n-1: Feistel rounds over bits, walked until in range."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    person = tweak.encode()[:16]
    size = min(64, half // 8 + 9)

    def mixed(r: int, side: int) -> int:
        data = r.to_bytes(1, "big") + n.to_bytes((n.bit_length() + 7) // 8, "big") + side.to_bytes((half + 7) // 8, "big")
        return int.from_bytes(hashlib.blake2b(data, key=key[:64], person=person, digest_size=size).digest(), "big") & mask

    while True:
        a, b = x >> half, x & mask
        if back:
            for r in reversed(range(ROUNDS)):
                a, b = b ^ mixed(r, a), a
        else:
            for r in range(ROUNDS):
                a, b = b, a ^ mixed(r, b)
        x = a << half | b
        if x < n:
            return x


def _refill(shape: str, digits: str) -> str:
    """The digits in the places of the digits of ``shape``."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn_digit(digits: str) -> str:
    """The digit that makes ``digits`` and it pass Luhn's check."""
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


Permute = Callable[[int, int, str], int]


def _card(value: str, to: Permute) -> str | None:
    d = _only_digits(value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    new = f"{to(int(d[:-1]), 10 ** (len(d) - 1), f'card{len(d)}'):0{len(d) - 1}d}"
    return _refill(value, new + luhn_digit(new))


def _card_spans(run: str) -> list[tuple[int, int]]:
    """Where cards stand in a run of digit groups, apart from each other.

    The whole run may be grouped in any way.  A part of it, which other numbers
    stand beside, has one kind of separator and at least four digits in all its
    groups but the last.  Layouts that cards have come first, then longer ones.
    """
    groups = [m.span() for m in _GROUP.finditer(run)]
    free = [True] * len(groups)
    found = []
    for i in range(len(groups)):
        n = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            if n < 13:
                continue
            (a, b), sizes = (groups[i][0], groups[j][1]), [y - x for x, y in groups[i : j + 1]]
            whole = j - i + 1 == len(groups)
            if not whole and (min(sizes[:-1], default=4) < 4 or len(set(run[a:b]) & {" ", "-"}) > 1):
                continue
            d = _only_digits(run[a:b])
            if luhn_digit(d[:-1]) == d[-1]:
                usual = len(sizes) == 1 or set(sizes[:-1]) == {4} and sizes[-1] <= 4 or sizes in ([4, 6, 5], [4, 6, 4])
                found.append((not usual, -n, a, b, i, j))
    out: list[tuple[int, int]] = []
    for _, _, a, b, i, j in sorted(found):
        if all(free[i : j + 1]):
            free[i : j + 1] = [False] * (j + 1 - i)
            out.append((a, b))
    return sorted(out)


def _in_parts(parts: list[tuple[int, int, int]], to: Permute, tweak: str) -> list[int] | None:
    """Parts (value, low, size) as one mixed-radix number, permuted."""
    x, n = 0, 1
    for v, low, size in parts:
        if not low <= v < low + size:
            return None
        x, n = x * size + v - low, n * size
    x = to(x, n, tweak)
    out = []
    for _, low, size in reversed(parts):
        x, r = divmod(x, size)
        out.append(r + low)
    return out[::-1]


def _ssn(value: str, to: Permute) -> str | None:
    area, group, serial = (int(x) for x in value.split("-"))
    if area in (0, 666):
        return None
    new = _in_parts([(area - (area > 666), 1, 898), (group, 1, 99), (serial, 1, 9999)], to, "ssn")
    return None if new is None else f"{new[0] + (new[0] >= 666):03d}-{new[1]:02d}-{new[2]:04d}"


def _phone(value: str, to: Permute) -> str | None:
    d = _only_digits(value)
    head, d = (d[:1], d[1:]) if len(d) == 11 else ("", d)
    if len(d) != 10 or head not in ("", "1"):
        return None
    new = _in_parts([(int(d[:3]), 0, 1000), (int(d[3:6]), 0, 1000), (int(d[6:]), 0, 10000)], to, "phone")
    return None if new is None else _refill(value, head + "{:03d}{:03d}{:04d}".format(*new))


def _ip(value: str, to: Permute) -> str | None:
    parts = value.split(".")
    if any(len(p) > 1 and p[0] == "0" for p in parts):
        return None
    new = _in_parts([(int(p), int(not k), 256 - (not k)) for k, p in enumerate(parts)], to, "ip")
    return None if new is None else ".".join(map(str, new))


def _iban(value: str, to: Permute) -> str | None:
    d = re.sub(r"\s", "", value)
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(d) <= 34 or number(d[4:] + d[:4]) % 97 != 1:
        return None
    body = _letters_and_digits(d[4:], to, f"iban{d[:2]}")
    check = 98 - number(body + d[:2] + "00") % 97
    rest = iter(f"{d[:2]}{check:02d}{body}")
    return "".join(c if c.isspace() else next(rest) for c in value)


def _letters_and_digits(text: str, to: Permute, tweak: str) -> str:
    """ASCII letters and digits permuted in their places, each as what it is."""
    kinds = [("0", 10) if c.isdigit() else ("A", 26) if c.isupper() else ("a", 26) if c.isalpha() else ("", 1) for c in text]
    parts = [(ord(c) - ord(base) if base else 0, 0, size) for c, (base, size) in zip(text, kinds, strict=True)]
    shape = "".join(base or c for c, (base, _) in zip(text, kinds, strict=True))
    new = _in_parts(parts, to, tweak + hashlib.blake2b(shape.encode(), digest_size=4).hexdigest())
    return "".join(chr(ord(base) + v) if base else c for c, v, (base, _) in zip(text, new, kinds, strict=True))


def _email(value: str, to: Permute) -> str | None:
    local, _, host = value.rpartition("@")
    return f"{_letters_and_digits(local, to, 'email')}@{host}"


_MONTHS = "january february march april may june july august september october november december".split()
_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _day(year: int, month: int, day: int, to: Permute) -> datetime.date | None:
    try:
        at = datetime.date(year, month, day).toordinal() - _FIRST
    except ValueError:
        return None
    return datetime.date.fromordinal(to(at, _DAYS, "date") + _FIRST) if 0 <= at < _DAYS else None


def _two(n: int, *parts: str) -> str:
    """A day or month with two digits, or without a leading zero if one of ``parts`` shows that style."""
    return f"{n:02d}" if all(len(x) == 2 for x in parts) else str(n)


def _date(value: str, to: Permute) -> str | None:
    if m := re.fullmatch(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", value):
        new = _day(int(m[1]), int(m[3]), int(m[4]), to)
        return new and f"{new.year}{m[2]}{_two(new.month, m[3], m[4])}{m[2]}{_two(new.day, m[3], m[4])}"
    if m := re.fullmatch(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})", value):
        # Day first, unless only month first is a date.
        month_first = int(m[3]) > 12
        new = _day(int(m[4]), int(m[1 if month_first else 3]), int(m[3 if month_first else 1]), to)
        if new is None:
            return None
        # A day of 12 or less would read the other way round, month first: those keep the day first.
        a, b = (new.month, new.day) if month_first and new.day > 12 else (new.day, new.month)
        return f"{_two(a, m[1], m[3])}{m[2]}{_two(b, m[1], m[3])}{m[2]}{new.year}"
    m = re.fullmatch(r"(?i)(?:(\d{1,2})(\.? )([a-z]+)|([a-z]+) (\d{1,2}))(,? )(\d{4})", value)
    name = (m[3] or m[4]) if m else ""
    month = next((k for k, x in enumerate(_MONTHS, 1) if name.lower() in (x, x[:3])), 0)
    new = month and _day(int(m[7]), month, int(m[1] or m[5]), to)
    if not new:
        return None
    word = _MONTHS[new.month - 1][: 3 if len(name) == 3 and name.lower() != "may" else 9]
    word = word.upper() if name.isupper() else word.title() if name[0].isupper() else word
    return (f"{new.day}{m[2]}{word}" if m[1] else f"{word} {new.day}") + f"{m[6]}{new.year}"


_NAMES = "|".join([*(x.title() for x in _MONTHS), *(x[:3].title() for x in _MONTHS)])
_DIGIT = re.compile("[0-9]")
_GROUP = re.compile("[0-9]+")
#: Patterns in order of precedence; a later one leaves what an earlier one took.
_FINDERS: tuple[tuple[str, re.Pattern[str], Callable[[str, Permute], str | None]], ...] = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), _email),
    ("card", re.compile(r"(?<![\w.-])(?=[0-9](?:[ -]?[0-9]){12})[0-9]+(?:[ -][0-9]+)*(?![\w-]|\.[0-9])"), _card),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), _iban),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _ssn),
    ("phone", re.compile(r"(?<![\w.(-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9])"), _phone),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"), _ip),
    ("date", re.compile(rf"(?<![\w.-])(?:[0-9]{{4}}([-/.])[0-9]{{1,2}}\1[0-9]{{1,2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\2[0-9]{{4}}|[0-9]{{1,2}}\.? (?:{_NAMES}),? [0-9]{{4}}|(?:{_NAMES}) [0-9]{{1,2}},? [0-9]{{4}})(?![\w-]|\.[0-9])"), _date),
)


def find(text: str, to: Permute) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of a text's validated values, in order and apart from each other."""
    found: list[tuple[int, int, str, str]] = []
    if not _DIGIT.search(text):  # all but addresses have digits
        finders = _FINDERS[:1] if "@" in text else ()
    else:
        finders = _FINDERS if "@" in text else _FINDERS[1:]
    for kind, pattern, pseudonym in finders:
        # Spans of a kind come in order and apart, so one walk along what is taken tells which are free.
        now, at = [], 0
        for m in pattern.finditer(text):
            spans = [(m.start() + a, m.start() + b) for a, b in _card_spans(m.group())] if kind == "card" else [m.span()]
            for a, b in spans:
                while at < len(found) and found[at][1] <= a:
                    at += 1
                if (at == len(found) or b <= found[at][0]) and (new := pseudonym(text[a:b], to)) is not None:
                    now.append((a, b, kind, new))
        if now:
            found = sorted(found + now)
    return found


def _runner(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[int, int, str], int] = {}

        def to(x: int, n: int, tweak: str) -> int:
            if (at := (x, n, tweak)) not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[at] = permute(x, n, key, tweak)
            return memo[at]

        for part in slices(batches):
            texts, spans, counts = [], [], []
            for text in part.column(1).to_pylist():
                found = find(text, to) if text else []
                out, last = [], 0
                for a, b, _, new in found:
                    out += [text[last:a], new]
                    last = b
                texts.append("".join([*out, text[last:]]) if found else text)
                spans.append(",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in found))
                counts.append([sum(k == kind for _, _, k, _ in found) for kind in KINDS])
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.string()), *columns], names=["doc_id", "text", "spans", *(f"n_{k}" for k in KINDS)])

    return run


def pseudonymise(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, spans, n_email, ...``: one row for each input row.

    ``key`` is the secret that undoes the pseudonyms; it may not be empty.
    ``spans`` joins ``kind:start:end`` in the original text.  Dates from 1900 to
    2099 are dates; a day and month of two digits are read day first, and an
    e-mail address keeps its domain.  A null text stays
    null and an empty one empty, without spans; repeated rows get a row each;
    other columns are not read.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(_runner(key)), f"doc_id long, text string, spans string, {counts}")
