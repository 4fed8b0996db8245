"""Inputs that an operator once left out."""

from __future__ import annotations

import random
import re
import textwrap
from importlib.resources import files

from simloom.llm.decontam import leaks
from simloom.llm.htmltext import main_text
from simloom.llm.licenses import FILES, licenses
from simloom.llm.pii import TEST_KEY, find, permute


def _to(x, n, t):
    return permute(x, n, TEST_KEY, t)


def test_phones_of_any_area_code():
    for text in ("+1 (017) 555-7713", "(017) 555-7713", "917-055-7713", "000.000.0000"):
        ((a, b, kind, new),) = find(text, _to)
        assert kind == "phone" and (a, b) == (0, len(text)) and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", text)


def test_cards_beside_other_numbers_and_with_any_first_digit():
    for text, card in (
        ("9807915762804495 123", "9807915762804495"), ("12 4111 1111 1111 1111", "4111 1111 1111 1111"), ("4111-1111-1111-1111-12", "4111-1111-1111-1111"),
        ("7 378282246310005 2024 4111111111111111 88", "378282246310005"), ("0000 0000 0000 0018", "0000 0000 0000 0018"), ("12345 3782 822463 10005", "3782 822463 10005"),
        ("1 4111 1111 1111 1111 and 1234 567", "4111 1111 1111 1111"),
    ):
        found = {text[a:b]: new for a, b, kind, new in find(text, _to) if kind == "card"}
        assert card in found and found[card] == find(card, _to)[0][3], text
    assert [text for text in ("555-123-4567 555-123-4568", "10 20 30 40 50 60 70 81") if any(k == "card" for _, _, k, _ in find(text, _to))] == []


WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("ba", "den", "fur", "gol", "hin", "jas")]


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_partial_passages_at_all_offsets(spark):
    rng = random.Random(11)
    item = _prose(rng, 60)
    texts = [f"{_prose(rng, 15)} {item[a : a + n]} {_prose(rng, 15)}" for n in (55, 75, 100) for a in range(len(item) - n)]
    got = {r.doc_id for r in leaks(_docs(spark, texts), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == set(range(len(texts)))


def test_copies_with_replaced_words(spark):
    rng = random.Random(12)
    items = [_prose(rng, 45) for _ in range(40)]
    texts = []
    for k, item in enumerate(items):
        words = item.split()
        for at in range(k % 10, len(words), 10):
            words[at] = "".join(rng.choice("uvwxyz") for _ in range(6))
        texts.append(f"{_prose(rng, 20)} {' '.join(words)} {_prose(rng, 20)}")
    clean = [_prose(rng, 300) for _ in range(20)]
    got = {(r.doc_id, r.item_id) for r in leaks(_docs(spark, texts + clean), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(40)}


def test_short_passage_around_a_replaced_word(spark):
    rng = random.Random(13)
    words = _prose(rng, 13).split()
    words[6] = "zzzzz"
    bench = spark.createDataFrame([(0, f"{_prose(rng, 9)} {' '.join([*words[:6], 'rajas', *words[7:]])} {_prose(rng, 9)}")], "item_id long, text string")
    (row,) = leaks(_docs(spark, [f"{_prose(rng, 30)} {' '.join(words)} {_prose(rng, 30)}"]), bench).collect()
    assert 0 < row.edits <= 6 or row.edits == 0 and 0 < row.coverage < 1


LONG = [f"Paragraph {k} tells of rivers, hills, and towns; it goes on for a while, and it has marks. It ends here, at last." for k in range(8)]
BEFORE, AFTER = "<nav><a href=/>Home</a></nav><div><a href=/a>One</a></div><div><a href=/b>Two</a></div>", "<div><a href=/c>Three</a></div><footer>All rights</footer>"


def _p(texts):
    return "".join(f"<p>{x}</p>" for x in texts)


def _article(body):
    return main_text(f"<html><head><title>T</title></head><body>{BEFORE}{body}{AFTER}</body></html>")


def test_pages_without_article_or_main():
    whole = " ".join(["Title", "Lead.", *LONG, "End."])
    # A heading, a lead and an end outside the container of the text.
    assert _article(f"<div id=content><h1>Title</h1><p>Lead.</p><div class=text>{_p(LONG)}</div><p>End.</p></div>") == whole
    # Two containers of 65 % and 35 %.
    assert _article(f"<div id=content><h1>Title</h1><p>Lead.</p><div>{_p(LONG[:5])}</div><div>{_p(LONG[5:])}</div><p>End.</p></div>") == whole
    # No container but the body: what stands between is kept, with the heading before.
    short = [*LONG[:4], "Part two", "Yes.", *LONG[4:]]
    body = f"<h1>Title</h1><p>Lead.</p>{_p(LONG[:4])}<h2>Part two</h2><p><b>Yes.</b></p>{_p(LONG[4:])}"
    assert _article(body) == " ".join(["Title", "Lead.", *short])
    # Two containers in the body.
    assert _article(f"<h1>Title</h1><div>{_p(LONG[:5])}</div><h2>Part two</h2><div>{_p(LONG[5:])}</div>") == " ".join(["Title", *LONG[:5], "Part two", *LONG[5:]])


APACHE = """Copyright 2020 A

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_whole_licences_and_commented_headers(spark):
    texts = {spdx: (files("simloom.llm") / "licence_texts" / f"{spdx}.txt").read_text() for spdx in FILES}
    docs = [(spdx, text.replace("<year> <owner>", "2020 A")) for spdx, text in texts.items()]
    docs += [(spdx, "\n\n".join(textwrap.fill(x, width) for x in texts[spdx].strip().split("\n\n"))) for spdx in ("BSD-2-Clause", "BSD-3-Clause") for width in (62, 72, 79)]
    docs += [("Apache-2.0", APACHE), ("Apache-2.0", "\n".join(f"# {x}" for x in APACHE.split("\n")) + "\n\nimport os\n"), ("MIT", "# Copyright 2020 A\n# Licensed under the MIT License.\n\nimport os")]
    got = [(r.doc_id, r.license) for r in licenses(_docs(spark, [t for _, t in docs])).collect()]
    assert sorted(got) == [(k, spdx) for k, (spdx, _) in enumerate(docs)]
