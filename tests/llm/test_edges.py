"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from simloom.llm.decontam import leaks
from simloom.llm.htmltext import extract
from simloom.llm.langid import identify
from simloom.llm.licenses import licenses
from simloom.llm.minhash import near_duplicates
from simloom.llm.packing import pack
from simloom.llm.pii import TEST_KEY, pseudonymise
from simloom.llm.pivots import near_vectors
from simloom.llm.queries import tokenizer_path
from simloom.llm.secrets import redact, secrets
from simloom.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, component long, key long, label string"
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 4000


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.5, True, 1, 2, "x") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    plain = "the quick brown fox jumps over the lazy dog near the river bank"
    return _docs(
        spark,
        [
            (1, plain, "en", "a"), (1, plain, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \n\t ", None, "b"), (5, LONG, "en", "c"), (None, plain, "en", "a"),
            (6, "!!! ... 123", "fr", "a"), (7, "x", "fr", "d"), (8, "le renard brun saute par dessus le chien paresseux", "fr", "d"), (9, plain.upper(), None, "e"),
        ],
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (8, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, "jumps over the lazy dog near the river bank"), (1, None), (2, ""), (3, "ab"), (None, "epsilon zeta eta theta alpha beta")], "item_id long, text string")


def _run(name, spark, docs, labels, benchmark):
    return {
        "language": lambda: identify(docs), "secrets": lambda: secrets(docs), "leaks": lambda: leaks(docs, benchmark), "pack": lambda: pack(docs, tokenizer_path()),
        "licenses": lambda: licenses(docs), "pii": lambda: pseudonymise(docs, TEST_KEY), "toxicity": lambda: toxicity(docs, labels), "minhash": lambda: near_duplicates(docs), "redact": lambda: redact(docs),
    }[name]()


NAMES = ["language", "secrets", "leaks", "pack", "licenses", "pii", "toxicity", "minhash", "redact"]


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, docs, labels, benchmark, name):
    out = _run(name, spark, docs, labels, benchmark).collect()
    if name in ("language", "secrets", "pii", "toxicity", "minhash", "redact"):
        assert len(out) == docs.count()
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    if name == "language":
        assert {r.lang_pred for k in (2, 3, 4, 6) for r in by_id[k]} == {"und"}
        assert all(0 <= r.score <= 1 for r in out)
    elif name == "minhash":
        assert {r.n_shingles for k in (2, 3, 4) for r in by_id[k]} == {0}
        assert {(r.component_id, r.kept) for k in (1, 9) for r in by_id[k]} == {(1, True), (1, False)}
        assert by_id[None][0].kept
    elif name == "pack":
        assert [(r.start, r.length, r.ids, r.doc_tokens) for r in by_id[2]] == [(0, 1, [1], 1)]
        total = {k: sum(r.length for r in of) for k, of in by_id.items()}
        assert total[1] == 2 * by_id[1][0].doc_tokens
    elif name == "leaks":
        assert {r.item_id for r in by_id[1]} == {0} and len(by_id[1]) == 2 and 8 not in by_id
        assert {r.item_id for r in by_id[5]} == {-1}
    elif name in ("pii", "redact"):
        assert by_id[2][0].text is None and by_id[3][0].text == ""
    elif name == "toxicity":
        assert {r.predicted for r in out} <= {0, 1}
        assert not by_id[None][0].held_out


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, benchmark, name):
    assert _run(name, spark, docs.limit(0), labels, benchmark).count() == 0


def test_pages(spark):
    rows = [(1, "u", None, 1), (1, "u", "", 1), (2, None, "<article><p>One. Two, three.</p></article>", 1), (3, "u", "<p>cut <b>off", 1), (4, "u", "no markup at all, but text.", 1), (5, "u", "<nav>Menu</nav>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in extract(pages).collect()) == [
        (1, "", 0), (1, "", 0), (2, "One. Two, three.", 16), (3, "cut off", 7), (4, "no markup at all, but text.", 27), (5, "", 0),
    ]
    assert extract(pages.limit(0)).count() == 0


def test_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [float("nan"), 1.0], 0), (7, [1.0, None], 0), (8, [1.0, 0.0], 1), (9, [1.0, 0.0], None),
        (10, [1.0, 0.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (11, [float("inf"), 1.0], 0), (12, [], 0),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1))
    out = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_vectors(vectors).collect()))
    assert out == [
        (0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
        (10, 1, 10, True), (10, 1, 10, True), (11, 0, 11, True), (12, 0, 12, True),
    ]
    assert near_vectors(vectors.limit(0)).count() == 0


def test_redact_keeps_columns_of_any_name(spark):
    own = "Zq8rT2kLm5Wp9XvB3nYc7"
    rows = [(1, f"a {own}", "s", 5, "x", True, 1, 2, 3), (1, "token = abcdefgh12", "s", 6, "y", False, 1, 2, 3), (2, None, None, 7, "z", None, 1, 2, 3), (3, "", "s", 8, "", True, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key long, owned_hashes string, redacted boolean, hash int, row int, `a.b` int")
    out = redact(docs)
    assert out.columns == ["doc_id", "text", "source", "key", "owned_hashes", "hash", "row", "a.b", "redacted"]
    assert sorted(((r.key, r.text, r.owned_hashes, r.redacted, r["a.b"]) for r in out.collect())) == [
        (5, "a <owned-secret>", "x", True, 3), (6, "<assign-secret>", "y", True, 3), (7, None, "z", False, 3), (8, "", "", False, 3),
    ]


PLAIN = [f"plain words of document {k} go on and on about the {w} and the other things that it holds in its many quiet rooms" for k, w in enumerate("sea hill town farm road lake wood".split())]


def _words(seed, n=8):
    rng = random.Random(seed)
    return " ".join(rng.choice("kaba loden mifur negol puhin rajas soba tiden kafur logol".split()) for _ in range(n))


@pytest.fixture()
def folder(spark, tmp_path):
    passage = "the benchmark has a question about seven grey herons that stand along the river at dawn"
    rows = [
        *((k, t, "en", "a", len(t)) for k, t in enumerate(PLAIN)), (10, PLAIN[0] + " !", "en", "b", 1), (11, PLAIN[1].upper(), None, "b", 1), (2, PLAIN[2], "en", "a", 1), (2, PLAIN[2], "en", "a", 1),
        (20, f"Before it. {passage} and after", "en", "c", 1), (21, "my password = hunter2hunter2 ok", "en", "c", 31), (30, None, None, None, None), (31, "", "en", "d", 0),
        (None, "no id here", "en", "e", 10), (None, "no id here", "en", "e", 10), (None, None, None, None, None),
        *((100 + k, f"{_words(k)} gribble {_words(50 + k)}", "en", "t", 1) for k in range(40)), *((200 + k, _words(900 + k, 30), "en", "u", 1) for k in range(120)),
    ]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, component string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(7)] + [(100 + k, 0, 1) for k in range(40)] + [(200 + k, 1, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, passage), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_of_the_pipeline(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(x for r in df.collect() if (x := -1 if r.doc_id is None else r.doc_id) < 200)
    clean = p.drop_toxic(spark, docs, folder)
    assert clean.columns == list(p.COLUMNS) and ids(clean) == sorted([-1, -1, -1, 0, 1, 2, 2, 2, 3, 4, 5, 6, 10, 11, 20, 21, 30, 31])
    single = p.drop_near_duplicates(spark, clean, folder)
    assert single.columns == list(p.COLUMNS) and ids(single) == sorted([-1, -1, 0, 1, 2, 3, 4, 5, 6, 20, 21, 30, 31])
    sound = p.drop_leaks(spark, single, folder)
    assert ids(sound) == sorted([-1, -1, 0, 1, 2, 3, 4, 5, 6, 21, 30, 31])
    kept = {r.doc_id: r for r in p.redact_secrets(spark, sound, folder).collect()}
    assert kept[21].text == "my <assign-secret> ok" and kept[21].n_chars == 21 and kept[0].text == PLAIN[0] and kept[30].text is None
    assert {r.doc_id for r in p.pack_windows(spark, sound.where("doc_id is null or doc_id < 200"), folder).collect()} == {None, 0, 1, 2, 3, 4, 5, 6, 21, 30, 31}
    whole = p.run(spark, folder).collect()
    assert len({r.doc_id for r in whole if r.doc_id is not None and r.doc_id >= 200}) == 120
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in whole if r.doc_id is None or r.doc_id < 200}) == [-1, 0, 1, 2, 3, 4, 5, 6, 21, 30, 31]


def test_stages_of_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    empty = f"{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert p.run(spark, empty).count() == 0
    # Without labels and items nothing is dropped but copies.
    assert p.drop_toxic(spark, docs, empty).count() == p.drop_leaks(spark, docs, empty).count() == docs.count()


def test_toxicity_of_odd_labels(spark):
    rows = [(k, f"you {'gribble' if k % 2 else 'friend'} there {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [k for k, _ in rows if __import__("zlib").crc32(str(k).encode()) % 5 == 0]
    for labels in ([(k, 1) for k in held], [(k, x) for k in range(60) for x in (0, 1)], [(k, 7) for k in range(60)]):
        out = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(out) == 60 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out) and {r.doc_id for r in out if r.held_out} == set(held)
