"""The graph of words of conversations."""

from __future__ import annotations

from simloom.plans.catalog import QUERIES
from simloom.plans.relations import word_graph

ROWS = [
    (1, 1, "user", "Red apple red"), (1, 1, "user", "apple pie"), (1, 1, "assistant", "red"), (1, 2, "assistant", "green pear"), (1, 2, "user", "pear"), (1, 2, None, "pear"), (1, 3, "assistant", "plum"),
    (None, 1, "user", "lost"), (2, None, "user", "lost"), (2, 1, "user", None), (2, 2, "assistant", "plum"),
]


def _folder(spark, tmp_path):
    spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_words_count_once_for_each_turn_and_role(spark, tmp_path):
    found = {(r.src, r.dst): r.w for r in word_graph(spark, _folder(spark, tmp_path)).collect()}
    expected = {(a, b): w for a in ("red", "apple", "pie") for b, w in (("green", 1.0), ("pear", 3.0))}
    assert found == expected | {("pear", "plum"): 1.0}


def test_pairs_of_words_are_made_once(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    files = QUERIES["g7_ppmi_words"](spark, folder).inputFiles()
    assert files and not any("conversations.parquet" in f for f in files)
