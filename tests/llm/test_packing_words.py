"""What a worker remembers of words between tasks."""

from __future__ import annotations

from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa

from simloom.llm import packing


def test_words_stay_known_from_task_to_task(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    learned, learn = [], packing.WordIds._learn
    monkeypatch.setattr(packing.WordIds, "_learn", lambda self, words: (learned.extend(words), learn(self, words)))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["Remembered zyzzogeton, qwertification.", "qwertification again"])], names=["doc_id", "text"])
    run = lambda: [b.to_pylist() for b in packing._runner(public_tokenizers.path("word_bpe_49k.json"), 2048, 1, True)(iter([batch]))]
    first, many = run(), len(learned)
    assert run() == first and many == len(learned)
