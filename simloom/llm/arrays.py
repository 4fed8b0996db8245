"""UTF-8 text in Arrow buffers, as NumPy arrays of bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this worker until another operator's task or key takes its place."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False):
    """``run`` as a task whose memory goes back to the system when it ends.

    Workers live on between tasks and beside each other; what they hold without
    need is taken from the others of their machine.  Only a task that ``keeps``
    leaves what ``kept`` holds.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _kept and not keeps:
            _kept.clear()
            gc.collect()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that a slice has about ``limit`` bytes of text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(lengths(column))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and the n + 1 offsets of the texts in them."""
    if column.null_count:
        column = column.fill_null("")
    sizes = lengths(column)
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    wide = pa.types.is_large_string(column.type)
    index = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    start = int(index[column.offset]) if len(column) else 0
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[start : start + int(offsets[-1])], offsets


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x
