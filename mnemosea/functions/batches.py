"""Record batches of bounded size in bytes: Spark bounds them by rows, and texts are of any length."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a Python worker handles at a time.
CHUNK_BYTES = 2 << 20


def sliced(batches: Iterable[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut and joined so that each holds about ``size`` bytes of ``column``
    (a single longer value stays whole)."""
    held: list[pa.RecordBatch] = []
    room = size
    give_back()
    for batch in batches:
        start = 0
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)))
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + room, side="right"))
            if stop == start and not held:
                stop = start + 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                room -= int(ends[stop - 1] - base)
                start = stop
            if start < batch.num_rows or room <= 0:
                yield joined(held)
                held, room = [], size
    if held:
        yield joined(held)
    held.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on from task to task and from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def byte_lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
