"""Arrow batches in runs that a Python worker holds as objects."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text that become Python objects at a time; a longer text is a run of its own.
ROWS, BYTES = 500, 2 << 20


def give_back() -> None:
    """Return what was freed to the system: workers are used again, and the allocators would keep the most that any batch needed."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc has it
        trim(0)


def runs(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """All rows of batches in order, in runs bounded by rows and by the bytes of a text column; memory goes back after each batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if i > first and (i - first >= ROWS or held + size > BYTES):
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)
        del batch
        give_back()
