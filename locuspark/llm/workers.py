"""What all operators do whose rows go through Python workers, so that a worker stays small."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

#: Rows that are taken out of Arrow at once.
SLICE_ROWS = 2000

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run, rows: int = SLICE_ROWS) -> Run:
    """run over slices of the batches.  At a task's end the worker gives back what it only needed for the time.

    Workers serve one task after the other, also of later stages, and would else keep the most that any of them took.
    """

    @wraps(run)
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.slice(lo, rows) for b in batches for lo in range(0, b.num_rows, rows))
        finally:
            give_back()

    return over


def give_back() -> None:
    """Returns unused memory to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
