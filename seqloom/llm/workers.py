"""Memory of Python workers: they outlive their tasks, and what their C library and Arrow keep stands beside later steps."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of input whose freed memory a worker may keep between small pieces of work.
_LEAST = 8 << 20
_since = 0


def give_back(handled: int = _LEAST) -> None:
    """Return freed memory to the system, once ``handled`` bytes of input have come to ``_LEAST`` since the last time."""
    global _since
    _since += handled
    if _since < _LEAST:
        return
    _since = 0
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives back at the end of a task what its batches took."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole
