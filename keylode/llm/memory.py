"""Python workers live on after a task; what a task has freed goes back to the system."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    name = ctypes.util.find_library("c") or "libc.so.6"
    try:
        ctypes.CDLL(name).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back
        pass


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives back what it has freed when it ends."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return whole
