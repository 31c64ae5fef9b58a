"""Giving memory back to the machine between the tasks of a Python worker.

Workers are kept for later tasks, and allocators keep what they have freed, so an idle
worker would hold the most that any of its tasks has needed.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


@functools.cache
def _malloc_trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def trim() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def trimmed(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function over batches, with its memory given back at the end of a task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            trim()

    return run
