"""Memory of Python workers, which outlive the stages that use them."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def trim_memory() -> None:
    """Give the free pages of Arrow's pool and of the allocator back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def trimmed(work):
    """``work`` of Arrow batches (or frames) whose worker gives its free memory back when a task ends.

    Workers outlive stages.  Within a task the last piece is still held when
    its texts end; only behind the task is all that it made free.
    """

    def run(batches):
        try:
            yield from work(batches)
        finally:
            trim_memory()

    return run
