"""What tasks of one operator leave in a reused Python worker, and when it goes."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

#: What an operator's tasks keep for its later tasks in the same worker (tokenizers and their memos).
KEPT: dict = {}
_operator: str | None = None


def begin(operator: str) -> None:
    """Called as a task begins; if the worker served another operator before, its remains are freed.

    Workers outlive their tasks, so memory would otherwise be the sum over all the
    operators that a session has run, not that of the present one.
    """
    global _operator
    if _operator not in (None, operator):
        KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library than glibc
            pass
    _operator = operator
