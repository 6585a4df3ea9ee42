"""Memory of Python workers, which Spark reuses from one operator to the next."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_owner: list[str | None] = [None]
_tables: list[Callable[[], None]] = []


def keeps(clear: Callable[[], None]) -> None:
    """Register what drops the tables that a module keeps between tasks."""
    _tables.append(clear)


def claim(owner: str) -> None:
    """Called where an operator's work begins in a worker: tables of another operator are dropped."""
    if _owner[0] not in (None, owner):
        for clear in _tables:
            clear()
        trim()
    _owner[0] = owner


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
