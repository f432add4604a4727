"""Memory of Python workers, which Spark uses again for one operator after another."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None] = lambda: None) -> None:
    """Called when a task begins: what other operators keep in this worker is let go."""
    others = [n for n in _held if n != owner]
    for name in others:
        _held.pop(name)()
    if others:
        gc.collect()
    trim()
    _held[owner] = release


def trim() -> None:
    """Gives free memory back to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
