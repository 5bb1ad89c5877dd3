"""What a Python worker keeps between tasks: the caches of one operator at a time.

Spark uses its Python workers again for whatever task comes next. A cache that serves all tasks of one operator would
otherwise stay beside those of the next one, and memory would add up over the stages of a pipeline.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa

#: Bytes of an array that is given back to the system when it is freed.
GIVEN_BACK = 1 << 21
#: Fixed value: the number of that setting in the C library.
_MMAP_THRESHOLD = -3

_STATE = {"owner": ""}
_FORGET: list[Callable[[], None]] = []


def forgets(forget: Callable[[], None]) -> None:
    """Register how a cache is emptied."""
    _FORGET.append(forget)


def only(owner: str) -> None:
    """To be called when a task of ``owner`` starts: whatever other operators keep in this worker goes, and memory that no
    longer holds anything goes back to the system."""
    libc = _libc()
    if owner != _STATE["owner"]:
        _STATE["owner"] = owner
        for forget in _FORGET:
            forget()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if libc is not None:
        libc.malloc_trim(0)


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    """The C library, told to give large arrays back as they are freed. Left alone, its allocator raises that size as it
    goes, and a worker then keeps the most that any of its tasks has held. Null where the library has no such settings."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_MMAP_THRESHOLD, GIVEN_BACK)
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return libc
