"""One large object a worker: what an operator builds once is kept until another operator of the same worker needs the room."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_ONE: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    if key not in _ONE:
        _ONE.clear()
        _ONE[key] = make()
    return _ONE[key]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, which gives freed memory back at the end of a task: a worker lives on, and its next operator needs other arrays."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return tidied
