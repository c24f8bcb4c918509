"""What a Python worker keeps from task to task.

Spark reuses workers, so what an operator keeps for its next task would still lie there when another operator's
tasks begin. A worker keeps the things of one operator at a time: where another begins, they are dropped
and freed memory is given back to the system.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_state: dict[str, str | None] = {"owner": None}
_drops: list[Callable[[], None]] = []


def drops(function: Callable[[], None]) -> Callable[[], None]:
    """Register what is to be called when another operator begins."""
    _drops.append(function)
    return function


def give_back() -> None:
    """Return freed memory to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def begin(owner: str) -> None:
    """A task of the operator begins in this worker."""
    if _state["owner"] not in (None, owner):
        for drop in _drops:
            drop()
        give_back()
    _state["owner"] = owner
