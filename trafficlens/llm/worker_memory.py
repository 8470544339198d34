"""Memory of Python workers: what they keep from task to task, and what goes back to the system.

Spark keeps a worker for later tasks, those of other operators too. Left alone, it would hold what every operator loaded
into it and the most that any task needed at a time, next to an executor that does not shrink either. A worker
therefore keeps one operator's vocabulary, a task that needs none drops it, and the free memory of a finished task
goes back to the system.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa

X, In, Out = TypeVar("X"), TypeVar("In"), TypeVar("Out")

_HELD: dict[tuple[str, str], object] = {}


def held(kind: str, path: str, load: Callable[[str], X]) -> X:
    """What was loaded from ``path``, kept in this process for later tasks instead of what it kept before."""
    if (kind, path) not in _HELD:
        _HELD.clear()
        _HELD[kind, path] = load(path)
    return _HELD[kind, path]


def drop_all_but(keeps: str | None) -> None:
    """Let go of everything held but what is held as ``keeps``."""
    for kind, path in list(_HELD):
        if kind != keeps:
            del _HELD[kind, path]


def give_back() -> None:
    """Return free memory to the system: allocators keep it for themselves, wherever one small value stands behind it."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)


def tidy(task: Callable[[Iterator[In]], Iterator[Out]], keeps: str | None = None) -> Callable[[Iterator[In]], Iterator[Out]]:
    """``task`` (batches in, batches out) for a worker that keeps only what is held as ``keeps``, and no free memory."""

    def run(batches: Iterator[In]) -> Iterator[Out]:
        drop_all_but(keeps)  # by a call: this function travels by value, with copies of the globals it names
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
