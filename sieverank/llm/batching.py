"""Working on a batch of texts in pieces of bounded size, and giving memory back."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

#: Code points that a worker takes on at once; a longer text is a piece of its own.
CHARS = 1_000_000
#: What operators keep in this worker process from task to task, and how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def slices(texts: list[str], chars: int = CHARS) -> Iterator[slice]:
    """Consecutive slices of about `chars` code points each."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if texts[start:]:
        yield slice(start, len(texts))


@functools.lru_cache(maxsize=1)
def _c_library():
    try:
        library = ctypes.CDLL(None)
        library.malloc_trim  # noqa: B018  only the GNU C library has it
    except (AttributeError, OSError):
        return None
    return library


def trim() -> None:
    """Give freed memory back to the system; worker processes live on and are used again by other operators."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if (library := _c_library()) is not None:
        library.malloc_trim(0)


def take_over(owner: str, drop: Callable[[], None] | None = None) -> None:
    """Drop what other operators kept in this worker; remember how to drop what `owner` keeps."""
    for other in [k for k in _KEPT if k != owner]:
        _KEPT.pop(other)()
    if drop is not None:
        _KEPT[owner] = drop


def tidy(run: Callable[[Iterable], Iterator], owner: str = "", drop: Callable[[], None] | None = None) -> Callable[[Iterable], Iterator]:
    """`run`, a function for mapInPandas, with memory taken over before and given back after each task."""

    def whole(batches: Iterable) -> Iterator:
        take_over(owner, drop)
        try:
            yield from run(batches)
        finally:
            trim()

    return whole
