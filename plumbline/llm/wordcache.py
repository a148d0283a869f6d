"""A bound for caches of words in Python workers, in bytes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Collection

#: Of one cache in one worker.
CACHE_BYTES = 24 << 20
#: Two small objects and their place in a dictionary.
ENTRY_BYTES = 180


class WordCache:
    """``known`` is a plain dictionary, for speed; whoever puts words into it says so, and asks for room beforehand.

    When it holds half of the bound, it becomes the older half, and a new one is begun. Words that are asked for again
    are recalled from the older half, the others go with it.
    """

    def __init__(self, max_bytes: int = CACHE_BYTES):
        self.known: dict = {}
        self.older: dict = {}
        self.max_bytes, self.held = max_bytes, 0

    def make_room(self) -> None:
        if self.held > self.max_bytes // 2:
            self.known, self.older, self.held = {}, self.known, 0

    def recall(self, missing: set) -> set:
        """The words of ``missing`` that the older half lacks as well; the others are known again."""
        found = {w: self.older[w] for w in missing if w in self.older} if self.older else {}
        if found:
            self.note(found)
            self.known.update(found)
            missing = missing.difference(found)
        return missing

    def note(self, words: Collection) -> None:
        self.held += ENTRY_BYTES * len(words) + sum(map(len, words))

    def forget(self) -> None:
        self.known, self.older, self.held = {}, {}, 0


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return freed memory to the system at the end of a task, as a worker lives on for tasks of other kinds."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)
