"""What a Python worker keeps from task to task: one thing at a time, since workers are used again by all kinds of tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable

_held: dict = {}


def held(key: Hashable, make: Callable[[], object]):
    """The worker's object for ``key``; whatever it held for another key is let go first."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Memory:
    """Remembered values in two generations of at most ``most`` bytes together.

    When the newer generation has had its half, it becomes the older one, and what was older is forgotten unless it is
    asked for again meanwhile; so frequent keys stay.
    """

    def __init__(self, most: int):
        self.most, self.newer, self.older, self.size = most, {}, {}, 0

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that are not remembered; the others are in ``newer`` afterwards, until the next ``add``."""
        older, newer = self.older, self.newer
        unknown = set()
        for key in keys.difference(newer):
            if key in older:
                newer[key] = older.pop(key)
            else:
                unknown.add(key)
        return unknown

    def add(self, found: dict, cost: int) -> None:
        """Remember ``found``, which takes about ``cost`` bytes; generations pass before it."""
        if self.size + cost > self.most // 2:
            self.older, self.newer, self.size = self.newer, {}, 0
        self.newer.update(found)
        self.size += cost


def trim() -> None:
    """Give what this worker has freed back to the system: workers live on after their tasks, beside those of other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if give_back is not None:
        give_back(0)


def release() -> None:
    """Forget the object that the worker holds for another operator, and :func:`trim`."""
    _held.clear()
    trim()
