"""A bounded cache for values that recur by Zipf's law."""

from __future__ import annotations

from collections.abc import Callable


class Recent(dict):
    """``cache[key]`` computes a missing value; two generations keep what was used lately.

    At ``limit`` entries the young generation becomes the old one, and entries that are used again move back, so frequent
    keys stay and at most twice ``limit`` entries are held.
    """

    def __init__(self, compute: Callable, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
