"""A small driver-side cache of results, by name and parameters, with a time to live."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from typing import Any


class TtlCache:
    """Keeps results for ttl seconds. Only small, collected results belong here; tables stay in Spark."""

    def __init__(self, ttl: float = 3600, clock: Callable[[], float] = time.time) -> None:
        self.ttl, self.clock, self.held, self.hits, self.misses = ttl, clock, {}, 0, 0

    @staticmethod
    def key(name: str, **params: Any) -> str:
        """name and eight hex digits of the sorted parameters."""
        return f"{name}:{hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:8]}"

    def get(self, key: str) -> Any:
        """The held value, or None if there is none or it is too old."""
        found = self.held.get(key)
        if found is None or self.clock() - found[0] > self.ttl:
            self.held.pop(key, None)
            self.misses += 1
            return None
        self.hits += 1
        return found[1]

    def set(self, key: str, value: Any) -> None:
        self.held[key] = (self.clock(), value)

    def get_or_compute(self, name: str, compute: Callable[..., Any], **params: Any) -> Any:
        key = self.key(name, **params)
        found = self.get(key)
        if found is None:
            found = compute(**params)
            self.set(key, found)
        return found

    def invalidate(self, prefix: str = "") -> int:
        """Drop entries whose key starts with prefix; how many."""
        gone = [k for k in self.held if k.startswith(prefix)]
        for k in gone:
            del self.held[k]
        return len(gone)

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"entries": len(self.held), "hits": self.hits, "misses": self.misses, "hit_rate_pct": round(100 * self.hits / asked, 2) if asked else 0.0}
