"""A small cache of records on the driver, least recently used out first."""

from __future__ import annotations

import copy
import threading
from collections import OrderedDict


class LRUCache:
    def __init__(self, max_size: int = 1024):
        if max_size < 1:
            raise ValueError("max_size must be 1 or more")
        self._most, self._records, self._lock = max_size, OrderedDict(), threading.Lock()
        self.reset_stats()

    def get(self, key):
        with self._lock:
            if key not in self._records:
                self._misses += 1
                return None
            self._hits += 1
            self._records.move_to_end(key)
            return copy.deepcopy(self._records[key])

    def put(self, key, record) -> None:
        with self._lock:
            self._records[key] = copy.deepcopy(record)
            self._records.move_to_end(key)
            while len(self._records) > self._most:
                self._records.popitem(last=False)

    def invalidate(self, key) -> None:
        with self._lock:
            self._records.pop(key, None)

    def invalidate_many(self, keys) -> None:
        for key in keys:
            self.invalidate(key)

    def clear(self) -> None:
        with self._lock:
            self._records.clear()

    def warm(self, records: dict) -> None:
        for key, record in records.items():
            self.put(key, record)

    @property
    def size(self) -> int:
        return len(self._records)

    @property
    def max_size(self) -> int:
        return self._most

    @property
    def hit_rate(self) -> float:
        asked = self._hits + self._misses
        return self._hits / asked if asked else 0.0

    def stats(self) -> dict:
        return {"size": self.size, "max_size": self.max_size, "hits": self._hits, "misses": self._misses, "hit_rate": self.hit_rate}

    def reset_stats(self) -> None:
        self._hits = self._misses = 0
