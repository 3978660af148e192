"""A bounded cache of responses that forgets the least recently used."""

from __future__ import annotations

from collections import OrderedDict
from threading import Lock
from typing import Any


class ResponseCache:
    def __init__(self, capacity: int):
        self.capacity, self.hits, self.misses = capacity, 0, 0
        self._entries: OrderedDict[Any, Any] = OrderedDict()
        self._lock = Lock()

    def get(self, key: Any) -> Any | None:
        with self._lock:
            if key in self._entries:
                self._entries.move_to_end(key)
                self.hits += 1
                return self._entries[key]
            self.misses += 1
            return None

    def put(self, key: Any, value: Any) -> None:
        with self._lock:
            self._entries[key] = value
            self._entries.move_to_end(key)
            while len(self._entries) > self.capacity:
                self._entries.popitem(last=False)

    def invalidate_all(self) -> None:
        with self._lock:
            self._entries.clear()

    def __len__(self) -> int:
        return len(self._entries)
