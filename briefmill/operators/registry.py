"""Named strategies: metrics, retrievers and generation methods that are chosen by key."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """Keys and what they stand for; a key is given once."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._entries: dict[str, Any] = {}

    def register(self, key: str) -> Callable[[Any], Any]:
        def add(entry: Any) -> Any:
            if key in self._entries:
                raise ValueError(f"{self.kind} {key!r} is registered already")
            self._entries[key] = entry
            return entry

        return add

    def get(self, key: str) -> Any:
        if key not in self._entries:
            raise KeyError(f"no {self.kind} {key!r}; there are {', '.join(self.keys()) or 'none'}")
        return self._entries[key]

    def keys(self) -> list[str]:
        return sorted(self._entries)

    def __contains__(self, key: str) -> bool:
        return key in self._entries


METRICS, RETRIEVERS, METHODS, EMBEDDERS = Registry("metric"), Registry("retriever"), Registry("method"), Registry("embedder")
