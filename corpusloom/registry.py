"""Names for things that plans and SQL can ask for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any


class Registry(Mapping):
    """Named entries of one kind; a name is given once, and an unknown one is answered with those there are."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._entries: dict[str, Any] = {}

    def register(self, name: str) -> Callable[[Any], Any]:
        """Decorator that enters what it decorates under ``name``."""

        def enter(entry: Any) -> Any:
            if name in self._entries:
                raise ValueError(f"{name!r} is already an {self.kind}")
            self._entries[name] = entry
            return entry

        return enter

    def __getitem__(self, name: str) -> Any:
        if name not in self._entries:
            raise KeyError(f"{name!r} is no {self.kind}; there are {', '.join(sorted(self._entries)) or 'none'}")
        return self._entries[name]

    def __contains__(self, name: object) -> bool:
        return name in self._entries

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)

    def build(self, name: str, *args: Any, **kwargs: Any) -> Any:
        return self[name](*args, **kwargs)
