"""Named operators with defaults, docs and aliases (X1) and named fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Entry:
    name: str
    run: Callable[..., DataFrame]
    defaults: dict = field(default_factory=dict)
    doc: str = ""


class Registry:
    """Names are case-insensitive; neither a name nor an alias can be taken twice."""

    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}
        self._aliases: dict[str, str] = {}

    def register(self, name: str, run: Callable[..., DataFrame], defaults: dict | None = None, aliases: tuple[str, ...] = ()) -> Callable[..., DataFrame]:
        keys = [name.lower(), *(a.lower() for a in aliases)]
        for key in keys:
            if key in self._entries or key in self._aliases:
                raise ValueError(f"already registered: {key}")
        self._entries[keys[0]] = Entry(name, run, dict(defaults or {}), (run.__doc__ or "").strip())
        self._aliases |= {a: keys[0] for a in keys[1:]}
        return run

    def get(self, name: str) -> Entry:
        key = name.lower()
        return self._entries[self._aliases.get(key, key)]

    def names(self) -> list[str]:
        return sorted(self._entries)

    def apply(self, name: str, *frames: DataFrame, **params) -> DataFrame:
        entry = self.get(name)
        return entry.run(*frames, **(entry.defaults | params))


#: Operators by name; fields are functions (nodes, edges, ...) -> (node, value).
operators, fields = Registry(), Registry()
