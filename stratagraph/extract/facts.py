"""What front ends emit: rows of facts about files, with paths that are still to be looked up."""

from __future__ import annotations

import json
from functools import lru_cache

#: Around a path in a name that a join with the list of files is to resolve.
MARK = "\x01"

#: The columns of the rows that are kept as tuples, by kind. What follows from others, or is null in all rows, is added by producers.py.
SYMBOL = ("confidence", "symbol_kind", "name", "qualified_name", "at_file", "at_line", "end_line", "line_count", "exported", "doc", "owning_class", "tags")
EDGE = (
    "confidence", "edge_kind", "src_symbol", "dst_symbol", "at_file", "at_line", "evidence", "resolution_kind", "access_path", "log_level", "template", "subsystem", "registration_api", "tags",
    "needs", "rank", "otherwise_dst", "otherwise_confidence", "otherwise_kind",
)
TYPE = ("confidence", "type_kind", "spelling", "symbol_name")

_NOTHING = (None, None, None)
_json = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


@lru_cache(4096, typed=True)
def _few_tags(*flat) -> str | None:
    """Names, then as many values; those of None aren't kept."""
    n = len(flat) // 2
    kept = {k: v for k, v in zip(flat[:n], flat[n:]) if v is not None}
    return _json(kept) if kept else None


def _tags(tags: dict) -> str | None:
    try:
        return _few_tags(*tags, *tags.values())
    except TypeError:  # a list among them
        return _json({k: v for k, v in tags.items() if v is not None})


class Facts:
    """Facts of one file or of several, of all kinds or of those that are asked for."""

    def __init__(self, producer: str, kept: tuple[str, ...] = ("symbol", "edge", "type")):
        self.producer = producer
        self.symbols: list[tuple] = []
        self.edges: list[tuple] = []
        self.types: list[tuple] = []
        for kind in {"symbol", "edge", "type"}.difference(kept):
            setattr(self, kind, lambda *_, **__: None)

    def __len__(self) -> int:
        return len(self.symbols) + len(self.edges) + len(self.types)

    @property
    def kinds(self) -> tuple[tuple[str, tuple[str, ...], list[tuple]], ...]:
        return ("symbol", SYMBOL, self.symbols), ("edge", EDGE, self.edges), ("type", TYPE, self.types)

    @property
    def rows(self) -> list[dict]:
        """The facts as FACTS names their columns."""
        names = {"symbol": {"at_file": "file_path", "at_line": "line"}, "edge": {"at_file": "site_file", "at_line": "site_line"}, "type": {}}
        return [{"kind": kind} | dict(zip([names[kind].get(c, c) for c in columns], row)) for kind, columns, rows in self.kinds for row in rows]

    def mark(self) -> tuple[int, ...]:
        return tuple(len(rows) for _, _, rows in self.kinds)

    def back(self, mark: tuple[int, ...]) -> None:
        """Forgets what came after a mark."""
        for (_, _, rows), n in zip(self.kinds, mark):
            del rows[n:]

    def path_mark(self, path: str, language: str = "js", fallback: str | None = None) -> str:
        """A path to look up: how its language finds files, the path, and what stands for it if there is no file."""
        return f"{MARK}{language}|{path}|{path if fallback is None else fallback}{MARK}"

    def symbol(self, kind: str, name: str, path: str, line: int, *, end_line: int | None = None, line_count: int | None = None, exported: bool | None = None, doc: str | None = None, owning_class: str | None = None, confidence: float = 1.0, qualified_name: str | None = None, **tags) -> None:
        self.symbols.append((confidence, kind, name, qualified_name or name, path, line, end_line, line_count, exported, doc, owning_class, _tags(tags) if tags else None))

    def type(self, kind: str, name: str) -> None:
        self.types.append((1.0, kind, name, name))

    def edge(self, kind: str, src: str | None, dst: str | None, confidence: float, path: str, line: int, *, evidence: bool = False, resolution_kind: str | None = None, access_path: str | None = None, log_level: str | None = None, template: str | None = None, subsystem: str | None = None, registration_api: str | None = None, otherwise: tuple[str, float, str] | None = None, needs: str | None = None, rank: int | None = None, **tags) -> None:
        """otherwise: the target, confidence and resolution kind if a marked path has no file. needs: a set of names that the target must be in; rank: its place among several, of which the first one counts."""
        self.edges.append((confidence, kind, src, dst, path, line, evidence, resolution_kind, access_path, log_level, template, subsystem, registration_api, _tags(tags) if tags else None, needs, rank, *(otherwise or _NOTHING)))
