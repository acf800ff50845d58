"""Which repositories have an index: a small JSON file, newest first, replaced as a whole."""

from __future__ import annotations

import json
import os
import time


class Registry:
    def __init__(self, path: str):
        self.path = path

    def _read(self) -> dict[str, dict]:
        try:
            with open(self.path, encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return {}

    def _write(self, rows: dict[str, dict]) -> None:
        with open(self.path + ".new", "w", encoding="utf-8") as f:
            json.dump(rows, f, indent=1, sort_keys=True)
        os.replace(self.path + ".new", self.path)

    def register(self, root: str, **stats) -> None:
        self._write(self._read() | {os.path.realpath(root): {"t": time.time(), **stats}})

    def unregister(self, root: str) -> bool:
        rows = self._read()
        found = rows.pop(os.path.realpath(root), None) is not None
        self._write(rows)
        return found

    def list(self) -> list[dict]:
        """Those that are still there, newest first."""
        rows = {p: r for p, r in self._read().items() if os.path.isdir(p)}
        return sorted(({"root": p, **r} for p, r in rows.items()), key=lambda r: -r["t"])


def resolve_root(path: str, marker: str = ".tarnwick") -> tuple[str, str] | None:
    """The nearest folder above that holds an index, and the rest of the path."""
    at = os.path.realpath(path)
    while True:
        if os.path.isdir(os.path.join(at, marker)):
            return at, os.path.relpath(os.path.realpath(path), at)
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up
