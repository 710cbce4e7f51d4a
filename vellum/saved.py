"""Saved queries: name and text, in a JSON file."""

from __future__ import annotations

import json
from pathlib import Path


class SavedQueryError(ValueError):
    """A saved query is not there, or can't be saved."""


class SavedQueries:
    """Every change is saved at once; a file that can't be read counts as empty."""

    def __init__(self, path: str | Path | None = None):
        self.path = Path(path) if path else None
        self.entries: dict[str, str] = {}
        if self.path and self.path.exists():
            try:
                read = json.loads(self.path.read_text(encoding="utf-8"))
                self.entries = {str(k): str(v) for k, v in read.items()}
            except (ValueError, AttributeError, OSError):
                self.entries = {}

    def _write(self) -> None:
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(json.dumps(self.entries, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")

    def save(self, name: str, text: str) -> None:
        if not name or not name.strip():
            raise SavedQueryError("A query name can't be blank")
        if not text or not text.strip():
            raise SavedQueryError("A query can't be blank")
        self.entries[name.strip()] = text.strip()
        self._write()

    def get(self, name: str) -> str | None:
        return self.entries.get(name)

    def has(self, name: str) -> bool:
        return name in self.entries

    def delete(self, name: str) -> None:
        if name not in self.entries:
            raise SavedQueryError(f"Query not found: {name}")
        del self.entries[name]
        self._write()

    def all(self) -> dict[str, str]:
        return dict(self.entries)

    def __len__(self) -> int:
        return len(self.entries)

    def listing(self) -> str:
        if not self.entries:
            return "No saved queries."
        return "\n".join(["Saved queries:", *(f"  {n}: {t}" for n, t in self.entries.items())])
