"""Where a result's JSON text goes."""

from __future__ import annotations

import json
from pathlib import Path


class OutputError(RuntimeError):
    """A place for output that is not there."""


def pretty(text: str) -> str:
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)


def emit(text: str, file: str | None = None, clipboard: bool = False, indent: bool = False) -> None:
    """To a file, which is overwritten, or to standard output where no other place is named."""
    out = pretty(text) if indent else text
    if file:
        path = Path(file)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(out, encoding="utf-8")
        print(f"Output written to: {path.resolve()}")
    if clipboard:
        raise OutputError("A clipboard needs a desktop; write to a file instead")
    if not file:
        print(out)
