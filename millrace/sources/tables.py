"""What parsers return: tables of text cells with their place in the source."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Table:
    """rows: (line, raw text, cells); cells are text or None and as many as headers. page: slide or page, if any."""

    name: str
    method: str
    headers: list[str]
    rows: list[tuple[int, str, list[str | None]]] = field(default_factory=list)
    page: int | None = None

    @classmethod
    def of(cls, name: str, method: str, headers: Iterable[Any], rows: Iterable[Iterable[Any]], page: int | None = None, first_line: int = 1, joiner: str = " | ") -> Table:
        """Headers made clean, rows padded or cut to them."""
        heads = [str(h).strip() if h is not None and str(h).strip() else f"Col_{k}" for k, h in enumerate(headers)]
        out = []
        for k, row in enumerate(rows):
            cells = [text(v) for v in row][: len(heads)]
            cells += [None] * (len(heads) - len(cells))
            out.append((first_line + k, joiner.join(c or "" for c in cells), cells))
        return cls(name, method, heads, out, page)


@dataclass
class Extract:
    """All tables of a file; unparsed: (line, raw text, reason)."""

    tables: list[Table] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    unparsed: list[tuple[int, str, str]] = field(default_factory=list)


def text(value: Any) -> str | None:
    """A cell's text; empty counts as none, booleans and whole floats are written plainly."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    out = str(value)
    return out if out.strip() else None


def number(value: str | None) -> float | None:
    """The number that a cell's text is, if it is one; (5) is -5."""
    if value is None:
        return None
    cut = re.sub(r"[$,€£¥%\s]", "", value)
    cut = re.sub(r"^\((.*)\)$", r"-\1", cut)
    return float(cut) if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", cut) else None


def decode(data: bytes) -> str:
    """UTF-8 or UTF-16 by its mark, else UTF-8, else latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")
