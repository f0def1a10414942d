"""Binary workbooks (.xls): the workbook stream of a compound file, record by record."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from typing import Any

from . import office
from .tables import Extract

#: Fixed values of the format: signatures, ends of chains, record numbers.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_LAST = 0xFFFFFFFA
BOF, EOF, BOUNDSHEET, SST, CONTINUE, LABELSST, NUMBER, RK, MULRK, LABEL, BOOLERR, FORMULA, STRING, MERGED, DATEMODE, XF, FORMAT = (
    0x0809, 0x000A, 0x0085, 0x00FC, 0x003C, 0x00FD, 0x0203, 0x027E, 0x00BD, 0x0204, 0x0205, 0x0006, 0x0207, 0x00E5, 0x0022, 0x00E0, 0x041E,
)


def stream(data: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """A named stream of a compound file. ValueError if it has none, or its chains are broken."""
    if not data.startswith(MAGIC):
        raise ValueError("xls: not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    size = 1 << shift
    directory, cutoff, mini_fat, more, count = (struct.unpack_from("<I", data, k)[0] for k in (48, 56, 60, 68, 72))
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    numbers = lambda raw: struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    places = [k for k in struct.unpack_from("<109I", data, 76) if k < _LAST]
    for _ in range(count):
        held = numbers(sector(more))
        places, more = places + [k for k in held[:-1] if k < _LAST], held[-1]
    fat = [k for p in places for k in numbers(sector(p))]

    def chain(at: int, table: list[int], piece) -> bytes:
        out, seen = [], 0
        while at < _LAST:
            if at >= len(table) or seen > len(table):
                raise ValueError("xls: a chain of sectors is broken")
            out.append(piece(at))
            at, seen = table[at], seen + 1
        return b"".join(out)

    entries = chain(directory, fat, sector)
    found: dict[str, tuple[int, int]] = {}
    root = 0
    for k in range(0, len(entries) - 127, 128):
        length, kind = struct.unpack_from("<HB", entries, k + 64)
        start, n = struct.unpack_from("<IQ", entries, k + 116)
        name = entries[k : k + max(0, length - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            root = start
        elif kind == 2:
            found[name] = (start, n & 0xFFFFFFFF)
    name = next((n for n in names if n in found), None)
    if name is None:
        raise ValueError("xls: no workbook in the file")
    start, n = found[name]
    if n >= cutoff:
        return chain(start, fat, sector)[:n]
    small, step = chain(root, fat, sector), 1 << mini_shift
    table = list(numbers(chain(mini_fat, fat, sector)))
    return chain(start, table, lambda k: small[k * step : (k + 1) * step])[:n]


def records(book: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, its body and those of the records that continue it) from a place on to the end of the substream."""
    depth, held = 0, None
    while at + 4 <= len(book):
        kind, n = struct.unpack_from("<HH", book, at)
        body = book[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body])
        depth += (kind == BOF) - (kind == EOF)
        if kind == EOF and depth <= 0:
            break
    if held:
        yield held


class _Text:
    """Strings over a record and its continuations; one that goes on there says anew how wide its characters are."""

    def __init__(self, parts: list[bytes], at: int = 0) -> None:
        self.parts, self.k, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while n > len(out) and self.k < len(self.parts):
            part = self.parts[self.k][self.at : self.at + n - len(out)]
            out += part
            self.at += len(part)
            if self.at >= len(self.parts[self.k]) and len(out) < n:
                self.k, self.at = self.k + 1, 0
        return out

    def string(self, wide_length: bool = True) -> str:
        n = int.from_bytes(self.take(2 if wide_length else 1), "little")
        flags = (self.take(1) or b"\0")[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        out = ""
        while len(out) < n and self.k < len(self.parts):
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                flags = (self.take(1) or b"\0")[0]
                continue
            width = 2 if flags & 1 else 1
            left = (len(self.parts[self.k]) - self.at) // width
            raw = self.take(width * min(n - len(out), max(1, left)))
            out += raw.decode("utf-16-le" if width == 2 else "latin-1", "replace")
        self.take(4 * runs + extra)
        return out


def _rk(v: int) -> float:
    """A number packed in four bytes: a whole number or the upper half of a double, perhaps in hundredths."""
    x = float((v - (1 << 32) if v >> 31 else v) >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


class Workbook:
    def __init__(self, data: bytes) -> None:
        self.book = stream(data)
        self.sheets: list[tuple[str, int, bool]] = []  # name, place, hidden
        self.strings: list[str] = []
        self.epoch = dt.datetime(1899, 12, 30)
        formats: dict[int, str] = {}
        cells: list[int] = []
        for kind, parts in records(self.book):
            body = parts[0]
            if kind == BOUNDSHEET and not body[5]:  # worksheets only
                self.sheets.append((_Text([body], 6).string(False), struct.unpack_from("<I", body)[0], bool(body[4] & 3)))
            elif kind == SST:
                text = _Text(parts, 8)
                self.strings = [text.string() for _ in range(struct.unpack_from("<I", body, 4)[0])]
            elif kind == DATEMODE and body[:1] == b"\1":
                self.epoch = dt.datetime(1904, 1, 1)
            elif kind == FORMAT:
                formats[struct.unpack_from("<H", body)[0]] = _Text(parts, 2).string()
            elif kind == XF:
                cells.append(struct.unpack_from("<H", body, 2)[0])
        self.dates = [office.is_date_format(k, formats.get(k, "")) for k in cells]

    def grid(self, name: str) -> list[list[Any]]:
        cells: dict[tuple[int, int], Any] = {}
        merged, waiting = [], None

        def number(x: float, style: int) -> Any:
            return office.date_text(x, self.epoch) if style < len(self.dates) and self.dates[style] else x

        for kind, parts in records(self.book, next(p for n, p, _ in self.sheets if n == name)):
            b = parts[0]
            if kind in (LABELSST, NUMBER, RK, LABEL, BOOLERR, FORMULA):
                row, column, style = struct.unpack_from("<HHH", b)
                v: Any = None
                if kind == LABELSST:
                    v = self.strings[struct.unpack_from("<I", b, 6)[0]] or None
                elif kind == NUMBER:
                    v = number(struct.unpack_from("<d", b, 6)[0], style)
                elif kind == RK:
                    v = number(_rk(struct.unpack_from("<I", b, 6)[0]), style)
                elif kind == LABEL:
                    v = _Text(parts, 6).string() or None
                elif kind == BOOLERR:
                    v = None if b[7] else bool(b[6])
                elif b[12:14] != b"\xff\xff":
                    v = number(struct.unpack_from("<d", b, 6)[0], style)
                elif b[6] == 0:
                    waiting = (row, column)
                elif b[6] == 1:
                    v = bool(b[8])
                if v is not None:
                    cells[row, column] = v
            elif kind == MULRK:
                row, column = struct.unpack_from("<HH", b)
                for k in range((len(b) - 6) // 6):
                    style, packed = struct.unpack_from("<HI", b, 4 + 6 * k)
                    cells[row, column + k] = number(_rk(packed), style)
            elif kind == STRING and waiting:
                cells[waiting], waiting = _Text(parts).string(), None
            elif kind == MERGED:
                for k in range(struct.unpack_from("<H", b)[0]):
                    a, c, d, e = struct.unpack_from("<HHHH", b, 2 + 8 * k)
                    merged.append(((a, d), (c, e)))
        return office.grid_of(cells, merged)


def read_xls(data: bytes, name: str, sheet: str | None = None) -> Extract:
    """Every visible sheet, or one by its name. Newer workbooks under the old suffix are read as what they are."""
    if data.startswith(b"PK"):
        return office.read_xlsx(data, name, sheet)
    try:
        book = Workbook(data)
        return office.read_sheets(((title, hidden) for title, _, hidden in book.sheets), book.grid, sheet, "xls")
    except struct.error as e:
        raise ValueError(f"xls: cut short ({e})") from None
