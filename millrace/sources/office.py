"""Parsers of spreadsheets, documents, slides, databases, images and PDF text with the standard library; a spreadsheet writer."""

from __future__ import annotations

import datetime as dt
import io
import re
import sqlite3
import struct
import zipfile
from collections.abc import Callable, Iterable
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from .tables import Extract, Table

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(e: ElementTree.Element, name: str) -> Iterable[ElementTree.Element]:
    return (x for x in e.iter() if _local(x.tag) == name)


def _cell_place(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(row) - 1, column - 1


def is_date_format(number: int, code: str) -> bool:
    """Whether cells of a number format are times: by its number, or by what its code shows outside quotes."""
    return number in DATE_FORMATS or bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I))


def date_text(days: float, epoch: dt.datetime) -> str:
    when = epoch + dt.timedelta(days=days)
    when = (when + dt.timedelta(microseconds=500_000)).replace(microsecond=0)
    return when.strftime("%Y-%m-%d" if when.time() == dt.time() else "%Y-%m-%d %H:%M:%S")


def grid_of(cells: dict[tuple[int, int], Any], merged: Iterable[tuple[tuple[int, int], tuple[int, int]]]) -> list[list[Any]]:
    """All cells of a sheet by row and column; merged regions hold the top-left value throughout."""
    for (a, b), (c, d) in merged:
        cells |= {(i, j): cells[a, b] for i in range(a, c + 1) for j in range(b, d + 1) if (a, b) in cells}
    if not cells:
        return []
    height, width = max(i for i, _ in cells) + 1, max(j for _, j in cells) + 1
    return [[cells.get((i, j)) for j in range(width)] for i in range(height)]


class Workbook:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets: list[tuple[str, str, bool]] = []  # name, member, hidden
        book = self._xml("xl/workbook.xml")
        for s in _all(book, "sheet"):
            target = targets[s.get(_REL)]
            self.sheets.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}", s.get("state", "visible") != "visible"))
        self.strings = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            self.strings = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(self._xml("xl/sharedStrings.xml"), "si")]
        self.dates = self._date_styles()
        self.epoch = dt.datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in _all(book, "workbookPr")) else dt.datetime(1899, 12, 30)

    def _xml(self, member: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(member))

    def _date_styles(self) -> list[bool]:
        if "xl/styles.xml" not in self.zip.namelist():
            return []
        styles = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in _all(styles, "numFmt")}
        return [is_date_format(k, own.get(k, "")) for x in _all(styles, "cellXfs") for k in (int(f.get("numFmtId", 0)) for f in x)]

    def names(self) -> list[str]:
        return [n for n, _, _ in self.sheets]

    def grid(self, name: str) -> list[list[Any]]:
        """All cells of a sheet; merged regions hold the top-left value throughout."""
        sheet = self._xml(next(m for n, m, _ in self.sheets if n == name))
        cells: dict[tuple[int, int], Any] = {}
        row = -1
        for r in _all(sheet, "row"):
            row = int(r.get("r")) - 1 if r.get("r") else row + 1
            column = -1
            for c in r:
                at = _cell_place(c.get("r")) if c.get("r") else (row, column + 1)
                column = at[1]
                if (v := self._value(c)) is not None:
                    cells[at] = v
        merged = [tuple(map(_cell_place, (m.get("ref") + ":" + m.get("ref")).split(":")[:2])) for m in _all(sheet, "mergeCell")]
        return grid_of(cells, merged)

    def _value(self, c: ElementTree.Element) -> Any:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in _all(c, "t")) or None
        v = next((x.text for x in c if _local(x.tag) == "v"), None)
        if v is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v)]
        if kind == "b":
            return v == "1"
        if kind in ("str", "d"):
            return v
        style = int(c.get("s", 0))
        return date_text(float(v), self.epoch) if style < len(self.dates) and self.dates[style] else float(v)


def _header_row(grid: list[list[Any]]) -> int:
    """The first row that is half full or more and mostly text."""
    for k, row in enumerate(grid):
        full = [v for v in row if v is not None and str(v).strip()]
        if len(full) >= max(1, len(row) * 0.5) and sum(isinstance(v, str) for v in full) >= 0.6 * len(full):
            return k
    return 0


def read_sheets(sheets: Iterable[tuple[str, bool]], grid: Callable[[str], list[list[Any]]], sheet: str | None, method: str) -> Extract:
    """Every visible one of the sheets (name, hidden), or one by its name."""
    out = Extract()
    for title, hidden in sheets:
        if title != sheet and (hidden or sheet is not None):
            continue
        cells = grid(title)
        if not cells:
            out.warnings.append(f"sheet {title!r} is empty")
            continue
        head = _header_row(cells)
        rows = [r for r in cells[head + 1 :] if any(v is not None for v in r)]
        out.tables.append(Table.of(title, method, cells[head], rows, first_line=head + 2))
    return out


def read_xlsx(data: bytes, name: str, sheet: str | None = None) -> Extract:
    """Every visible sheet, or one by its name."""
    book = Workbook(data)
    return read_sheets(((title, hidden) for title, _, hidden in book.sheets), book.grid, sheet, "xlsx")


def column_letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


#: Fills by role of a row or cell, in the order of the style table.
FILLS = {"detail": None, "subtotal": "FFF2CC", "grand_total": "F4B084", "section_header": "D9E1F2", "anomaly": "FFC7CE", "mismatch": "FFEB9C", "header": "C6E0B4"}


def write_xlsx(sheets: dict[str, Iterable[Iterable[Any]]], styles: dict[str, dict[tuple[int, int], str]] | None = None) -> bytes:
    """Rows of values; a text that starts with '=' is a formula. styles: by sheet, the fill of cells (row, column)."""
    out, names = io.BytesIO(), list(dict.fromkeys(sheets))
    kinds = list(FILLS)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        part = lambda n, kind: f'<Override PartName="/xl/{n}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{kind}+xml"/>'
        types = part("workbook.xml", "sheet.main") + part("styles.xml", "styles") + "".join(part(f"worksheets/sheet{k}.xml", "worksheet") for k in range(1, len(names) + 1))
        head, office = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        main, package = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006"
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="s{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}<Relationship Id="st" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        tabs = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="s{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{tabs}</sheets></workbook>')
        fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in FILLS.values() if c)
        xfs = "".join(f'<xf fillId="{0 if FILLS[k] is None else 1 + kinds.index(k)}"/>' for k in kinds)
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><fonts><font/></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders><border/></borders><cellXfs>{xfs}</cellXfs></styleSheet>')
        for k, n in enumerate(names, 1):
            marks = (styles or {}).get(n, {})
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                for i, row in enumerate(sheets[n]):
                    cells = "".join(_xlsx_cell(f"{column_letters(j)}{i + 1}", v, kinds.index(marks.get((i, j), "detail"))) for j, v in enumerate(row))
                    f.write(f'<row r="{i + 1}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _xlsx_cell(ref: str, v: Any, style: int) -> str:
    at = f'r="{ref}"' + (f' s="{style}"' if style else "")
    if v is None:
        return f"<c {at}/>" if style else ""
    if isinstance(v, bool):
        return f'<c {at} t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float):
        return f"<c {at}><v>{v!r}</v></c>"
    if isinstance(v, str) and v.startswith("="):
        return f"<c {at}><f>{escape(v[1:])}</f></c>"
    clean = re.sub(r"[^\t\n\r -퟿-�\U00010000-\U0010ffff]", "", str(v))
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def sheet_names(names: Iterable[str]) -> list[str]:
    """Allowed, distinct names of at most 31 characters."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", n).strip("'")[:31] or "Sheet"
        name, k = base, 1
        while name.lower() in map(str.lower, out):
            k += 1
            name = f"{base[: 31 - len(str(k)) - 1]}_{k}"
        out.append(name)
    return out


def read_docx(data: bytes, name: str) -> Extract:
    """Every table; without one, the paragraphs."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    words = lambda e: "".join(t.text or "" for t in _all(e, "t")).strip()
    out = Extract()
    for k, t in enumerate(_all(body, "tbl"), 1):
        rows = [[words(c) for c in r if _local(c.tag) == "tc"] for r in t if _local(r.tag) == "tr"]
        rows = [r for r in rows if any(r)]
        if rows:
            out.tables.append(Table.of(f"Table {k}", "docx", rows[0], rows[1:], first_line=2))
    if not out.tables:
        texts = [w for p in _all(body, "p") if (w := words(p))]
        out.tables.append(Table.of(name, "docx_paragraphs", ("Paragraph_No", "Content", "Word_Count"), ([k, w, len(w.split())] for k, w in enumerate(texts, 1))))
    return out


def read_pptx(data: bytes, name: str) -> Extract:
    """The tables of each slide; without one, its texts."""
    z, out, texts = zipfile.ZipFile(io.BytesIO(data)), Extract(), []
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for number, member in slides:
        root = ElementTree.fromstring(z.read(member))
        words = lambda e: " ".join(filter(None, ("".join(t.text or "" for t in _all(p, "t")).strip() for p in _all(e, "p"))))
        for t in _all(root, "tbl"):
            rows = [[words(c) for c in r if _local(c.tag) == "tc"] for r in t if _local(r.tag) == "tr"]
            if rows:
                out.tables.append(Table.of(f"Slide {number}", "pptx", rows[0], rows[1:], page=number, first_line=2))
        texts += [(number, w) for s in _all(root, "sp") if (w := words(s))]
    if not out.tables and texts:
        out.tables.append(Table.of(name, "pptx_text", ("Slide", "Content", "Word_Count"), ([k, w, len(w.split())] for k, w in texts)))
    return out


def read_sqlite(data: bytes, name: str, limit: int | None = None) -> Extract:
    """All user tables and views by name; limit: rows of each (None: all)."""
    db, out = sqlite3.connect(":memory:"), Extract()
    db.deserialize(data)
    for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
        quoted = table.replace('"', '""')
        rows = db.execute(f'SELECT * FROM "{quoted}"' + (f" LIMIT {limit}" if limit else ""))
        out.tables.append(Table.of(table, "sqlite", [d[0] for d in rows.description], rows))
    return out


def read_image(data: bytes, name: str) -> Extract:
    """Format and size; text recognition is left to a plug-in."""
    kind, width, height = "unknown", None, None
    if data.startswith(b"\x89PNG"):
        kind, (width, height) = "png", struct.unpack(">II", data[16:24])
    elif data.startswith(b"BM"):
        kind, (width, height) = "bmp", struct.unpack("<ii", data[18:26])
    elif data.startswith(b"\xff\xd8"):
        kind, at = "jpeg", 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in (0xC0, 0xC1, 0xC2):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                break
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    elif data.startswith(b"RIFF"):
        kind = "webp"
    return Extract([Table.of(name, "image", ("File", "Format", "Width", "Height", "Bytes"), [[name, kind, width, height, len(data)]])], ["no text recognition"])
