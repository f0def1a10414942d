"""PDF: tables and text lines out of pages, and reports into pages.

Reading follows a page's text operators, so each piece of text has its place and its font's map to Unicode. Pieces on one
line are its cells; successive lines whose cells start at the same places are a table. Pages without text are scans."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from .tables import Extract, Table

_TOKEN = re.compile(rb"\((?:\\[\s\S]|[^\\()]|\((?:\\[\s\S]|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+\d?")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
#: How far apart in points pieces of one line may stand, and starts of one column; the gap between cells in text sizes.
LINE, COLUMN, GAP = 3.0, 8.0, 0.9


def _plain(stream: bytes, head: bytes) -> bytes:
    if b"FlateDecode" not in head:
        return stream
    d = zlib.decompressobj()
    try:
        return d.decompress(stream) + d.flush()
    except zlib.error:
        return b""


@dataclass
class _Objects:
    """The objects of a file by number: (dictionary, stream)."""

    by: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)

    @classmethod
    def of(cls, data: bytes) -> _Objects:
        out = cls()
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            head, _, rest = m[2].partition(b"stream")
            body = rest.lstrip(b"\r").removeprefix(b"\n")
            body = body[: body.rfind(b"endstream")] if rest else b""
            out.by[int(m[1])] = (head, _plain(body, head) if rest else b"")
        for head, body in list(out.by.values()):
            if b"/ObjStm" in head and (first := re.search(rb"/First\s+(\d+)", head)):
                at = int(first[1])
                pairs = list(map(int, body[:at].split()))
                for k in range(0, len(pairs) - 1, 2):
                    end = at + pairs[k + 3] if k + 3 < len(pairs) else len(body)
                    out.by.setdefault(pairs[k], (body[at + pairs[k + 1] : end], b""))
        return out

    def refs(self, head: bytes, key: bytes) -> list[int]:
        """The objects that a key names: one, or those of a list."""
        m = re.search(rb"/" + key + rb"\b\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", head)
        return [] if not m else [int(m[2])] if m[2] else [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(dictionary, content) of each page in the order of the page tree, or else of the file."""
        own = {k: h for k, (h, _) in self.by.items() if re.search(rb"/Type\s*/Page\b", h)}
        order: list[int] = []

        def walk(k: int) -> None:
            head = self.by.get(k, (b"", b""))[0]
            if k in own:
                order.append(k)
            elif re.search(rb"/Type\s*/Pages\b", head):
                for kid in self.refs(head, b"Kids"):
                    if kid != k:
                        walk(kid)

        for k, (head, _) in self.by.items():
            if re.search(rb"/Type\s*/Catalog\b", head):
                for root in self.refs(head, b"Pages"):
                    walk(root)
        order = order or list(own)
        return [(own[k], b"\n".join(self.by.get(c, (b"", b""))[1] for c in self.refs(own[k], b"Contents"))) for k in order]

    def fonts(self, page: bytes) -> dict[bytes, _Font]:
        """The fonts of a page by name; those of the whole file where the page doesn't say."""
        held = page
        for k in self.refs(page, b"Resources"):
            held += self.by.get(k, (b"", b""))[0]
        for k in self.refs(held, b"Font"):
            held += b"/Font <<" + self.by.get(k, (b"", b""))[0] + b">>"
        found = {}
        for group in re.findall(rb"/Font\s*<<(.*?)>>", held, re.S):
            for name, k in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", group):
                head = self.by.get(int(k), (b"", b""))[0]
                maps = [self.by.get(u, (b"", b""))[1] for u in self.refs(head, b"ToUnicode")]
                found[name] = _Font.of(maps[0] if maps else b"", b"/Type0" in head)
        return found


@dataclass
class _Font:
    wide: bool = False
    codes: dict[int, str] = field(default_factory=dict)

    @classmethod
    def of(cls, cmap: bytes, wide: bool) -> _Font:
        codes: dict[int, str] = {}
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                codes[int(a, 16)] = text(b)
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                for k in range(min(int(z, 16) - int(a, 16) + 1, 1 << 16)):
                    codes[int(a, 16) + k] = text(b)[:-1] + chr(ord(text(b)[-1]) + k)
        return cls(wide, codes)

    def text(self, raw: bytes) -> str:
        if self.wide:
            pairs = [raw[k] << 8 | raw[k + 1] for k in range(0, len(raw) - 1, 2)]
            return "".join(self.codes.get(c, "") for c in pairs) if self.codes else raw.decode("utf-16-be", "replace")
        return "".join(self.codes.get(c) or bytes([c]).decode("cp1252", "replace") for c in raw)


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    inner = re.sub(rb"\\([0-7]{1,3})", lambda m: b"\\" + bytes([int(m[1], 8) & 255]) if bytes([int(m[1], 8) & 255]) in b"()\\" else bytes([int(m[1], 8) & 255]), token[1:-1])
    return re.sub(rb"\\([\s\S])", lambda m: _ESCAPES.get(m[1], m[1]), inner)


def pieces(content: bytes, fonts: dict[bytes, _Font]) -> list[tuple[float, float, float, str]]:
    """(x, y, size, text) of each shown text, where its line starts or a move puts it."""
    out: list[tuple[float, float, float, str]] = []
    stack: list[bytes] = []
    line, place, lead, size, font = (0.0, 0.0), (0.0, 0.0), 0.0, 10.0, _Font()
    scale = 1.0
    numbers = lambda n: [float(x) if re.fullmatch(rb"[+-]?[\d.]+", x) else 0.0 for x in stack[-n:]] if len(stack) >= n else [0.0] * n

    def show(text: str) -> None:
        nonlocal place
        if text:
            out.append((*place, size * scale, text))
            place = (place[0] + 0.5 * size * scale * len(text), place[1])

    for token in _TOKEN.findall(re.sub(rb"BI\s.*?\sEI\b", b"", content, flags=re.S)):
        if token[:1] in b"(</[]+-.0123456789>":
            stack.append(token)
            continue
        if token == b"BT":
            line = place = (0.0, 0.0)
        elif token == b"Tf" and len(stack) >= 2:
            font, size = fonts.get(stack[-2][1:], _Font()), numbers(1)[0]
        elif token == b"TL":
            lead = numbers(1)[0]
        elif token in (b"Td", b"TD"):
            dx, dy = numbers(2)
            lead = -dy if token == b"TD" else lead
            line = place = (line[0] + dx * scale, line[1] + dy * scale)
        elif token == b"Tm":
            m = numbers(6)
            scale = abs(m[3]) or abs(m[1]) or 1.0
            line = place = (m[4], m[5])
        elif token in (b"T*", b"'", b'"'):
            line = place = (line[0], line[1] - (lead or size) * scale)
        if token in (b"Tj", b"'", b'"') and stack and stack[-1][:1] in b"(<":
            show(font.text(_string(stack[-1])))
        elif token == b"TJ" and b"[" in stack:
            first = len(stack) - 1 - stack[::-1].index(b"[")
            words = ""
            for x in stack[first + 1 :]:
                if x[:1] in b"(<":
                    words += font.text(_string(x))
                elif x != b"]" and float(x) < -180:  # a wide gap stands for a space
                    words += " "
            show(words)
        stack = []
    return out


def lines(found: list[tuple[float, float, float, str]]) -> list[list[tuple[float, str]]]:
    """The lines of a page from the top: cells (x, text) from the left. Pieces that nearly touch are one cell."""
    rows: list[tuple[float, list]] = []
    for x, y, size, text in sorted(found, key=lambda p: (-p[1], p[0])):
        if rows and abs(rows[-1][0] - y) <= LINE:
            rows[-1][1].append((x, size, text))
        else:
            rows.append((y, [(x, size, text)]))
    out = []
    for _, parts in rows:
        cells: list[list] = []  # x, end, text
        for x, size, text in sorted(parts):
            if cells and x - cells[-1][1] < GAP * size and not cells[-1][2].endswith("  "):
                gap = " " if x - cells[-1][1] > 0.2 * size and not cells[-1][2].endswith(" ") else ""
                cells[-1][2] += gap + text
            else:
                cells.append([x, x, text])
            cells[-1][1] = x + 0.5 * size * len(text)
        if kept := [(c[0], c[2].strip()) for c in cells if c[2].strip()]:
            out.append(kept)
    return out


def tables(rows: list[list[tuple[float, str]]]) -> tuple[list[list[list[str]]], list[str]]:
    """(tables as rows of cells, lines of text): a table is a header of two or more cells and lines under it whose cells all
    start where a header's does; two lines at least."""
    found, loose, k = [], [], 0
    while k < len(rows):
        heads = [x for x, _ in rows[k]]
        held = [[t for _, t in rows[k]]]
        j = k + 1
        while len(heads) > 1 and j < len(rows):
            at = [next((i for i, h in enumerate(heads) if abs(x - h) <= COLUMN), None) for x, _ in rows[j]]
            if None in at or len(set(at)) < len(at) or len(at) < 2 <= len(heads) - (len(heads) == 2):
                break
            cells = [""] * len(heads)
            for i, (_, t) in zip(at, rows[j], strict=True):
                cells[i] = t
            held.append(cells)
            j += 1
        if len(held) > 1:
            found.append(held)
        else:
            j = k + 1
            loose.append(" ".join(t for _, t in rows[k]))
        k = j
    return found, loose


def read_pdf(data: bytes, name: str) -> Extract:
    """Each page's tables; a page without any gives its lines of text as one; scanned pages are flagged."""
    objects, out = _Objects.of(data), Extract()
    # without a readable page tree every stream counts as a page
    pages = objects.pages() or [(b"", _plain(x, b"FlateDecode") or x) for x in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S)]
    for number, (head, content) in enumerate(pages, 1):
        try:
            rows = lines(pieces(content, objects.fonts(head)))
        except (ValueError, IndexError) as e:
            out.warnings.append(f"page {number}: {e}")
            continue
        found, loose = tables(rows)
        for k, t in enumerate(found, 1):
            out.tables.append(Table.of(f"Page {number}" if len(found) == 1 else f"Page {number} ({k})", "pdf_table", t[0], t[1:], page=number))
        if not found and loose:
            out.tables.append(Table.of(f"Page {number}", "pdf", ("Content",), ([x] for x in loose), page=number))
        if not rows:
            out.warnings.append(f"page {number}: no text, it may be a scan")
    if not out.tables and not out.warnings:
        out.warnings.append("no text: the pages may be scans")
    return out


WIDTH, HEIGHT, MARGIN, SIZE = 595, 842, 40, 9


def write_pdf(blocks: Iterable[tuple[str, Any]]) -> bytes:
    """A document of blocks: ("title", text), ("head", text), ("text", text) or ("table", rows of cells), over as many pages as
    they take. Characters beyond Windows-1252 are shown as question marks."""
    pages: list[list[bytes]] = [[]]
    y = float(HEIGHT - MARGIN)

    def put(x: float, text: str, size: float, bold: bool = False) -> None:
        raw = re.sub(rb"([()\\])", rb"\\\1", text.encode("cp1252", "replace"))
        pages[-1].append(b"BT /F%d %g Tf 1 0 0 1 %g %g Tm (%b) Tj ET" % (2 if bold else 1, size, x, y, raw))

    def down(size: float) -> None:
        nonlocal y
        y -= 1.5 * size
        if y < MARGIN:
            pages.append([])
            y = float(HEIGHT - MARGIN)

    for kind, value in blocks:
        if kind == "table":
            rows = [["" if v is None else str(v) for v in r] for r in value]
            width = (WIDTH - 2 * MARGIN) / max(1, max(map(len, rows), default=1))
            fits = max(4, int(width / (0.5 * SIZE)) - 2)
            for k, r in enumerate(rows):
                parts = [[c[i : i + fits] for i in range(0, len(c), fits)] or [""] for c in r]  # long cells go on below
                for i in range(max(map(len, parts), default=1)):
                    down(SIZE)
                    for j, p in enumerate(parts):
                        if i < len(p) and p[i].strip():
                            put(MARGIN + j * width, p[i], SIZE, k == 0)
            down(SIZE)
        else:
            size = {"title": 16, "head": 12}.get(kind, SIZE)
            fits = int((WIDTH - 2 * MARGIN) / (0.5 * size))
            for i in range(0, max(1, len(str(value))), fits):
                down(size)
                put(MARGIN, str(value)[i : i + fits], size, kind != "text")
    bodies = [zlib.compress(b"\n".join(p)) for p in pages]
    n = len(pages)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%b] /Count %d >>" % (b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(n)), n)]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /%b /Encoding /WinAnsiEncoding >>" % f for f in (b"Helvetica", b"Helvetica-Bold")]
    for k, body in enumerate(bodies):
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, 6 + 2 * k))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(body), body))
    out, places = b"%PDF-1.4\n", []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (k, o)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%btrailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
