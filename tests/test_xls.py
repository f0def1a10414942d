"""Binary workbooks, written here byte by byte."""

from __future__ import annotations

import struct

import pytest

from millrace.sources import files, xls


def rec(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def text(s, wide=False, length=2):
    return len(s).to_bytes(length, "little") + bytes([wide]) + s.encode("utf-16-le" if wide else "latin-1")


def compound(book, mini=False):
    """A compound file with one stream; mini: kept in small sectors."""
    sectors, fat = [], []

    def put(data, step=512):
        first = len(sectors)
        for k in range(0, max(1, len(data)), step):
            sectors.append(data[k : k + step].ljust(512, b"\0"))
            fat.append(len(sectors))
        fat[-1] = 0xFFFFFFFE
        return first

    if mini:
        root = put(book)
        table = put(b"".join(struct.pack("<I", k + 1 if k + 1 < -(-len(book) // 64) else 0xFFFFFFFE) for k in range(-(-len(book) // 64))).ljust(512, b"\xff"))
        start, cutoff = 0, len(book) + 1
    else:
        root, table, start, cutoff = 0xFFFFFFFE, 0xFFFFFFFE, put(book), 1
    entry = lambda name, kind, at, n: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind)).ljust(116, b"\0") + struct.pack("<IQ", at, n)
    directory = put(entry("Root Entry", 5, root, len(book)) + entry("Workbook", 2, start, len(book)))
    fat.append(0xFFFFFFFD)
    at = len(sectors)
    sectors.append(b"".join(struct.pack("<I", k) for k in fat).ljust(512, b"\xff"))
    head = bytearray(512)
    head[:8] = xls.MAGIC
    struct.pack_into("<HH", head, 30, 9, 6)
    for place, v in ((44, 1), (48, directory), (56, cutoff), (60, table), (64, int(mini)), (68, 0xFFFFFFFE), (72, 0)):
        struct.pack_into("<I", head, place, v)
    struct.pack_into("<109I", head, 76, at, *[0xFFFFFFFF] * 108)
    return bytes(head) + b"".join(sectors)


def workbook():
    strings = ["Region", "Revenue", "When", "Nörth", "日本", "S" * 30]
    shared = struct.pack("<II", 6, 6) + b"".join(text(s, any(ord(c) > 255 for c in s)) for s in strings)
    cut = len(shared) - 12  # the last string goes on in a continuation, whose characters are wide
    rest = "S" * 12
    shared = [shared[:cut], b"\1" + rest.encode("utf-16-le")]
    cell = lambda r, c, x=0: struct.pack("<HHH", r, c, x)
    sheet = [rec(xls.BOF, b"\0" * 16)]
    sheet += [rec(xls.LABELSST, cell(0, k) + struct.pack("<I", k)) for k in range(3)]
    sheet += [rec(xls.LABELSST, cell(1, 0) + struct.pack("<I", 3)), rec(xls.NUMBER, cell(1, 1) + struct.pack("<d", 61000.5)), rec(xls.NUMBER, cell(1, 2, 1) + struct.pack("<d", 45296.0))]
    sheet += [rec(xls.LABELSST, cell(2, 0) + struct.pack("<I", 4)), rec(xls.RK, cell(2, 1) + struct.pack("<I", (-7 << 2 & 0xFFFFFFFF) | 2)), rec(xls.NUMBER, cell(2, 2, 2) + struct.pack("<d", 45296.25))]
    sheet += [rec(xls.LABELSST, cell(3, 0) + struct.pack("<I", 5)), rec(xls.MULRK, struct.pack("<HH", 3, 1) + struct.pack("<HI", 0, (1234 << 2) | 3) + struct.pack("<HI", 0, 0x40080000) + struct.pack("<H", 2))]
    sheet += [rec(xls.FORMULA, cell(4, 0) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8), rec(xls.STRING, text("made")), rec(xls.FORMULA, cell(4, 1) + struct.pack("<d", 2.5) + b"\0" * 8), rec(xls.BOOLERR, cell(4, 2) + b"\1\0")]
    sheet += [rec(xls.LABEL, cell(5, 0) + text("old")), rec(xls.BOOLERR, cell(5, 1) + b"\x2a\1"), rec(xls.MERGED, struct.pack("<HHHHH", 1, 5, 6, 0, 0)), rec(xls.EOF)]
    sheet = b"".join(sheet)
    hidden = b"".join([rec(xls.BOF, b"\0" * 16), rec(xls.LABEL, cell(0, 0) + text("no")), rec(xls.EOF)])
    head = lambda a, b: b"".join([
        rec(xls.BOF, b"\0" * 16), rec(xls.FORMAT, struct.pack("<H", 164) + text("yyyy\\-mm hh:mm")), rec(xls.XF, struct.pack("<HH", 0, 0) + b"\0" * 16), rec(xls.XF, struct.pack("<HH", 0, 14) + b"\0" * 16), rec(xls.XF, struct.pack("<HH", 0, 164) + b"\0" * 16),
        rec(xls.BOUNDSHEET, struct.pack("<IBB", a, 0, 0) + text("Q1 Sales", length=1)), rec(xls.BOUNDSHEET, struct.pack("<IBB", b, 1, 0) + text("Secret", length=1)),
        rec(xls.SST, shared[0]), rec(xls.CONTINUE, shared[1]), rec(xls.EOF),
    ])
    n = len(head(0, 0))
    return head(n, n + len(sheet)) + sheet + hidden


@pytest.mark.parametrize("mini", [False, True])
def test_old_workbooks(mini):
    data = compound(workbook(), mini)
    found = files.extract(data, "sales.xls")
    assert not found.warnings and [t.name for t in found.tables] == ["Q1 Sales"]
    t = found.tables[0]
    assert t.headers == ["Region", "Revenue", "When"]
    assert [c for *_, c in t.rows] == [["Nörth", "61000.5", "2024-01-05"], ["日本", "-7", "2024-01-05 06:00:00"], ["S" * 30, "12.34", "3"], ["made", "2.5", "true"], ["old", None, None], ["old", None, None]]
    assert [t.name for t in xls.read_xls(data, "x", "Secret").tables] == ["Secret"]
    assert [t.headers for t in files.extract(data, "no suffix").tables] == [t.headers]


def test_damage():
    data = compound(workbook())
    for bad in (data[:600], data[:4], data.replace("Workbook".encode("utf-16-le"), "Wxrkbook".encode("utf-16-le"))):
        assert not files.extract(bad, "x.xls").tables and files.extract(bad, "x.xls").warnings
