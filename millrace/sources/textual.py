"""Parsers of delimited text, markdown, logs, key-value files, JSON, XML and HTML: bytes to tables."""

from __future__ import annotations

import csv
import io
import json
import re
from collections import Counter
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree

from .tables import Extract, Table, decode, number

#: The log line's shape and levels, and how much of a file must fit a form.
LOG_LINE = r"^(\d{4}[-/]\d{2}[-/]\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?\s*(?:\[?(DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\]?)?\s*(?:\[?([\w.\-]+)\]?:?)?\s*(.*)$"
KEY_VALUE = r"^([\w.\-]+)\s*[:=]\s*(.*)$"
COMMENTS = ("#", "//", ";", "--")
HEAD, LOG_SHARE, PAIR_SHARE, LEAST_PAIRS, COLUMN_SHARE, DEPTH = 100, 0.3, 0.3, 3, 0.6, 4
COLLECTIONS = ("data", "records", "items", "rows", "results")


def sniff(sample: str, delimiters: str = ",;\t|") -> str:
    """The delimiter that splits most lines into the same number of parts; a comma if none does."""
    lines = [x for x in sample.splitlines() if x.strip()][:50]
    best, found = (0.0, 0), ","
    for d in delimiters:
        counts = Counter(len(r) for r in csv.reader(lines, delimiter=d))
        width, n = max(counts.items(), key=lambda x: (x[1], x[0]), default=(1, 0))
        if width > 1 and (n / max(1, len(lines)), width) > best:
            best, found = (n / len(lines), width), d
    return found


def read_csv(data: bytes, name: str, delimiter: str | None = None) -> Extract:
    """The first row that isn't blank is the header; blank rows go; lines count CSV records."""
    content = decode(data)
    delimiter = delimiter or sniff(content[:4096])
    records = [(k, r) for k, r in enumerate(csv.reader(io.StringIO(content, newline=""), delimiter=delimiter), 1) if any(c.strip() for c in r)]
    if not records:
        return Extract(warnings=["no rows"])
    table = Table.of(name, "csv", records[0][1], ())
    width = len(table.headers)
    for line, r in records[1:]:
        cells = [c.strip() or None for c in r][:width]
        table.rows.append((line, delimiter.join(r), cells + [None] * (width - len(cells))))
    return Extract([table])


def markdown(lines: list[str], name: str) -> Table | None:
    rows = [[c.strip() for c in x.strip()[1:-1].split("|")] for x in lines if len(x.strip()) > 1 and x.strip()[0] == x.strip()[-1] == "|"]
    ruled = [r for r in rows if all(re.fullmatch(r":?-+:?", c) for c in r if c) and any(r)]
    rows = [r for r in rows if r not in ruled]
    return Table.of(name, "markdown", rows[0], rows[1:]) if ruled and rows else None


def delimited(lines: list[str], name: str) -> Table | None:
    d = sniff("\n".join(lines), "\t|;,")
    rows = list(csv.reader(lines, delimiter=d))
    width, n = max(Counter(map(len, rows)).items(), key=lambda x: (x[1], x[0]))
    if width <= 1 or n / len(rows) < COLUMN_SHARE:
        return None
    return Table.of(name, "delimited", rows[0], ([c.strip() for c in r] for r in rows[1:] if any(c.strip() for c in r)), first_line=2, joiner=d)


def log(lines: list[str], name: str, least: int = 2) -> Table | None:
    line = re.compile(LOG_LINE, re.I)
    parts = [line.match(x.strip()).groups() for x in lines]
    hits = sum(bool(t or lv) for t, lv, _, _ in parts[:HEAD])
    if hits < least or hits / min(len(lines), HEAD) < LOG_SHARE:
        return None
    rows = ([t, (lv or "INFO").upper(), m, msg] if t or lv else [None, "INFO", None, x.strip()] for x, (t, lv, m, msg) in zip(lines, parts, strict=True))
    return Table.of(name, "log", ("Timestamp", "Level", "Module", "Message"), rows)


def key_values(lines: list[str], name: str) -> Table | None:
    pairs = [m.groups() for x in lines if not x.strip().startswith(COMMENTS) and (m := re.match(KEY_VALUE, x.strip()))]
    if len(pairs) < LEAST_PAIRS or len(pairs) < PAIR_SHARE * len(lines):
        return None
    return Table.of(name, "key_value", ("Key", "Value"), ([k, v.strip().strip("\"'")] for k, v in pairs))


def plain(content: str, name: str) -> Table:
    table = Table(name, "text", ["Line_No", "Content", "Word_Count", "Char_Count"])
    for k, x in enumerate(content.splitlines(), 1):
        if s := x.strip():
            table.rows.append((k, s, [str(k), s, str(len(s.split())), str(len(s))]))
    return table


def read_text(data: bytes, name: str) -> Extract:
    """The first form that fits: markdown, delimited, log, key-value, plain lines."""
    content = decode(data)
    lines = [x for x in content.splitlines() if x.strip()]
    if not lines:
        return Extract(warnings=["no text"])
    least = 1 if name.lower().endswith(".log") else 2
    table = markdown(lines, name) or delimited(lines, name) or log(lines, name, least) or key_values(lines, name)
    return Extract([table or plain(content, name)])


def flatten(value: dict[str, Any], prefix: str = "", depth: int = DEPTH) -> dict[str, Any]:
    """Dotted keys; lists of plain values are joined, deeper or mixed ones stay JSON; empty objects vanish."""
    out: dict[str, Any] = {}
    for k, v in value.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict) and depth > 1:
            out |= flatten(v, key, depth - 1)
        elif isinstance(v, list) and not any(isinstance(x, dict | list) for x in v):
            out[key] = ", ".join("" if x is None else str(x) for x in v)
        else:
            out[key] = json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else v
    return out


def from_records(records: list[Any], name: str, method: str = "json") -> Table:
    """Headers are the keys in the order in which they first appear."""
    flat = [flatten(r) if isinstance(r, dict) else {f"Col_{k}": v for k, v in enumerate(r)} if isinstance(r, list) else {"Value": r} for r in records]
    flat = [{(str(k).strip() or "Unnamed"): v for k, v in r.items()} for r in flat]
    headers = list(dict.fromkeys(k for r in flat for k in r)) or ["Value"]
    return Table.of(name, method, headers, ([r.get(h) for h in headers] for r in flat))


def read_json(data: bytes, name: str) -> Extract:
    """A list, an object with collections (a table each, the rest as Metadata), GeoJSON, one object, or JSON lines."""
    content = decode(data).strip()
    try:
        value = json.loads(content)
    except ValueError:
        return _json_lines(content, name)
    if name.lower().endswith((".jsonl", ".ndjson")):
        return _json_lines(content, name)
    if isinstance(value, list):
        return Extract([from_records(value, name)])
    if not isinstance(value, dict):
        return Extract([from_records([value], name)])
    if value.get("type") == "FeatureCollection" and isinstance(value.get("features"), list):
        rows = [(f.get("properties") or {}) | {"_geometry_type": (f.get("geometry") or {}).get("type"), "_coordinates": json.dumps((f.get("geometry") or {}).get("coordinates"))} for f in value["features"]]
        return Extract([from_records(rows, name, "geojson")])
    parts = {k: v for k, v in value.items() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)}
    if not parts:
        return Extract([from_records([value], name)])
    tables = [from_records(v, k) for k, v in parts.items()]
    rest = {k: v for k, v in value.items() if k not in parts}
    return Extract(tables + ([from_records([rest], "Metadata")] if rest else []))


def _json_lines(content: str, name: str) -> Extract:
    rows, bad = [], []
    for k, x in enumerate(content.splitlines(), 1):
        if x.strip():
            try:
                rows.append(json.loads(x))
            except ValueError as e:
                bad.append((k, x, str(e)))
    return Extract([from_records(rows, name)] if rows else [], [f"{len(bad)} bad lines"] if bad else [], bad)


class _Html(HTMLParser):
    """Tables with their rows and captions, and the text of list items and paragraphs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict[str, Any]] = []
        self.open: list[int] = []
        self.items: list[str] = []
        self.into: list[list[str]] = []  # buffers that text goes to: cells, captions, items
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: Any) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.tables.append({"rows": [], "caption": None})
            self.open.append(len(self.tables) - 1)
        elif tag == "tr" and self.open:
            for t in self.open:  # a nested table's rows count for the outer one too
                self.tables[t]["rows"].append([])
        elif tag in ("td", "th") and self.open:
            cell: list[str] = []
            for t in self.open:
                if self.tables[t]["rows"]:
                    self.tables[t]["rows"][-1].append(cell)
            self.into = [cell]
        elif tag == "caption" and self.open:
            self.tables[self.open[-1]]["caption"] = caption = []
            self.into = [caption]
        elif tag in ("li", "p") and not self.open:
            self.items.append([])  # type: ignore[arg-type]
            self.into = [self.items[-1]]  # type: ignore[list-item]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th", "caption", "li", "p"):
            self.into = []

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for buffer in self.into:
                buffer.append(data)


def read_html(data: bytes, name: str, items: bool = True) -> Extract:
    """Every table; without one, the text of list items and paragraphs."""
    page = _Html()
    page.feed(decode(data))
    page.close()
    tables = []
    for k, t in enumerate(page.tables, 1):
        rows = [["".join(c).strip() for c in r] for r in t["rows"]]
        rows = [r for r in rows if any(r)]
        if rows:
            caption = "".join(t["caption"]).strip() if t["caption"] else ""
            tables.append(Table.of((caption or f"Table {k}")[:30], "html", rows[0], rows[1:], first_line=2))
    if not tables and items:
        found = [s for x in page.items if (s := "".join(x).strip())]
        if found:
            tables.append(Table.of(name, "html_items", ("Item_No", "Content", "Word_Count"), ([k, s, len(s.split())] for k, s in enumerate(found, 1))))
    return Extract(tables)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_xml(data: bytes, name: str) -> Extract:
    """Tables as in HTML; else the most frequent repeated element is a record, by document order if several are."""
    found = read_html(data, name, items=False)
    if found.tables:
        return found
    root = ElementTree.fromstring(data)
    counts = Counter(_local(e.tag) for e in root.iter() if e is not root)
    tag, n = max(counts.items(), key=lambda x: x[1], default=("", 0))
    if n < 2:
        return read_html(data, name)
    rows = []
    for e in (x for x in root.iter() if _local(x.tag) == tag):
        row = {f"@{_local(k)}": v for k, v in e.attrib.items()}
        for child in e:
            row[_local(child.tag)] = "".join(child.itertext()).strip()
        if e.text and e.text.strip():
            row["Value"] = e.text.strip()
        rows.append(row)
    return Extract([from_records(rows, tag, "xml")])


def read_binary(data: bytes, name: str) -> Extract:
    """Printable runs with what they look like; without any, the first bytes as hex."""
    runs = [(m.start(), m[0].decode()) for m in re.finditer(rb"[\x20-\x7e]{4,}", data)]

    def kind(s: str) -> str:
        if re.search(r"https?://|www\.", s):
            return "url"
        return "email" if re.fullmatch(r"[\w.+-]+@[\w-]+\.[\w.]+", s) else "number" if number(s) is not None else "path" if re.match(r"[/\\]|[A-Z]:\\", s) else "text"

    if runs:
        return Extract([Table.of(name, "binary_strings", ("Offset", "Content", "Kind", "Length"), ([a, s, kind(s), len(s)] for a, s in runs))])
    return Extract([Table.of(name, "binary_hex", ("Offset", "Hex"), ([k, data[k : k + 32].hex(" ")] for k in range(0, len(data), 32)))])
