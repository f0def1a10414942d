"""Files to DataFrames. Many files are parsed in parallel, one a task at a time; single large text files are split by Spark."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs
from ..operators.align import ROW
from ..operators.rows import with_row_index
from . import office, pdf, textual, xls
from .tables import Extract, decode

Parser = Callable[[bytes, str], Extract]

PARSERS: dict[str, Parser] = {
    **dict.fromkeys((".csv",), textual.read_csv), **dict.fromkeys((".json", ".jsonl", ".ndjson", ".geojson"), textual.read_json),
    **dict.fromkeys((".xml",), textual.read_xml), **dict.fromkeys((".html", ".htm"), textual.read_html),
    **dict.fromkeys((".txt", ".tsv", ".tab", ".log", ".dat", ".env", ".ini", ".conf", ".sql", ".md", ".yaml", ".yml"), textual.read_text),
    ".xlsx": office.read_xlsx, ".xls": xls.read_xls, ".docx": office.read_docx, ".pptx": office.read_pptx, **dict.fromkeys((".db", ".sqlite", ".sqlite3"), office.read_sqlite),
    **dict.fromkeys((".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff"), office.read_image), ".pdf": pdf.read_pdf,
}

#: What the upload gate lets through, and how large.
UPLOADS, MOST_BYTES = (".csv", ".tsv", ".xlsx", ".xls", ".json", ".jsonl"), 50 << 20


def register_parser(suffix: str, parser: Parser) -> None:
    """Add or replace a format, as for scans with text recognition."""
    PARSERS[suffix.lower()] = parser


def check_upload(name: str, size: int, most: int = MOST_BYTES) -> None:
    """ValueError for files that the gate refuses."""
    if PurePosixPath(name).suffix.lower() not in UPLOADS:
        raise ValueError(f"{name}: only {', '.join(UPLOADS)} are taken")
    if not size:
        raise ValueError(f"{name}: empty")
    if size > most:
        raise ValueError(f"{name}: more than {most} bytes")


def read_archive(data: bytes, name: str) -> Extract:
    """All members through extract(); tables are called member - table."""
    out = Extract()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            base = PurePosixPath(info.filename).name
            if info.is_dir() or info.filename.startswith("__MACOSX") or base.startswith("."):
                continue
            inner = extract(z.read(info), base)
            for t in inner.tables:
                t.name = f"{base} - {t.name}"[:60]
            out.tables += inner.tables
            out.warnings += [f"{base}: {w}" for w in inner.warnings]
            out.unparsed += inner.unparsed
    return out


def router(data: bytes, name: str) -> Parser:
    """By magic bytes, then suffix, then content."""
    for magic, suffix in ((b"%PDF", ".pdf"), (xls.MAGIC, ".xls"), (b"SQLite format 3", ".sqlite"), (b"\x89PNG\r\n\x1a\n", ".png"), (b"\xff\xd8\xff", ".jpg"), (b"RIFF", ".webp")):
        if data.startswith(magic):
            return PARSERS[suffix]
    suffix = PurePosixPath(name).suffix.lower()
    if suffix == ".zip":
        return read_archive
    if suffix in PARSERS:
        return PARSERS[suffix]
    if data.startswith(b"PK\x03\x04"):
        members = zipfile.ZipFile(io.BytesIO(data)).namelist()
        known = {"word/document.xml": ".docx", "ppt/presentation.xml": ".pptx", "xl/workbook.xml": ".xlsx"}
        return next((PARSERS[s] for m, s in known.items() if m in members), read_archive)
    if b"\0" in data[:4096] and not data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return textual.read_binary
    head = decode(data).strip()
    if head[:1] + head[-1:] in ("{}", "[]"):
        return textual.read_json
    if head.startswith("<") and head.endswith(">"):
        return textual.read_xml if head.startswith("<?xml") else textual.read_html
    return textual.read_text


def extract(data: bytes, name: str) -> Extract:
    """The tables of any file; what can't be parsed gives none and a warning."""
    if not data:
        return Extract(warnings=["empty file"])
    try:
        return router(data, name)(data, name)
    except (ValueError, KeyError, IndexError, zipfile.BadZipFile, SyntaxError, office.sqlite3.DatabaseError) as e:
        return Extract(warnings=[f"{type(e).__name__}: {e}"])


_ROWS = "path string, table_index int, table_name string, method string, page int, headers array<string>, row_index long, line long, raw_text string, cells array<string>, warning string"


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each row of each table of each file (path, content); warnings and unparsed lines have table_index -1.

    A task holds one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("table_index", pa.int32()), ("table_name", pa.string()), ("method", pa.string()), ("page", pa.int32()), ("headers", pa.list_(pa.string())), ("row_index", pa.int64()), ("line", pa.int64()), ("raw_text", pa.string()), ("cells", pa.list_(pa.string())), ("warning", pa.string())])
        for b in batches:
            for where, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, rows = extract(data, PurePosixPath(where).name), []
                for k, t in enumerate(found.tables):
                    rows += [(where, k, t.name, t.method, t.page, t.headers, i, line, raw, cells, None) for i, (line, raw, cells) in enumerate(t.rows)]
                    if not t.rows:
                        rows.append((where, k, t.name, t.method, t.page, t.headers, None, None, None, None, None))
                rows += [(where, -1, None, None, None, None, None, None, None, None, w) for w in found.warnings]
                rows += [(where, -1, None, None, None, None, None, line, raw, None, why) for line, raw, why in found.unparsed]
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, _ROWS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """parse_files() of all files below path."""
    return parse_files(spark.read.format("binaryFile").load(path))


@dataclass
class Dataset:
    """The tables of one file as DataFrames of text with lineage columns; warnings; unparsed lines."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    unparsed: DataFrame | None = None


def read_file(spark: SparkSession, path: str) -> Dataset:
    """One file's tables, each with its headers as columns."""
    rows = read_files(spark, path)
    out = Dataset(unparsed=rows.filter("table_index = -1 and line is not null").select("line", "raw_text", "warning"))
    out.warnings = [r.warning for r in rows.filter("table_index = -1 and line is null").select("warning").collect()]
    for t in rows.filter("table_index >= 0").select("table_index", "table_name", "headers").distinct().orderBy("table_index").collect():
        own = rows.filter((F.col("table_index") == t.table_index) & F.col("cells").isNotNull())
        names = exprs.sanitize_names(t.headers)
        wide = own.select(F.col("row_index").alias(ROW), F.col("line").alias("_source_line"), F.col("page").alias("_source_page"), F.col("raw_text").alias("_raw_text"), *(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)))
        name, k = t.table_name, 1
        while name in out.tables:
            k += 1
            name = f"{t.table_name} ({k})"
        out.tables[name] = wide
    return out


# Large single files: Spark splits them, and only their first lines come to the driver.


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(_row_index, value): the lines of text files in order."""
    return with_row_index(spark.read.option("encoding", encoding).text(path).select("value"))


@dataclass(frozen=True)
class CsvTraits:
    """encoding; multiline: whether quoted cells hold line breaks; sep; header: the first record that isn't blank."""

    encoding: str
    multiline: bool
    sep: str
    header: tuple[str, ...]


def csv_traits(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> CsvTraits:
    """How to read a delimited file, from one pass over its raw lines and its first ones.

    Bytes that aren't UTF-8 mean latin-1, a byte order mark says what it says; a line with an odd number of quotes means that
    cells go on in the next one, and only then the file can't be split."""
    raw = spark.read.text(path).select("value")  # bytes as they are, whatever they encode
    head = [bytes(r.value) for r in raw.select(F.col("value").cast("binary").alias("value")).limit(200).collect()]
    if encoding is None and head and head[0][:2] in (b"\xff\xfe", b"\xfe\xff"):
        encoding = "UTF-16"
    if encoding is None:
        encoding = "UTF-8" if raw.filter(~F.call_function("is_valid_utf8", F.col("value"))).isEmpty() else "ISO-8859-1"
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    multiline = encoding == "UTF-16" or not raw.filter(quotes % 2 == 1).isEmpty()
    text = b"\n".join(head).decode("utf-8-sig" if encoding == "UTF-8" else encoding, "ignore")
    sep = sep or textual.sniff("\n".join(text.splitlines()[:50]))
    header = next((r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if any(c.strip() for c in r)), [])
    return CsvTraits(encoding, multiline, sep, tuple(header))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, traits: CsvTraits | None = None) -> DataFrame:
    """A delimited file of any size as text columns with _row_index. Encoding, delimiter and quoted line breaks are found out.

    Short records are filled with nulls; records with more cells than the header are left out, as broken; blank lines go."""
    t = traits or csv_traits(spark, path, sep, encoding)
    if not t.header:
        return with_row_index(spark.createDataFrame([], "column_1 string"))
    names = exprs.sanitize_names(list(t.header))
    kinds = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))] + [T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(kinds).option("header", True).option("enforceSchema", True).option("sep", t.sep).option("encoding", t.encoding).option("quote", '"').option("escape", '"')
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", t.multiline).option("maxCharsPerColumn", -1).option("columnPruning", False).csv(path)
    bare = F.regexp_replace("_bad", '"(?:[^"]|"")*"', "")
    cells = F.size(F.split(bare, re.escape(t.sep)))
    # the record itself can't be asked for alone, so the first cell is looked at too
    kept = df.filter((F.col("_bad").isNull() | (cells <= len(names))) & (F.coalesce("c0", F.lit("")) != F.lit("\0\0")))
    return with_row_index(kept.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names))))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of any size, nested objects flattened to dotted columns; bad lines are in _corrupt_record."""
    return flatten(spark.read.option("mode", "PERMISSIVE").json(path))


def flatten(df: DataFrame, depth: int = textual.DEPTH) -> DataFrame:
    """Struct columns as dotted ones down to a depth, arrays of plain values joined, other nested values as JSON."""

    def walk(prefix: str, kind: T.DataType, column, left: int):
        if isinstance(kind, T.StructType) and left > 1:
            for f in kind:
                yield from walk(f"{prefix}.{f.name}", f.dataType, column[f.name], left - 1)
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType | T.ArrayType | T.MapType):
            yield F.array_join(column.cast("array<string>"), ", ").alias(prefix)
        elif isinstance(kind, T.StructType | T.ArrayType | T.MapType):
            yield F.to_json(column).alias(prefix)
        else:
            yield column.alias(prefix)

    return df.select(*(c for f in df.schema for c in walk(f.name, f.dataType, F.col(f"`{f.name}`"), depth)))


def parse_log(df: DataFrame, value: str = "value") -> DataFrame:
    """df with timestamp, level, module and message of each line; lines of another shape are INFO messages."""
    line = F.trim(value)
    shape = f"(?i){textual.LOG_LINE}"
    part = [F.nullif(F.regexp_extract(line, shape, k), F.lit("")) for k in range(1, 5)]
    known = part[0].isNotNull() | part[1].isNotNull()
    level = F.when(known, F.upper(F.coalesce(part[1], F.lit("INFO")))).otherwise("INFO")
    return df.withColumns({"timestamp": part[0], "level": level, "module": F.when(known, part[2]), "message": F.when(known, part[3]).otherwise(line)})


def parse_key_values(df: DataFrame, value: str = "value") -> DataFrame:
    """(…, key, value) of the lines that are pairs; comments are left out."""
    line = F.trim(value)
    comment = "^(?:" + "|".join(re.escape(c) for c in textual.COMMENTS) + ")"
    pairs = df.filter(line.rlike(textual.KEY_VALUE) & ~line.rlike(comment))
    key, said = F.regexp_extract(line, textual.KEY_VALUE, 1), F.regexp_extract(line, textual.KEY_VALUE, 2)
    return pairs.withColumns({"key": key, "setting": F.regexp_replace(F.trim(said), r"^[\"']+|[\"']+$", "")})


def parse_markdown(df: DataFrame, value: str = "value") -> DataFrame:
    """df with the cells of each markdown table line; rulers and other lines are left out."""
    line = F.trim(value)
    rows = df.filter(line.rlike(r"^\|.*\|$") & ~line.rlike(r"^\|(?:\s*:?-+:?\s*\|)+$"))
    return rows.withColumn("cells", F.transform(F.split(F.substring(line, F.lit(2), F.length(line) - 2), r"\|"), lambda c: F.trim(c)))


def text_lines(df: DataFrame, text: str) -> DataFrame:
    """df with line_no, content, word_count and char_count of each line that isn't blank."""
    out = df.select("*", F.posexplode(F.split(text, "\n")).alias("_k", "_line"))
    line = F.trim("_line")
    out = out.filter(line != "").withColumns({"line_no": (F.col("_k") + 1).cast("long"), "content": line, "word_count": exprs.words_in(line).cast("long"), "char_count": F.char_length(line).cast("long")})
    return out.drop("_k", "_line")
