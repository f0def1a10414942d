"""WARC archives: records with revisits, segments and chunked transfer framing, written and read through Spark.

Writing makes one record per row. Of rows with equal payloads of at least LEAST_REVISIT bytes, the one with the smallest id
is a response and the others are revisits that refer to it; equal payloads are found by SHA-256, grouped before the join,
which AQE splits where one payload has very many rows. A response holds an HTTP message whose body is framed in chunks; a
block longer than a segment goes on in continuation records. Archives are files in the shared folder, of about ARCHIVE bytes
each before compression; every record is a gzip member of its own, as other readers expect, and what the writer puts between
rows is an empty member. A revisit names its response by address and date; identifiers belong to one record each.

Reading parses archives (gzip or plain, also foreign ones) by Content-Length, decompressing a piece at a time. Segmented
records are grouped by the origin's identifier, ordered by segment number and checked for gaps and for their total length;
then chunked framing is decoded and the payload's digest verified. A task holds one archive file as it is stored, or the
segments of one record.

A null payload is empty; a null id is kept and never referred to; rows repeated with the same id and payload give as many
records (foreign copies that share identifiers have their segments paired off); damaged archives raise; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n"
LEAST_REVISIT = 100
#: Bytes of a chunk, of a segment's block, and of an archive before compression.
CHUNK, SEGMENT, ARCHIVE = 8 << 10, 64 << 10, 16 << 20
#: Bytes that are decompressed at a time, of how many compressed ones, and the level at which records are compressed.
PIECE, TAKEN, _LEVEL = 1 << 20, 8 << 10, 6
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("8d1b0a54-3a3c-5b8f-9a53-0f9df5a6b1c7")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_READ = "row long, id string, kind string, segment int, total long, refers_to long, length long, digest string, block binary"
_OUT = "row long, record_type string, refers_to long, length long, digest string, payload binary"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The content of a chunked body; extensions and trailers are skipped. ValueError if the framing is damaged."""
    out, at = [], 0
    while True:
        end = body.find(END, at)
        head = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?", body[at:end], re.S) if end >= 0 else None
        if head is None:
            raise ValueError("chunked framing: no chunk size")
        size, at = int(head[1], 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != END:
            raise ValueError("chunked framing: chunk has another length")
        out.append(body[at : at + size])
        at += size + 2


def _identifier(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '/'.join(map(str, parts)))}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"".join([VERSION, END, head.encode(), END, block])


def records(row: int | None, url: str | None, payload: bytes, digest: str, first: int | None, first_url: str | None, revisit: bool, serial: str = "", segment: int = SEGMENT) -> list[bytes]:
    """The records of one row, without the two line ends that follow each. serial: what tells the row from all others."""
    own = _identifier(row, digest, serial)
    clean, first_url = (None if u is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u) for u in (url, first_url))
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", clean)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Millrace-Row", row), ("Millrace-Payload-Length", len(payload))]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", first_url), ("WARC-Refers-To-Date", DATE), ("Millrace-Refers-To-Row", first)]
        return [_record(fields, _HTTP + END)]
    block = b"".join([_HTTP, b"Transfer-Encoding: chunked\r\n\r\n", chunked(payload)])
    if len(block) <= segment:
        return [_record(fields, block)]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [_record([*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", _identifier(row, digest, serial, n)), ("WARC-Date", DATE), ("WARC-Target-URI", clean)]
        more += [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)]
        out.append(_record(more, part))
    return out


def _member(data: bytes) -> bytes:
    """A gzip member."""
    c = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _writer(archive: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, filled, serial = part << 32, 0, 0
        for b in batches:
            numbers, out = [], []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                serial += 1
                for record in records(*row, serial=f"{part}/{serial}", segment=segment):
                    if filled >= archive:
                        number, filled = number + 1, 0
                    numbers.append(number)
                    out.append(_member(record + END + END))
                    filled += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(out, pa.binary())], ["archive", "record"])

    return run


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive: int = ARCHIVE, segment: int = SEGMENT) -> None:
    """Write the rows as archives below path (any folder that Spark's writers reach)."""
    common.bounded(pages.sparkSession)
    payload = common.utf8(payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("row"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = F.octet_length("payload") >= LEAST_REVISIT
    repeated = rows.filter(long).groupBy("digest").agg(F.min("row").alias("first"), F.min_by("url", "row").alias("first_url"), F.count("*").alias("n")).filter("n > 1")
    joined = rows.join(repeated.select("digest", "first", "first_url"), "digest", "left")
    revisit = F.coalesce(long & F.col("first").isNotNull() & ~F.col("row").eqNullSafe(F.col("first")), F.lit(False))
    plan = joined.select("row", "url", "payload", "digest", "first", "first_url", revisit.alias("revisit"))
    out = plan.mapInArrow(_writer(archive, segment), "archive long, record binary")
    lines = out.select("archive", F.col("record").cast("string").alias("value"))  # bytes, written as they are
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", _member(b"").decode("latin-1")).option("compression", "none").partitionBy("archive").text(path)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The content of a plain or gzip file of any number of members, PIECE bytes at a time."""
    view, at = memoryview(data), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof:
            chunk = d.unconsumed_tail or view[at : at + TAKEN]  # what follows the member is copied
            if not len(chunk):
                raise ValueError("WARC: a gzip member is cut short")
            at += 0 if d.unconsumed_tail else len(chunk)
            try:
                out = d.decompress(chunk, PIECE)
            except zlib.error as e:
                raise ValueError(f"WARC: a gzip member is damaged ({e})") from None
            if out:
                yield out
        at -= len(d.unused_data)
    for k in range(at, len(view), PIECE):
        yield bytes(view[k : k + PIECE])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record; no more than a record and a piece is held."""
    pieces, held, at = _pieces(data), bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while len(held) - at < 2 and more():
            pass
        if held[at : at + 2] == END:
            at += 2
            continue
        if at == len(held):
            return
        while (end := held.find(END + END, at)) < 0 and more():
            pass
        lines = bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("WARC: no record where one should start")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, at = int(fields["content-length"]), end + 4
        while len(held) - at < size and more():
            pass
        if len(held) - at < size:
            raise ValueError("WARC: a record is cut short")
        block = bytes(held[at : at + size])
        at += size
        yield fields, block


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, without transfer framing."""
    head, _, body = block.partition(END + END)
    return dechunked(body) if re.search(rb"^transfer-encoding:.*\bchunked\b", head, re.I | re.M) else body


def _row(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(fields[k]) if k in fields else None
    return (
        number("millrace-row"), fields.get("warc-segment-origin-id", fields.get("warc-record-id")), fields.get("warc-type"), number("warc-segment-number"), number("warc-segment-total-length"),
        number("millrace-refers-to-row"), number("millrace-payload-length"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, block,
    )


_KINDS = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
_OUT_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())


def _table(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])


def _finished(row: int | None, kind: str, refers: int | None, length: int | None, digest: str | None, block: bytes) -> tuple:
    if kind == "revisit":
        return row, kind, refers, length, digest, None
    payload = payload_of(block)
    own = hashlib.sha256(payload).hexdigest()
    if digest is not None and own != digest:
        raise ValueError("WARC: the payload's digest differs")
    return row, kind, None, len(payload), own, payload


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0).to_pylist():
            rows, held = [], 0
            for fields, block in parse(data):
                if fields.get("warc-type") in ("response", "resource", "revisit") and "warc-segment-number" not in fields:
                    row, _, kind, _, _, refers, length, digest, block = _row(fields, block)
                    rows.append(_finished(row, kind, refers, length, digest, block))
                    held += len(block)
                if held >= common.BATCH_BYTES:
                    yield _table(rows, _OUT_KINDS, _OUT)
                    rows, held = [], 0
            yield _table(rows, _OUT_KINDS, _OUT)


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0).to_pylist():
            yield _table([_row(f, x) for f, x in parse(data) if "warc-segment-number" in f], _KINDS, _READ)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (id, segment) -> records. Equal copies of a record have as many of each segment."""
    held: list[tuple] = []

    def finish() -> list[tuple]:
        first = [x for x in held if x[3] == 1]
        copies = len(first)
        if not copies or len(held) % copies or any(x[3] != k // copies + 1 for k, x in enumerate(held)):
            raise ValueError(f"WARC: segments of {held[0][1]} are missing")
        out = []
        for k, x in enumerate(first):
            parts = held[k::copies]
            block = b"".join(p[8] for p in parts)
            if parts[-1][4] != len(block):
                raise ValueError(f"WARC: the segments of {x[1]} have another total length")
            out.append(_finished(x[0], x[2], x[5], x[6], x[7], block))
        return out

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][1] != row[1]:
                yield _table(finish(), _OUT_KINDS, _OUT)
                held = []
            held.append(row)
    if held:
        yield _table(finish(), _OUT_KINDS, _OUT)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(row, record_type, refers_to, length, digest, payload) of the archives below path; revisits have no payload."""
    common.bounded(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = files.mapInArrow(_read_segments, _READ).repartition(n, "id").sortWithinPartitions("id", "segment")
    return files.mapInArrow(_read_whole, _OUT).union(parts.mapInArrow(_reassemble, _OUT))
