"""Media columns: payloads as 8-bit greyscale PNG in a binary column, read back with checksum tests, and cosine hashes.

Writing puts the payload into rows of 64 samples, filters the image by that one of the filters none, sub and up that
leaves the smallest residues, compresses it with zlib and wraps it into chunks with their CRC-32; a tEXt chunk holds the
unpadded length. Reading tests the signature, every chunk's CRC and the sample count, inflates the data and undoes any of
the five row filters with numpy. The feature is the sign pattern of the 8x8 lowest cosine frequencies of the image,
scaled to 32x32.

A null or empty payload becomes one row of zeros; long ones become tall images; equal payloads give equal bytes; repeated
rows stay; a damaged image raises; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6
_SIDE, _LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, text: dict[str, str] | None = None) -> bytes:
    """A greyscale image (height x width, uint8) as PNG."""
    height, width = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    kinds = (samples, left, up)
    cost = [int(np.minimum(x, 0 - x).sum(dtype=np.int64)) if k else int(x.sum(dtype=np.int64)) for k, x in enumerate(kinds)]
    best = int(np.argmin(cost))
    raw = np.empty((height, width + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = best, kinds[best]
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1")) for k, v in (text or {}).items()]
    return b"".join([*parts, _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)), _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of one-byte samples; runs of rows with the same filter go together."""
    out = rows.copy()
    edges = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        kind = int(kinds[a])
        above = out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            out[a:b] = np.cumsum(rows[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(np.vstack([above[None], rows[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for r in range(a, b):
                out[r] = above = _predicted(kind, rows[r].tolist(), above.tolist())
        elif kind:
            raise ValueError(f"PNG: unknown filter {kind}")
    return out


def _predicted(kind: int, row: list[int], above: list[int]) -> np.ndarray:
    left = corner = 0
    for i, (x, b) in enumerate(zip(row, above, strict=True)):
        if kind == 3:
            guess = (left + b) >> 1
        else:
            near = ((abs(b - corner), 0, left), (abs(left - corner), 1, b), (abs(left + b - 2 * corner), 2, corner))
            guess = min(near)[2]
        row[i] = left = (x + guess) & 255
        corner = b
    return np.array(row, np.uint8)


def decode_png(data: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(samples, text fields) of an 8-bit greyscale PNG; ValueError if anything in it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: no signature")
    at, size, body, text, ended = 8, None, [], {}, False
    while at < len(data) and not ended:
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError(f"PNG: checksum of {kind!r} fails")
        at += 12 + n
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"tEXt":
            key, _, value = part.partition(b"\0")
            text[key.decode("latin-1")] = value.decode("latin-1")
        ended = kind == b"IEND"
    if not ended or size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG: cut short or of another kind")
    width, height = size[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("PNG: wrong number of samples")
    raw = raw.reshape(height, width + 1)
    return _unfilter(raw[:, 0], raw[:, 1:]), text


def _basis() -> np.ndarray:
    k, x = np.arange(_LOW)[:, None], np.arange(_SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * _SIDE))


def _binned(image: np.ndarray, axis: int) -> np.ndarray:
    """The mean of the samples of each of 32 equal parts along the axis; a short axis repeats its samples."""
    n = image.shape[axis]
    edges = np.arange(_SIDE) * n // _SIDE
    if n < _SIDE:
        return np.take(image, edges, axis=axis)
    sums = np.add.reduceat(image, edges, axis=axis)
    counts = np.diff(np.r_[edges, n]).reshape((-1, 1) if axis == 0 else (1, -1))
    return sums / counts


def cosine_hash(samples: np.ndarray, basis: np.ndarray | None = None) -> bytes:
    """8 bytes: for each of the 64 lowest frequencies, whether it exceeds the median of all but the constant one."""
    basis = _basis() if basis is None else basis
    small = _binned(_binned(samples.astype(np.float64), 0), 1)
    low = np.round(basis @ small @ basis.T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes()


def to_media(payload: bytes, unit: int = ROW) -> bytes:
    """The payload, padded with zeros to a positive multiple of the row, as PNG."""
    padded = payload + bytes(-len(payload) % unit or (0 if payload else unit))
    return encode_png(np.frombuffer(padded, np.uint8).reshape(-1, unit), {"Length": str(len(payload))})


def encode(rows: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """(id, media): each row's payload as PNG bytes."""
    common.bounded(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = pa.array([to_media(x) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), media], ["id", "media"])

    return rows.select(F.col(id_col).cast("long").alias("id"), common.utf8(payload_col).alias("p")).mapInArrow(run, "id long, media binary")


def read_back(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload, media_bytes, feature): the stored images decoded; payload is padded, feature has 8 bytes."""
    common.bounded(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = _basis()
        for b in batches:
            images = [decode_png(x) for x in b.column(1).to_pylist()]
            columns = [
                b.column(0),
                pa.array([int(t.get("Length", s.size)) for s, t in images], pa.int64()),
                pa.array([s.tobytes() for s, _ in images], pa.binary()),
                b.column(1).cast(pa.binary()),
                pa.array([cosine_hash(s, basis) for s, _ in images], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "payload", "media", "feature"])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, n_bytes long, payload binary, media binary, feature binary")
