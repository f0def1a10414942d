"""Token files as wavelet matrices, one a shard.

Documents are dealt by ranges of (id, hash of the text), sorted, encoded with the tokenizers library and followed by an end
id; a shard takes whole documents until it has SHARD tokens. A shard is one compressed file: a head, the documents' sizes
and one bit-plane for each bit of an id, highest first; each plane's zeros go before its ones in the next. Planes are
compressed in blocks of BLOCK bytes, and the file's head holds where each block lies and how many ones precede it. So a token
at a place, or the count of a token before one, reads one or two blocks a plane, and the place of an occurrence one a plane,
which the samples of ones (and so of zeros) name; nothing else is decompressed.
Shards are rows (part, shard, offset, tokens, data) of a table in the shared folder. A document's start is the sum over the
parts before its own (one number a range partition), plus the shard's offset in the part, plus what precedes it in the shard.

Each distinct pre-token is encoded once per worker, as far as its cache of the last KNOWN to 2 KNOWN pre-tokens reaches; the library matches special tokens first, so their strings are cut out before. Ids up to 32 bits are supported.

Null and empty texts have the end id only; ids may be null (first) or repeat (ordered by text hash, then text); texts of any
length are encoded whole; a damaged file raises; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common, pretokens

MAGIC = b"MWM2"
#: Bytes of a plane that are compressed together: 32,768 tokens' bits.
BLOCK = 4096
SHARD, KNOWN = 1 << 19, 600_000
_LEVEL = 1


class WaveletMatrix:
    """A sequence of non-negative ids as bit-planes with rank and select, read by blocks.

    ones[level]: how many ones precede each block of the plane, and how many it has in all; block(level, k): the block's bits,
    packed, little-endian. Levels count from the ids' highest bit."""

    def __init__(self, n: int, ones: np.ndarray, block: Callable[[int, int], np.ndarray]) -> None:
        self.n, self.ones, self._block = n, ones, block
        self.levels = len(ones)
        self.zeros = (n - ones[:, -1]).tolist()
        self._last: dict[int, tuple[int, np.ndarray]] = {}  # the block last read of each plane

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        kind = np.uint16 if levels <= 16 else np.uint32
        x, planes = ids.astype(kind), []
        for level in range(levels - 1, -1, -1):
            set_ = (x & kind(1 << level)) != 0
            planes.append(np.packbits(set_, bitorder="little"))
            if level:
                x = np.concatenate([x.take(np.flatnonzero(~set_)), x.take(np.flatnonzero(set_))])
        ones = np.stack([cls._counts(p) for p in planes])
        return cls(len(ids), ones, lambda level, k: planes[level][k * BLOCK : (k + 1) * BLOCK])

    @staticmethod
    def _counts(plane: np.ndarray) -> np.ndarray:
        starts = np.arange(0, len(plane), BLOCK)
        per = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), starts) if len(plane) else np.zeros(0, np.int64)
        return np.r_[0, np.cumsum(per)]

    def block(self, level: int, k: int) -> np.ndarray:
        if self._last.get(level, (-1,))[0] != k:
            self._last[level] = k, self._block(level, k)
        return self._last[level][1]

    def all(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            plane = np.concatenate([self._block(level, k) for k in range(self.ones.shape[1] - 1)]) if self.n else np.zeros(0, np.uint8)
            set_ = np.unpackbits(plane, count=self.n, bitorder="little").view(np.bool_)
            out, z = np.empty(self.n, kind), self.zeros[level]
            x[z:] |= kind(1 << (self.levels - 1 - level))
            out[np.flatnonzero(~set_)], out[np.flatnonzero(set_)] = x[:z], x[z:]
            x = out
        return x

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, 8 * BLOCK)
        if not rest:
            return int(self.ones[level, k])
        bits = self.block(level, k)
        part = int(bits[rest >> 3] & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else 0
        return int(self.ones[level, k]) + int(np.bitwise_count(bits[: rest >> 3]).sum(dtype=np.int64)) + part

    def _bit(self, level: int, i: int) -> int:
        k, rest = divmod(i, 8 * BLOCK)
        return int(self.block(level, k)[rest >> 3]) >> (rest & 7) & 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, z in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value, i = value << 1 | bit, z + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """The places in the last order of the token's occurrences among the first i."""
        if token < 0 or token >> self.levels:
            return 0, 0
        a, b = 0, i
        for level, z in enumerate(self.zeros):
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            a, b = (z + ra, z + rb) if token >> (self.levels - 1 - level) & 1 else (a - ra, b - rb)
        return a, b

    def rank(self, token: int, i: int | None = None) -> int:
        """How often the token occurs among the first i (all)."""
        a, b = self._range(token, self.n if i is None else i)
        return b - a

    def _select(self, level: int, bit: int, which: np.ndarray) -> np.ndarray:
        """The places of the which-th (from 0, ascending) bits of that kind in a plane; a block is read once."""
        blocks = self.ones.shape[1] - 1
        before = self.ones[level] if bit else np.minimum(np.arange(blocks + 1) * 8 * BLOCK, self.n) - self.ones[level]
        k = np.searchsorted(before, which, side="right") - 1
        out = np.empty(len(which), np.int64)
        for b, s, e in zip(*_spans(k), strict=True):
            count = min(8 * BLOCK, self.n - int(b) * 8 * BLOCK)
            places = np.flatnonzero(np.unpackbits(self.block(level, int(b)), count=count, bitorder="little") == bit)
            out[s:e] = places[which[s:e] - before[b]] + int(b) * 8 * BLOCK
        return out

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        """Places in the last order to places in the sequence."""
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        return int(self._up(token, np.array([a + k]))[0])

    def occurrences(self, token: int, limit: int | None = None) -> list[int]:
        """The places of the token, the first ones if limited; all go up the planes together."""
        a, b = self._range(token, self.n)
        return self._up(token, np.arange(a, b if limit is None else min(b, a + limit))).tolist()


def _spans(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, start, end) of the runs of an ascending array."""
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[starts], starts, np.r_[starts[1:], len(k)][: len(starts)]


_HEAD = "<4sQQIIII"
_COUNTED = struct.calcsize(_HEAD) - 8  # bytes of the head before its two checksums


def dump(ids: np.ndarray, docs: Iterable[int | None], sizes: Iterable[int]) -> bytes:
    """A shard's file: tokens, and which documents with how many tokens they are of."""
    matrix = WaveletMatrix.of(ids)
    docs, sizes = list(docs), np.array(list(sizes), "<u8")
    known = np.array([d is not None for d in docs], np.uint8)
    table = zstandard.compress(known.tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes() + sizes.tobytes(), _LEVEL)
    blocks, press = matrix.ones.shape[1] - 1, zstandard.ZstdCompressor(level=_LEVEL).compress
    parts = [press(matrix.block(level, k).tobytes()) for level in range(matrix.levels) for k in range(blocks)]
    index = np.cumsum([0, *map(len, parts)]).astype("<u4").tobytes() + matrix.ones.astype("<u4").tobytes()
    body = b"".join(parts)
    head = struct.pack(_HEAD, MAGIC, matrix.n, len(docs), matrix.levels, len(table), 0, zlib.crc32(body))
    head = struct.pack(_HEAD, *struct.unpack(_HEAD, head)[:5], zlib.crc32(table + index, zlib.crc32(head[:_COUNTED])), zlib.crc32(body))
    return b"".join([head, table, index, body])


def open_shard(data: bytes, check: bool = False) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(matrix, documents, their sizes) of a shard's file; ValueError if it is damaged. Planes are decompressed by block, when
    they are asked for; check: test the checksum of all of them at once, too."""
    try:
        magic, n, docs, levels, size, crc, body_crc = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        blocks = -(-n // (8 * BLOCK))
        ends_at, ones_at = at + size, at + size + 4 * (levels * blocks + 1)
        first = ones_at + 4 * levels * (blocks + 1)
        if magic != MAGIC or zlib.crc32(memoryview(data)[at:first], zlib.crc32(data[:_COUNTED])) != crc:
            raise ValueError
        ends = np.frombuffer(data, "<u4", levels * blocks + 1, ends_at).astype(np.int64) + first
        ones = np.frombuffer(data, "<u4", levels * (blocks + 1), ones_at).astype(np.int64).reshape(levels, blocks + 1)
        if len(data) != ends[-1] or (check and zlib.crc32(memoryview(data)[first:]) != body_crc):
            raise ValueError
        table = zstandard.decompress(data[at : at + size])
    except (ValueError, struct.error, zstandard.ZstdError):
        raise ValueError("token file: damaged") from None
    plain = zstandard.ZstdDecompressor().decompress

    def block(level: int, k: int) -> np.ndarray:
        j = level * blocks + k
        try:
            return np.frombuffer(plain(data[ends[j] : ends[j + 1]]), np.uint8)
        except zstandard.ZstdError:
            raise ValueError("token file: damaged") from None

    known = np.frombuffer(table, np.uint8, docs).tolist()
    ids = np.frombuffer(table, "<i8", docs, docs).tolist()
    return WaveletMatrix(n, ones, block), [d if k else None for d, k in zip(ids, known, strict=True)], np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64)


def load(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """open_shard() with every checksum tested."""
    return open_shard(data, True)


class _Pieces(dict):
    """Ids of pre-tokens as uint32 bytes; those not met lately are asked of the library and the oldest half goes when full."""

    def __init__(self, library: Tokenizer, fixed: dict[str, bytes]) -> None:
        super().__init__(fixed)
        self.model, self.alphabet, self.fixed, self.older = library.model.tokenize, _alphabet(), fixed, {}
        self.space = self.alphabet[32]  # of printable ASCII only the space is shown as another character

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            shown = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
            ids = array("I", [t.id for t in self.model(shown)]).tobytes()
        if len(self) >= KNOWN:
            self.older = dict(self)
            self.clear()
            self.update(self.fixed)
        self[piece] = ids
        return ids


class _Encoder:
    """The tokenizers library, asked once for each distinct pre-token."""

    def __init__(self, json: bytes) -> None:
        library = Tokenizer.from_str(json.decode())
        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known = _Pieces(library, {k: np.uint32(i).tobytes() for k, i in special.items()})

    def _pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return pretokens.split(text)
        out, last = [], 0
        for m in self.special.finditer(text):
            out += pretokens.split(text[last : m.start()])
            out.append(m[0])
            last = m.end()
        return out + pretokens.split(text[last:])

    def encode(self, text: str, end: int) -> bytes:
        """The text's ids and the end id, as uint32 bytes."""
        return b"".join([*map(self.known.__getitem__, self._pieces(text)), np.uint32(end).tobytes()])


def _alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _encoder(json: bytes) -> _Encoder:
    return _Encoder(json)


_SHARDS = "part int, shard int, offset long, tokens long, docs long, data binary"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _SHARDS.split(", ")])


def _to_shards(json: bytes, end: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(json), TaskContext.get().partitionId()
        number = offset = 0
        docs, sizes, parts, filled = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return _table([(part, number, offset, len(ids), len(docs), dump(ids, docs, sizes))])

        with common.uncollected():
            for b in batches:
                for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    coded = encoder.encode(raw.decode("utf-8", "replace"), end)
                    docs.append(doc)
                    sizes.append(len(coded) // 4)
                    parts.append(coded)
                    filled += sizes[-1]
                    if filled >= shard:
                        yield close()
                        number, offset = number + 1, offset + filled
                        docs, sizes, parts, filled = [], [], [], 0
            if docs:
                yield close()

    return run


def write(docs: DataFrame, path: str, json: bytes, end: int, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> None:
    """Write the documents' shards below path, in ascending order of id."""
    spark = docs.sparkSession
    common.bounded(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.utf8(text_col).alias("t"))
    # the hash splits an id that very many rows have
    dealt = rows.repartitionByRange(n, F.col("id"), F.xxhash64("t")).sortWithinPartitions(F.col("id"), F.xxhash64("t"), "t")
    dealt.mapInArrow(_to_shards(json, end, shard), _SHARDS).write.parquet(path)


def read(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids as uint32 bytes) of each document, decoded from the rows of shards."""
    common.bounded(files.sparkSession)
    totals = files.groupBy("part").agg(F.sum("tokens").alias("all"))  # as many rows as there are range partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(base), "part").select((F.col("base") + F.col("offset")).alias("first"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                matrix, docs, sizes = load(data)
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                raw = [ids[a:z].tobytes() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(starts + first), pa.array(sizes), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def find(files: DataFrame, token: int, limit: int | None = None) -> DataFrame:
    """(part, shard, n, places): how often a token occurs in each shard and where, from the planes' blocks that lead there.

    limit: at most so many places of each shard (None: all)."""
    common.bounded(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                matrix = open_shard(data)[0]
                row = ((part, pa.int32()), (shard, pa.int32()), (matrix.rank(token), pa.int64()), (matrix.occurrences(token, limit), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in row], ["part", "shard", "n", "places"])

    return files.select("part", "shard", "data").mapInArrow(run, "part int, shard int, n long, places array<long>")
