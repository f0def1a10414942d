"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. A block of documents (BLOCK characters or more) keeps its distinct words and, for each
document, the positions as a packed sequence of local word numbers. The words of all blocks are shuffled by word, so each
distinct word of the corpus is encoded once, in one task; the ids go back to the blocks by a second shuffle, meet the
packed documents there and are put into their positions. Words are packed by (block, bucket), so hot words cost one entry
a block and no key can gather the corpus. A block has at most FAN packs: where there are more tasks, FAN blocks' packs of a
bucket meet first, keep their distinct words, and are packed again for FAN buckets each, as if they were documents; so the
number of packs grows with the input, not with input times tasks. Blocks and buckets go to tasks by number, in turn. A task
holds the words of one bucket, or one block's words and some of its documents at a time.

Decoding joins the documents' ids, some documents a row, with the table of token bytes, whose size is the vocabulary's (at
most MOST_TOKENS, checked) and which is broadcast as one row.

Null and empty texts have no tokens; texts of any length are encoded whole; repeated rows stay; ids may be null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pretokens

BLOCK, CHUNK = 32_000_000, 400_000
FAN = 256
_LEVEL = 6
MOST_TOKENS = 1 << 20
_ROWS = "kind int, block long, slot int, data binary, ids array<long>, sizes array<int>"


def read_ranks(path: str) -> bytes:
    """The rank file's content; the driver reads it and sends it along (under 1 MB for 50,000 tokens)."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def token_bytes(ranks: bytes) -> dict[int, bytes]:
    """The table of token bytes by id."""
    table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines()) if a}
    if len(table) > MOST_TOKENS:
        raise ValueError("the vocabulary is larger than the documented bound")
    return table


@lru_cache(maxsize=2)
def _encoder(ranks: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("millrace", pat_str=r"[\s\S]+", mergeable_ranks={v: k for k, v in token_bytes(ranks).items()}, special_tokens={})


class _Numbers(dict):
    """Words numbered in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _planes(numbers: np.ndarray) -> bytes:
    """uint32 numbers by byte planes."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _whole(planes: bytes | memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _pack(numbers: np.ndarray) -> bytes:
    return zstandard.compress(_planes(numbers), _LEVEL)


def _unpack(data: bytes) -> np.ndarray:
    return _whole(zstandard.decompress(data))


def _pack_ranks(ranks: np.ndarray) -> bytes:
    """Numbers that are mostly small: one byte each, and what exceeds 254 apart."""
    large = ranks[ranks >= 255] - np.uint32(255)
    low = zstandard.compress(np.minimum(ranks, 255).astype(np.uint8).tobytes(), _LEVEL)
    return len(low).to_bytes(8, "little") + low + _pack(large)


def _unpack_ranks(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    ranks = np.frombuffer(zstandard.decompress(data[8 : 8 + n]), np.uint8).astype("<u4")
    ranks[ranks == 255] += _unpack(data[8 + n :])
    return ranks


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(len(words).to_bytes(4, "little") + _planes(sizes) + b"".join(words), _LEVEL)


def _unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(_whole(memoryview(raw)[4 : 4 + 4 * n]).astype(np.int64)) + 4 + 4 * n
    edges = [4 + 4 * n, *ends.tolist()]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _pack_ids(sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The ids of some words: how many words, how many ids each, all ids."""
    return len(sizes).to_bytes(4, "little") + _pack(np.concatenate([sizes.astype(np.uint32), ids.astype(np.uint32)]))


def _gather(start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids at so many places each, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)] if total else np.zeros(0, np.uint32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    names = ("kind", "block", "slot", "data", "ids", "sizes")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


class _Block:
    """The documents of one block: distinct words, and for each document the sequence of their numbers."""

    def __init__(self, chunk: int) -> None:
        self.words, self.chars, self.chunk = _Numbers(), 0, chunk
        self.ids: list[int | None] = []
        self.parts: list[np.ndarray] = []

    def add(self, doc: int | None, words: list, size: int) -> None:
        self.parts.append(np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words)))
        self.ids.append(doc)
        self.chars += size

    def rows(self, block: int, bucket_of: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Words are numbered anew, the most frequent first: then most numbers fit a byte. bucket_of: words' hashes to buckets."""
        counts = np.bincount(np.concatenate(self.parts), minlength=len(self.words))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        found = list(self.words)
        self.words.clear()
        words = [w if isinstance(w, bytes) else w.encode() for w in map(found.__getitem__, order.tolist())]
        del found
        bucket = bucket_of(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)))
        yield _batch([(1, block, -1, _pack(bucket), None, None)])
        order = np.argsort(bucket, kind="stable")
        rows = [(0, block, int(b), _pack_words([words[i] for i in order[s:e].tolist()]), None, None) for b, s, e in zip(*_runs(bucket[order]), strict=True)]
        if rows:
            yield _batch(rows)
        first = filled = slot = 0
        for k, part in enumerate(self.parts, 1):
            filled += len(part)
            if filled >= self.chunk or k == len(self.parts):
                own = self.parts[first:k]
                yield _batch([(2, block, slot, _pack_ranks(rank[np.concatenate(own)]), self.ids[first:k], list(map(len, own)))])
                first, filled, slot = k, 0, slot + 1


def _to_blocks(buckets: int, block: int, chunk: int):
    def coarse(h: np.ndarray) -> np.ndarray:
        return h % np.uint32(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count, now = TaskContext.get().partitionId() << 32, 0, _Block(chunk)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text.decode("utf-8", "replace")
                now.add(doc, pretokens.split(text), len(text))
                if now.chars >= block:
                    yield from now.rows(first + count, coarse)
                    count, now = count + 1, _Block(chunk)
        if now.ids:
            yield from now.rows(first + count, coarse)

    return run


def _regroup(buckets: int, fan: int, chunk: int):
    """Packs of words sorted by (group, slot) -> a block for each group and slot, whose documents are the packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, _Block(chunk)
        fine = lambda h: np.uint32(key[1] * fan) + h // np.uint32(buckets) % np.uint32(fan)
        for b in batches:
            for group, block, slot, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if (group, slot) != key:
                    if now.ids:
                        yield from now.rows(key[0] * buckets + key[1], fine)
                    key, now = (group, slot), _Block(chunk)
                now.add(block, _unpack_words(data), 0)
        if now.ids:
            yield from now.rows(key[0] * buckets + key[1], fine)

    return run


def _encode_words(ranks: bytes):
    """Packs of words (sorted by bucket) -> packs of their ids, in the same order: word sizes, then all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, bucket = _encoder(ranks)._encode_single_piece, {}, None
        for b in batches:
            rows = []
            for block, slot, data in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if slot != bucket:
                    known, bucket = {}, slot
                found = []
                for w in _unpack_words(data):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(encode(w), "<u4").tobytes()
                    found.append(ids)
                sizes = np.fromiter((len(x) // 4 for x in found), np.uint32, len(found))
                rows.append((1, block, slot, _pack_ids(sizes, np.frombuffer(b"".join(found), "<u4")), None, None))
            if rows:
                yield _batch(rows)

    return run


def _met_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows sorted by (block, kind, slot): the words' buckets and ids of a block, then its documents, which come out as
    (block, the table of its words' ids, word numbers, document ids, numbers of words)."""
    block = bucket = table = None
    packs: dict[int, bytes] = {}
    for b in batches:
        for kind, at, slot, data, ids, sizes in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if at != block:
                block, packs, table, bucket = at, {}, None, None
            if kind == 1 and slot < 0:
                bucket = _unpack(data)
            elif kind == 1:
                packs[slot] = data
            else:
                if table is None:
                    table, packs = _word_table(bucket, packs), {}
                yield block, table, _unpack_ranks(data), ids, np.array(sizes, np.int64)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, table, words, ids, sizes in _met_blocks(batches):
        yield _documents(table, words, ids, sizes)


def _reassemble_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with the documents of a chunk in one row."""
    for b in _reassemble(batches):
        docs = pa.StructArray.from_arrays(b.columns, ["id", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)], ["version", "docs"])


def _repack(buckets: int):
    """The same for the blocks that _regroup() makes: packs of ids for the packs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (start, size, flat), words, ids, sizes in _met_blocks(batches):
            rows, at = [], 0
            for own, n in zip(ids, sizes.tolist(), strict=True):
                mine = words[at : at + n]
                rows.append((1, own, block % buckets, _pack_ids(size[mine], _gather(start[mine], size[mine], flat)), None, None))
                at += n
            yield _batch(rows)

    return run


def _word_table(bucket: np.ndarray, packs: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size) of each local word's ids, and all ids."""
    start, size, flat, at = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64), [], 0
    order = np.argsort(bucket, kind="stable")
    edges = {int(k): (int(a), int(z)) for k, a, z in zip(*_runs(bucket[order]), strict=True)}
    for slot, data in packs.items():
        n, numbers = int.from_bytes(data[:4], "little"), _unpack(data[4:])
        own, ids = numbers[:n].astype(np.int64), numbers[n:]
        a, z = edges[slot]
        size[order[a:z]] = own
        start[order[a:z]] = at + np.cumsum(own) - own
        flat.append(ids)
        at += len(ids)
    return start, size, np.concatenate(flat) if flat else np.zeros(0, np.uint32)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[starts], starts, np.r_[starts[1:], len(x)][: len(starts)]


def _documents(table: tuple, words: np.ndarray, ids: list, sizes: np.ndarray) -> pa.RecordBatch:
    start, size, flat = table
    tokens = _gather(start[words], size[words], flat)
    cuts = np.r_[0, np.cumsum(size[words])][np.r_[0, np.cumsum(sizes)]]
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["id", "ids"])


def _in_turn(rows: DataFrame, n: int, number: Column) -> DataFrame:
    """rows dealt to n tasks by a number, in turn: hashes of a few large keys would meet by chance."""
    return rows.repartitionById(n, F.pmod(number, F.lit(n)).cast("int"))


def _met(docs: DataFrame, ranks: bytes, id_col: str, text_col: str, block: int, chunk: int, fan: int) -> DataFrame:
    """The rows that _reassemble() takes, dealt by block."""
    spark = docs.sparkSession
    common.bounded(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(n, fan)
    source = docs.select(F.col(id_col).cast("long").alias("id"), common.utf8(text_col).alias("t"))
    blocks = common.settle(source.mapInArrow(common.freed(_to_blocks(buckets, block, chunk)), _ROWS), "blocks")
    coded = _coded(blocks.filter("kind = 0"), ranks, n, buckets, fan, chunk)
    # the task that made a block, plus the block's place in it
    number = F.expr("shiftright(block, 32) + (block & 4294967295)")
    return _in_turn(blocks.filter("kind > 0").union(coded), n, number).sortWithinPartitions("block", "kind", "slot")


def _coded(words: DataFrame, ranks: bytes, n: int, buckets: int, fan: int, chunk: int) -> DataFrame:
    """Packs of ids of the packs of words."""
    if n <= buckets:
        return _in_turn(words, n, F.col("slot")).sortWithinPartitions("slot").mapInArrow(common.freed(_encode_words(ranks)), _ROWS)
    group = F.expr(f"shiftright(block, 32) div {fan}").alias("group")
    dealt = words.select(group, "block", "slot", "data").repartition(n, "group", "slot").sortWithinPartitions("group", "slot", "block")
    groups = common.settle(dealt.mapInArrow(common.freed(_regroup(buckets, fan, chunk)), _ROWS), "groups")
    coded = _in_turn(groups.filter("kind = 0"), n, F.col("slot")).sortWithinPartitions("slot").mapInArrow(common.freed(_encode_words(ranks)), _ROWS)
    back = _in_turn(groups.filter("kind > 0").union(coded), n, F.col("block")).sortWithinPartitions("block", "kind", "slot")
    return back.mapInArrow(common.freed(_repack(buckets)), _ROWS)


def encode(docs: DataFrame, ranks: bytes, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(id, ids): the token ids of each text. block: characters whose distinct words go together; chunk: words in a row;
    fan: most packs of a block."""
    return _met(docs, ranks, id_col, text_col, block, chunk, fan).mapInArrow(common.freed(_reassemble), "id long, ids array<int>")


_CHUNKS = "version int, docs array<struct<id:bigint,ids:array<int>>>"


def _decoded(chunks: DataFrame, ranks: bytes) -> DataFrame:
    """(id, ids, decoded) of rows of documents (see _CHUNKS); an id that the table lacks raises."""
    spark, known = chunks.sparkSession, token_bytes(ranks)
    table = spark.createDataFrame([(0, [known.get(k) for k in range(max(known, default=-1) + 1)])], "version int, tokens array<binary>")
    table = table.select("version", F.transform("tokens", lambda x: x.cast("string")).alias("tokens"))  # a string is any bytes here
    met = chunks.join(F.broadcast(table), "version")

    def token(i: Column) -> Column:
        return F.coalesce(F.when(i >= 0, F.get("tokens", i)), F.raise_error(F.concat(F.lit("no such token: "), i.cast("string"))).cast("string"))

    whole = F.transform("docs", lambda d: F.struct(d["id"].alias("id"), d["ids"].alias("ids"), F.array_join(F.transform(d["ids"], token), "").alias("decoded")))
    out = met.select(F.inline(whole))
    return out.select("id", "ids", F.col("decoded").cast("binary").alias("decoded"))


def decode(tokens: DataFrame, ranks: bytes, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): the bytes of each list of ids; an id that the table lacks raises. Null counts as no ids."""
    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.expr("array()").cast("array<int>"))
    version = F.pmod(F.size(ids), F.lit(1)).alias("version")  # 0, but not a constant, which would make the join a nested loop
    return _decoded(tokens.select(version, F.array(F.struct(F.col(id_col).cast("long").alias("id"), ids.alias("ids"))).alias("docs")), ranks)


def round_trip(docs: DataFrame, ranks: bytes, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """decode(encode(docs)); the table of token bytes meets some documents a row."""
    return _decoded(_met(docs, ranks, id_col, text_col, block, chunk, fan).mapInArrow(common.freed(_reassemble_chunks), _CHUNKS), ranks)


def digests(decoded: DataFrame) -> DataFrame:
    """(id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256) of decode()'s rows."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    return decoded.select("id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary(spark: SparkSession, ranks: bytes) -> DataFrame:
    """The token-byte table (token, bytes) as a DataFrame, for joins in SQL."""
    return spark.createDataFrame([(k, bytearray(v)) for k, v in token_bytes(ranks).items()], "token int, bytes binary")
