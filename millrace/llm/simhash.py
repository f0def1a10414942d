"""SimHash near-duplicate groups by segment-popcount embedding.

A 64-bit fingerprint becomes the vector of bit counts of its 16 four-bit segments. Flipping one bit moves that vector by
one in Manhattan distance, so fingerprints within two bits lie within Manhattan distance two, and two such integer
vectors always have a common vector at distance one or less from both. Each distinct fingerprint is therefore put into
the grid cell of its own vector and those of the 32 vectors around it; fingerprints that meet in a cell are candidates,
and their differing bits are counted exactly. Cells are streamed in sorted order. In a cell with more than CROWD
fingerprints no pairs are made: each fingerprint of such a cell is linked, once, to the 64 values one bit away, which joins
exactly those fingerprints that are within two bits of each other.

Nulls and empty texts have fingerprint zero and are linked like any other; repeated rows stay; a null id is kept and
never becomes a component's id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
SEGMENTS, WIDTH = 16, 4
#: A cell with more fingerprints than this is linked through one-bit neighbours instead of pairs.
CROWD = 128
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) > shingle:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    else:
        grams, n = iter([b" ".join(words)]), 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, n)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit number."""
    common.bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x, shingle) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.utf8(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def _cells(fp: Column) -> Column:
    """The packed count vector of fp and those at Manhattan distance one; null where a count would leave its range."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1))).cast("long") for k in range(SEGMENTS)]
    own = counts[0]
    for k in range(1, SEGMENTS):
        own = own + F.shiftleft(counts[k], 3 * k)
    around = [F.when(c < WIDTH, F.col("own") + F.lit(1 << 3 * k)) for k, c in enumerate(counts)]
    around += [F.when(c > 0, F.col("own") - F.lit(1 << 3 * k)) for k, c in enumerate(counts)]
    return own, F.array(F.col("own"), *around)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp) sorted by both -> verified links (a, b), and (a, a) for each fingerprint of a crowded cell.
    Holds at most CROWD fingerprints of the cell at hand."""
    held: np.ndarray = np.zeros((0, 2), np.int64)
    crowd: int | None = None  # the crowded cell that is being streamed

    def out(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    def done(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Whole cells of at most CROWD rows each."""
        found = []
        cell, fp = rows[:, 0], rows[:, 1].copy()
        for d in range(1, CROWD):
            same = np.flatnonzero(cell[d:] == cell[:-d]) if len(cell) > d else np.zeros(0, np.int64)
            if not len(same):
                break
            a, b = fp[same], fp[same + d]
            ok = np.bitwise_count(a ^ b) <= 2
            found.append((a[ok], b[ok]))
        return found

    for batch in batches:
        rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        links = []
        if crowd is not None:  # rows of a cell that is known to be crowded
            k = int(np.searchsorted(rows[:, 0], crowd, side="right"))
            if k:
                links.append((rows[:k, 1], rows[:k, 1]))
            rows, crowd = rows[k:], crowd if k == len(rows) else None
        rows = np.concatenate([held, rows])
        if not len(rows):
            yield from out(links)
            continue
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        sizes = np.diff(np.r_[starts, len(rows)])
        last = int(starts[-1])
        for s, n in zip(starts[sizes > CROWD], sizes[sizes > CROWD], strict=True):
            links.append((rows[s : s + n, 1], rows[s : s + n, 1]))
        small = np.repeat((sizes <= CROWD) & (sizes > 1), sizes)
        small[last:] = False
        if small.any():
            links += done(rows[small])
        held = rows[last:].copy()
        if sizes[-1] > CROWD:
            crowd, held = int(rows[last, 0]), held[:0]
        yield from out(links)
    if len(held) > 1:
        yield from out(done(held))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints of distinct (column fp) that differ in two bits or fewer."""
    spark = distinct.sparkSession
    common.bounded(spark)
    own, around = _cells(F.col("fp"))
    cells = distinct.select("fp", own.alias("own")).select(F.explode(around).alias("cell"), "fp").filter(F.col("cell").isNotNull())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(_links, "a long, b long")
    found = common.settle(found.distinct(), "pairs")
    crowded = found.filter("a = b").select("a", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    near = crowded.select("a", F.expr("a ^ shiftleft(1L, bit)").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.filter("a <> b").union(near).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node of the component.

    Alternating large-star and small-star steps over written tables: each step is one join on the nodes, and the number of
    steps grows with the logarithm of the component's diameter."""
    now = common.settle(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")), "links")
    seen = None
    while True:
        both = now.union(now.select("m", "v"))
        least = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = common.met(both, least, "v", "least").filter(F.col("m") > F.col("v")).select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        large = common.settle(large, "large")
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = common.met(large, least, "v", "least").select(F.when(F.col("m") == F.col("low"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("low").alias("m"))
        before, now = now, common.settle(small.filter("v <> m").distinct(), "links")
        common.done(before, large)
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, m))")).first()
        if state == seen:
            return now.select(F.col("v").alias("node"), F.col("m").alias("root"))
        seen = state


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id): one row per document; component_id is the smallest id that links of two bits reach."""
    prints = common.settle(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = common.settle(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    comp = components(links(distinct))
    placed = common.met(distinct, comp.select(F.col("node").alias("fp"), "root"), "fp", "roots", "left")
    heads = comp.select(F.col("root").alias("fp")).distinct().select("fp", F.col("fp").alias("self"))
    placed = common.settle(common.met(placed, heads, "fp", "heads", "left").select("fp", "first", F.coalesce("root", "self").alias("root")), "placed")
    lowest = placed.filter("root is not null").groupBy("root").agg(F.min("first").alias("low"))
    of = common.met(placed, lowest, "root", "lowest", "left").select("fp", F.coalesce("low", "first").alias("component_id"))
    return prints.join(of, "fp").select("id", "fp", "component_id")
