"""Near copies of whole texts: SimHash groups that hold a similarity.

Two texts count as near copies if the Jaccard similarity of their sets of SHINGLE-word shingles (words as in simhash) is
LEAST or more. Texts whose SimHash fingerprints are linked on the segment-popcount grid (simhash.links) are candidates,
also those that meet at a value between them only. On
so short a distance (two bits) that finds the closest copies only: at a similarity of 0.8 fingerprints lie about ten bits
apart. So each text also gets SKETCHES fingerprints of parts: the SimHash of the PICKS shingles that come first under as
many hash orders, which two texts share with probability similarity ** PICKS each; texts that share one are candidates too.
Groups of at most FEW candidates are compared pair by pair. In a larger one each is first compared with the group's HUBS hubs
(the texts that share most sketches with others, as originals do with their edited copies) and its first text. Where that
leaves a large group in parts, all its texts are searched for pairs of different parts by a prefix filter on rare shingles,
which loses none that reach the similarity. So of all candidates no pair is left unjoined. Every link is verified on the
whole shingle sets, and verified links are joined into components. groups(exact=True) searches all texts with the prefix
filter, whether they are candidates or not, and so finds every pair.

Texts of equal words are one node from the start, so large groups of exact copies make no links. Texts without words are
copies of each other. Null ids are kept; rows repeated with the same id and text are copies; an empty table gives an empty
result; other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE, LEAST = 5, 0.8
SKETCHES, PICKS = 16, 4
#: Groups up to this size are compared pair by pair, larger ones first with so many of their hubs and their first text.
FEW, HUBS = 8, 4
#: Bins of shingles whose counts tell rare ones; equal bins only cost time.
BINS = 1 << 20
#: Words of 64 bins each whose odd counts bound how much two texts differ.
ODD = 8
_CHUNK = 1 << 13
_ORDERS = np.random.default_rng(17).integers(1, 1 << 63, (2, SKETCHES * PICKS), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, n: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """(128-bit digest of the words, sorted distinct hashes of the shingles)."""
    words = text.lower().split()
    whole = b" ".join(words)
    if len(words) > n:
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w), simhash.SEED) for w in zip(*(words[k:] for k in range(n)), strict=False)), np.uint64, len(words) - n + 1)
    else:
        hashes = np.array([xxhash.xxh64_intdigest(whole, simhash.SEED)] if words else [], np.uint64)
    return xxhash.xxh3_128_digest(whole), np.unique(hashes)


def sketches(hashes: np.ndarray) -> np.ndarray:
    """SKETCHES fingerprints, each of the shingles that come first in PICKS orders."""
    first = np.full(SKETCHES * PICKS, np.iinfo(np.uint64).max)
    mul, add = _ORDERS
    for k in range(0, len(hashes), _CHUNK):
        x = (hashes[k : k + _CHUNK, None] ^ add) * mul
        first = np.minimum(first, (x ^ (x >> np.uint64(29))).min(axis=0))
    bits = np.unpackbits(first.view(np.uint8).reshape(SKETCHES, PICKS, 8), axis=2, bitorder="little").sum(axis=1)
    return np.packbits(bits * 2 > PICKS, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _majority(hashes: np.ndarray) -> int:
    """The SimHash of distinct shingles."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, mark, digest, fp, sketch): row is unique, mark is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, prints, parts = [], [], []
            for raw in b.column(2).to_pylist():
                digest, own = shingles(raw)
                digests.append(digest)
                prints.append(_majority(own))
                parts.append(sketches(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
            columns = [b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "digest", "fp", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), common.utf8(text_col).alias("t"))
    found = rows.mapInArrow(run, "id long, mark long, digest binary, fp long, sketch array<long>")
    return common.settle(found.withColumn("row", F.monotonically_increasing_id()), "prints")


def _members(nodes: DataFrame) -> DataFrame:
    """(k, s, node, m, first) of nodes (node, fp, sketch): the m texts that meet at the value s in the k-th way.

    The ways are the sketches, equal fingerprints and, last, the values that links end in. In crowded cells most of these
    are no text's fingerprint; texts that differ in two bits meet there."""
    linked = simhash.links(nodes.select("fp").distinct())
    ends = F.array(*(F.struct(F.col(x).alias("fp"), F.col(y).alias("s")) for x in "ab" for y in "ab"))
    ends = linked.select(F.explode(ends).alias("e")).select("e.*").distinct()
    met = common.settle(ends.join(nodes.select("fp", "node"), "fp").select(F.lit(SKETCHES + 1).alias("k"), "s", "node"), "met")
    keys = nodes.select("node", F.posexplode(F.array_append("sketch", F.col("fp"))).alias("k", "s")).select("k", "s", "node").union(met)
    sizes = keys.groupBy("k", "s").agg(F.count("*").alias("m"), F.min("node").alias("first")).filter("m > 1")
    return common.settle(common.met(keys, sizes, ["k", "s"], "sizes"), "members")


def _candidates(nodes: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(a, b) of nodes (node, fp, sketch) that may be alike: all pairs of small groups, the hubs' pairs of large ones."""
    members = members or _members(nodes)
    few = members.filter(F.col("m") <= FEW).select("k", "s", "node")
    stars = few.join(few.withColumnRenamed("node", "to"), ["k", "s"]).filter(F.col("node") < F.col("to")).select("node", "to")
    weights = members.groupBy("node").agg(F.sum("m").alias("w"))
    many = common.settle(members.filter(F.col("m") > FEW).join(weights, "node").select("k", "s", "node", "first", "w"), "many")
    place = F.row_number().over(Window.partitionBy("k", "s").orderBy(F.desc("w"), "node"))  # Spark cuts each task's rows to HUBS first
    hubs = many.withColumn("place", place).filter(F.col("place") <= HUBS).groupBy("k", "s").agg(F.collect_list("node").alias("hubs"))
    met = common.met(many, hubs, ["k", "s"], "hubs", most=common.MOST_MET // 4).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set(F.array_append("hubs", F.col("first"))))).alias("to"))
    both = stars.union(met.select("node", F.explode("to").alias("to"))).toDF("x", "y").filter("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sets(wanted: DataFrame, docs: DataFrame, prints: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(node, own): the shingles of the wanted nodes, whose texts alone are read again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = pa.array([shingles(x)[1].tobytes() for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), hashes], ["node", "own"])

    marks = prints.join(wanted.withColumnRenamed("node", "row"), "row").select(F.col("row").alias("node"), F.col("id").alias("__mr_id"), F.col("mark").alias("__mr_mark"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), common.utf8(text_col).alias("t"))
    texts = texts.join(marks, texts.id.eqNullSafe(marks.__mr_id) & (texts.mark == marks.__mr_mark)).select("node", "t").dropDuplicates(["node"])
    return common.settle(texts.mapInArrow(sets, "node long, own binary"), "sets")


def _verified(edges: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """The edges whose texts are alike."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            ok = pa.array([similarity(x, y) >= least for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    left = edges.join(own.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    full = left.join(own.select(F.col("node").alias("b"), F.col("own").alias("y")), "b").select("a", "b", "x", "y")
    return full.mapInArrow(alike, "a long, b long")


def _tallied(own: DataFrame) -> np.ndarray:
    """How many of the texts' shingles fall into each of BINS bins; at most BINS rows reach the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            total += np.bincount((np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bin", "n"])

    found = own.select("own").mapInArrow(tally, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS, np.int64)
    out[found["bin"].to_numpy()] = found["n"].to_numpy()
    return out


def _rare_pairs(own: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b) of all texts (node, own) of different roots that can reach a similarity of least.

    In one order of all shingles, rare ones first, two such texts share a shingle among the first of both: of the smaller
    set those up to the overlap that equal sizes need, of the larger one those up to its own share. Places bound the overlap;
    bits that say whether a bin holds an odd number of shingles differ in no more bins than there are unshared shingles."""
    rare, need = _tallied(own), least / (1 + least)
    bits = [f"odd{k}" for k in range(ODD)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for node, root, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(raw, np.uint64)
                n = len(x)
                if not n:
                    continue
                odd = np.packbits(np.bincount((x >> np.uint64(32)).astype(np.int64) % (64 * ODD), minlength=64 * ODD) % 2 == 1, bitorder="little").view(np.int64)
                probe, index = (n - math.ceil(share * n - 1e-9) + 1 for share in (least, 2 * need))
                x = x[np.lexsort((x, rare[(x % np.uint64(BINS)).astype(np.int64)]))[:probe]]
                place = np.arange(len(x))
                parts.append((x.view(np.int64), *(np.full(len(x), v) for v in (node, root, n)), place, place < index, *(np.full(len(x), v) for v in odd)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["shingle", "node", "root", "n", "place", "index", *bits])

    heads = own.join(roots, "node").select("node", "root", "own").mapInArrow(first, ", ".join(["shingle long, node long, root long, n long, place long, index boolean", *(f"{k} long" for k in bits)]))
    heads = common.settle(heads, "heads")
    mixed = heads.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("index").alias("any")).filter("any and low <> high").select("shingle")
    heads = common.settle(heads.join(mixed, "shingle"), "mixed")
    x, y = heads.filter("index").alias("x"), heads.alias("y")
    order = "x.root <> y.root and (x.n < y.n or x.n = y.n and x.node < y.node)"
    overlap = "least(x.place, y.place) + least(x.n - x.place, y.n - y.place)"
    unlike = " + ".join(f"bit_count(x.{k} ^ y.{k})" for k in bits)
    pairs = x.join(y, F.expr(f"x.shingle = y.shingle and {order} and {overlap} >= {need!r}D * (x.n + y.n) - 1e-6D and {unlike} <= {1 - 2 * need!r}D * (x.n + y.n) + 1e-6D"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, exact: bool = False) -> DataFrame:
    """(row, id, mark, component): one row per document; near copies share a component.

    exact: search all texts with the prefix filter, not only the candidate groups that stay in parts. That finds every pair
    of the least similarity, for a shuffle of about a fifth of all shingles."""
    common.bounded(docs.sparkSession)
    prints = _prints(docs, id_col, text_col)
    nodes = prints.groupBy("digest").agg(F.min("row").alias("node"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    nodes = common.settle(nodes, "nodes")
    members = _members(nodes.select("node", "fp", "sketch"))
    edges = common.settle(_candidates(nodes, members), "edges")
    used = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    comp = simhash.components(_verified(edges, _sets(used, docs, prints, text_col, id_col), least))
    if exact:
        pool = common.settle(nodes.select("node").join(comp, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "pool")
    else:  # what the hubs have joined needs no more pairs; large groups that still have parts are searched wholly
        placed = members.filter(F.col("m") > FEW).join(comp, "node", "left").select("k", "s", "node", F.coalesce("root", "node").alias("root"))
        parted = placed.groupBy("k", "s").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("k", "s")
        pool = common.settle(common.met(placed, parted, ["k", "s"], "parted").select("node", "root").distinct(), "pool")
    if not pool.isEmpty():
        own = _sets(pool.select("node"), docs, prints, text_col, id_col)
        more = _verified(common.settle(_rare_pairs(own, pool, least), "rare"), own, least)
        comp = simhash.components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    of = nodes.select("digest", "node").join(comp, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    return common.met(prints.select("row", "id", "mark", "digest"), of, "digest", "of").select("row", "id", "mark", "component")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, exact: bool = False) -> DataFrame:
    """docs with one document of each group, that with the smallest id; all columns."""
    found = common.settle(groups(docs, id_col, text_col, least, exact), "groups")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("mark"))
    marks = found.groupBy("component", "id", "mark").agg(F.count("*").alias("n"))
    first = found.groupBy("component").agg(F.min(order).alias("f"), F.count("*").alias("all")).filter("all > 1")
    in_groups = common.met(marks, first, "component", "first").withColumn("stays", F.col("id").eqNullSafe(F.col("f.id")) & (F.col("mark") == F.col("f.mark")))
    out = common.settle(in_groups.filter("not stays or n > 1").select(F.col("id").alias("__mr_id"), F.col("mark").alias("__mr_mark"), "stays"), "out")
    n = out.agg(F.count("*").alias("all"), F.count_if("stays").alias("again")).first()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__mr_id")) & (F.xxhash64(text_col) == F.col("__mr_mark"))
    left = docs.join(F.broadcast(out) if n["all"] <= common.MOST_KEYS else out, same, "left_anti")
    if n["again"]:  # rows that repeat whole: one of them stays
        kept = docs.join(out.filter("stays"), same, "left_semi").withColumn("__mr_mark", F.xxhash64(text_col))
        left = left.union(kept.dropDuplicates([id_col, "__mr_mark"]).drop("__mr_mark"))
    return left
