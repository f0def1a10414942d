"""Sharding by extendible hashing, in DataFrame functions only.

A row's key hashes to BITS bits. A bucket is a prefix of them; a bucket whose rows exceed the byte limit splits on the next
bit, and only such buckets do, so a row's shard is the shortest prefix of its hash that fits. Each round sums the bytes of
the cells that are some bits deeper than the buckets known to be too large (a partial sum before the shuffle), adds them up
along the prefixes and finds the splits of all those levels at once; rows of cells that still don't fit go to the next
round. A hot key, whose rows can't be parted by its hash, is split the same way by the hash of a row number, so every shard
fits; only a single row above the limit is a shard of its own.

The directory (cells with their shard) is broadcast if it has at most MOST_CELLS rows (some 250 bytes each in memory, as
measured), else joined by a shuffle of (size, key hash) or, where whole rows are placed, of the rows.

A null key counts as the empty one, a null text as no bytes; rows repeat freely (copies of a hot key may go to any of its
shards); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 60
MAX_BYTES = 1 << 20
MOST_CELLS = 100_000
#: Bits that a round after the first looks ahead, and that the first one does beyond the least number of shards.
STEP, AHEAD = 8, 3


def key_hash(key: str) -> Column:
    """BITS bits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column, have: int, want: Column | int) -> Column:
    """The first want of have bits."""
    return F.call_function("shiftright", bits, (F.lit(have) - want).cast("int"))


def _directory(active: DataFrame, first: int, depth: int, limit: int) -> DataFrame:
    """(g, cell, rows, single, bytes, d, prefix, total) of each cell of depth bits; d is null where no prefix fits.

    Its own joins are shuffled: cells grow with the data."""
    cell = _prefix(F.col("h"), BITS, depth)
    cells = active.groupBy("g", cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), (F.min("h") == F.max("h")).alias("single"))
    cells = common.settle(cells, "cells")
    # a prefix is a shard if it fits and the one before it doesn't: sums only fall with the depth
    deep = F.sequence(F.lit(first), F.lit(depth))
    paths = cells.select("g", "cell", "bytes", F.explode(deep).alias("d")).withColumn("prefix", _prefix(F.col("cell"), depth, F.col("d")))
    totals = common.settle(paths.groupBy("g", "d", "prefix").agg(F.sum("bytes").alias("total")), "totals")
    fits, large = totals.filter(F.col("total") <= limit), totals.filter(F.col("total") > limit).select("g", "d", "prefix")
    before = large.select("g", (F.col("d") + 1).alias("d"), F.col("prefix").alias("half"))
    inner = fits.filter(F.col("d") > first).withColumn("half", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
    inner = inner.join(before.hint("shuffle_hash"), ["g", "d", "half"], "left_semi").select("g", "d", "prefix", "total")
    shards = common.settle(fits.filter(F.col("d") == first).select("g", "d", "prefix", "total").union(inner), "shards")
    depths = sorted(r.d for r in shards.select("d").distinct().collect())  # at most BITS
    own = cells.select("g", "cell", F.explode(F.array(*map(F.lit, depths)).cast("array<int>")).alias("d")).withColumn("prefix", _prefix(F.col("cell"), depth, F.col("d")))
    found = own.join(shards.hint("shuffle_hash"), ["g", "d", "prefix"])
    joined = cells.join(found.hint("shuffle_hash"), ["g", "cell"], "left").select("g", "cell", "rows", "single", "bytes", "d", "prefix", "total")
    alone = F.col("d").isNull() & (F.col("rows") == 1)  # a row above the limit
    own = joined.select("g", "cell", "rows", "single", F.when(alone, F.lit(depth)).otherwise(F.col("d")).alias("d"), F.when(alone, F.col("cell")).otherwise(F.col("prefix")).alias("prefix"), F.when(alone, F.col("bytes")).otherwise(F.col("total")).alias("total"))
    return common.settle(own, "directory")


def _on_cells(rows: DataFrame, cells: DataFrame, small: bool, hot: bool) -> DataFrame:
    """rows met with cells. All rows have one g unless they are of hot keys; a table by one number is several times smaller."""
    cells = cells if hot else cells.drop("g")
    return rows.join(F.broadcast(cells) if small else cells, ["g", "cell"] if hot else "cell")


def _place(active: DataFrame, limit: int, step: int, hot: bool, most: int) -> list[DataFrame]:
    """Parts (row, shard, depth, shard_bytes) of the active rows (row, size, g, h, n); hot: g is a hot key's hash, h a row's."""
    done, base, parts = False, 0, []
    name = F.concat_ws(":", "d", "prefix")
    name = F.concat(F.lit(f"{BITS}:"), F.col("g"), F.lit("/"), name) if hot else name
    while not done:
        depth = min(BITS, base + step)
        directory = _directory(active, base + 1 if base else 0, depth, limit)
        n = directory.agg(F.count("*").alias("all"), F.count_if(F.col("d").isNull()).alias("large"), F.count_if(F.col("d").isNull() & F.col("single")).alias("single")).first()
        small = n["all"] <= most
        rows = active.withColumn("cell", _prefix(F.col("h"), BITS, depth))
        found = _on_cells(rows, directory.filter("d is not null").select("g", "cell", "d", "total"), small, hot)
        found = found.withColumn("prefix", _prefix(F.col("cell"), depth, F.col("d")))
        parts.append(found.select("row", name.alias("shard"), (F.col("d") + (BITS if hot else 0)).alias("depth"), F.col("total").alias("shard_bytes")))
        if n["single"]:
            same = _on_cells(rows, directory.filter("d is null and single").select("g", "cell"), small, hot)
            if hot:  # two row numbers with equal hashes
                parts.append(same.select("row", F.concat(F.lit(f"{BITS}:"), F.col("g"), F.lit("#"), F.col("n")).alias("shard"), F.lit(2 * BITS).alias("depth"), F.col("size").alias("shard_bytes")))
            else:
                again = same.select("row", "size", F.col("h").alias("g"), F.xxhash64("n").bitwiseAND(F.lit((1 << BITS) - 1)).alias("h"), "n")
                parts += _place(common.settle(again, "hot"), limit, STEP, True, most)
        done = n["large"] == n["single"]
        if not done:
            active = common.settle(_on_cells(rows, directory.filter("d is null and not single").select("g", "cell"), small, hot).select("row", "size", "g", "h", "n"), "active")
            base, step = depth, STEP
    return parts


def _rows(docs: DataFrame, row: Column, key: str, text_col: str) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return docs.select(row.alias("row"), size.alias("size"), F.lit(0).cast("long").alias("g"), key_hash(key).alias("h"), F.monotonically_increasing_id().alias("n"))


def _placed(rows: DataFrame, max_bytes: int, most_cells: int) -> DataFrame:
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    step = min(40, AHEAD + ceil(log2(max(1, total / max_bytes))))
    return reduce(DataFrame.union, _place(rows, max_bytes, step, False, most_cells))


def assign(docs: DataFrame, key: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES, id_col: str | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """(id, shard, depth, shard_bytes): the shard of each row; shard is depth:prefix, its rows' texts have shard_bytes bytes."""
    rows = common.settle(_rows(docs, F.struct(F.col(id_col or key).alias("id")), key, text_col), "sizes")
    return _placed(rows, max_bytes, most_cells).select("row.id", "shard", "depth", "shard_bytes")


def place(docs: DataFrame, key: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES, most_cells: int = MOST_CELLS, column: str = "shard") -> DataFrame:
    """docs with their shard in a last column. Whole rows are dealt, without a join on the key, so null and repeated keys
    neither lose nor multiply rows; only those of hot keys and of cells that split again are written on the way."""
    rows = _rows(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), key, text_col)
    return _placed(rows, max_bytes, most_cells).select("row.*", F.col("shard").alias(column))


def write(docs: DataFrame, path: str, key: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES, most_cells: int = MOST_CELLS) -> str:
    """Write docs below path, a folder for each shard, and return the folders' column: shard, or with underscores after it
    where docs have that. A task writes whole shards."""
    column, used = "shard", {c.lower() for c in docs.columns}
    while column in used:
        column += "_"
    placed = place(docs, key, text_col, max_bytes, most_cells, column).withColumn(column, F.regexp_replace(column, "[:/#]", "-"))
    placed.repartition(column).write.partitionBy(column).parquet(path)
    return column


ORACLE_SQL = f"""
    WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents),
    p AS (SELECT doc_id, size, depth, h >> ({BITS} - depth)::INTEGER AS prefix FROM d, (SELECT unnest(range(0, 31)) AS depth)),
    s AS (SELECT *, sum(size) OVER (PARTITION BY depth, prefix) AS total FROM p),
    f AS (SELECT doc_id, arg_min(struct_pack(depth, prefix, total), depth) AS x FROM s WHERE total <= {MAX_BYTES} GROUP BY doc_id)
    SELECT doc_id, x.depth || ':' || x.prefix AS shard, x.depth::INTEGER AS depth, x.total::BIGINT AS shard_bytes FROM f"""
