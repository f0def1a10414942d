"""Row order: a gapless index, previews, pages, search, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from .align import ROW, visible

_LOW = (1 << 33) - 1


def dealt(df: DataFrame, n: int) -> Column:
    """A number below n for each row, to spread the rows of a key. It depends on the row and its task only, so a task that runs
    again after a loss deals its rows alike, whatever order they come in."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.lit(n)).cast("int")


def with_row_index(df: DataFrame) -> DataFrame:
    """df with _row_index 0, 1, 2 ... in its order: partition offsets (one number each) are summed on the driver
    and broadcast, rows stay put."""
    if ROW in df.columns:
        return df
    marked = df.withColumn("_mark", F.monotonically_increasing_id())
    counts = marked.groupBy(F.shiftright("_mark", 33).alias("_part")).agg(F.count("*").alias("n")).collect()
    offset, offsets = 0, []
    for r in sorted(counts):
        offsets.append((r._part, offset))
        offset += r.n
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _start long")  # one row a partition
    joined = marked.withColumn("_part", F.shiftright("_mark", 33)).join(F.broadcast(starts), "_part")
    index = F.col("_start") + F.col("_mark").bitwiseAND(F.lit(_LOW))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), index.alias(ROW))


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows that are null throughout and columns that are; names made clean."""
    names = visible(df)
    df = df.na.drop("all", subset=names) if names else df
    counts = df.agg(*(F.count(f"`{c}`").alias(c) for c in names)).first() if names else {}
    kept = [c for c in names if counts[c]]
    lineage = [c for c in df.columns if c not in names]
    return df.select(*lineage, *(F.col(f"`{c}`").alias(n) for c, n in zip(kept, exprs.sanitize_names(kept), strict=True)))


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows of which any cell's text holds the query, case aside."""
    hits = [F.coalesce(F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(query.lower())), F.lit(False)) for c in visible(df)]
    return df.filter(reduce(Column.__or__, hits)) if query and hits else df


def sort_rows(df: DataFrame, column: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    """By numbers where cells are numbers, then by text; null counts as empty text; ties by another column."""
    c = F.col(f"`{column}`")
    keys = [c] if exprs.is_numeric(df, column) else [exprs.cell_number(c), F.lower(F.coalesce(c.cast("string"), F.lit("")))]
    keys = [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]
    return df.orderBy(*keys, *([tie] if tie else []))


def page(df: DataFrame, number: int, size: int = 25) -> DataFrame:
    """One page of an ordered DataFrame, from 0."""
    return df.offset(number * size).limit(size)


def union(tables: dict[str, DataFrame], source: str = "_source_table") -> DataFrame:
    """All rows with the name of their table; columns by name, missing ones null, of unequal types as text."""
    kinds: dict[str, set[str]] = {}
    for df in tables.values():
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    made = []
    for name, df in tables.items():
        out = [F.col(f"`{c}`").cast("string").alias(c) if len(kinds[c]) > 1 else F.col(f"`{c}`") for c in df.columns]
        made.append(df.select(F.lit(name).alias(source), *out))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def _aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """b with the columns of a, by name."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"the tables have different columns: {sorted(set(a.columns) ^ set(b.columns))}")
    return b.select(*(F.col(f"`{c}`") for c in a.columns))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """The different rows of both, columns by name; nulls are equal to each other, as in the other set operations."""
    return a.union(_aligned(a, b)).distinct()


def intersect(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """The rows of a that b has too: each once, or (every) as often as both have it."""
    return a.intersectAll(_aligned(a, b)) if every else a.intersect(_aligned(a, b))


def difference(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """The rows of a that b lacks: each once, or (every) as often as a has it more often than b."""
    return a.exceptAll(_aligned(a, b)) if every else a.subtract(_aligned(a, b))
