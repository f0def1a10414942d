"""Joins: sides are broadcast by their counted size only; ranges, last-before matches and arbitrary conditions become equi-joins
on cells, whose size doesn't follow the hottest key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import dealt

#: Rows up to which a side is broadcast when its size has been counted.
MOST_BROADCAST = 100_000
#: How many ways the rows of a cell are dealt, and the factor between the widths of levels of ranges.
SALTS, STEP = 8, 8


def sized(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def equi(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most: int = MOST_BROADCAST) -> DataFrame:
    """inner, left, right, full, left_semi or left_anti; the right side is broadcast if it is small and that is allowed."""
    return left.join(right if how in ("right", "full") else sized(right, most), on, how)


def theta(left: DataFrame, right: DataFrame, condition: Column | str, most: int = MOST_BROADCAST, cells: int | None = None) -> DataFrame:
    """Every pair of rows for which the condition holds.

    A small right side is broadcast. Else rows are dealt at random to the rows and columns of a grid of cells, each a task's
    work: left rows go to a whole row of it and right ones to a column, so each pair meets once and tasks are alike."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), condition)
    n = math.ceil(math.sqrt(cells or _partitions(left)))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("__row", dealt(left, n)).withColumn("__column", every)
    b = right.withColumn("__column_", dealt(right, n)).withColumn("__row_", every)
    met = (F.col("__row") == F.col("__row_")) & (F.col("__column") == F.col("__column_"))
    return a.join(b, met & condition).drop("__row", "__column", "__row_", "__column_")


def lateral(left: DataFrame, right: DataFrame, on: list[str], order: list[Column], n: int, how: str = "inner") -> DataFrame:
    """For each row of left, the first n rows of right with its keys, in an order; how: inner or left.

    Each task keeps n rows a key before the shuffle, so a hot key costs no more than others."""
    first = right.withColumn("__place", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).filter(F.col("__place") <= n)
    return left.join(first.drop("__place"), on, how)


def in_range(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float | None = None, salts: int = SALTS) -> DataFrame:
    """Rows of left with every row of right whose closed range [low, high] holds the value; null values and null or
    reversed ranges hold nothing.

    Ranges are put into cells, so the join is on cells and both sides may be large. Cells are of the given width (the median
    range's if none is given) for ranges up to that, and STEP times as wide for each further level, so a range takes few
    cells however long it is and a value one a level. The rows of a cell are dealt salts ways; ranges are repeated for each."""
    size = F.col(high).cast("double") - F.col(low).cast("double")
    held = right.filter(size >= 0)
    if width is None:
        width = held.agg(F.percentile_approx(size, 0.5)).first()[0] or 1.0
    level = F.greatest(F.lit(0), F.ceil(F.log(size / width) / math.log(STEP))).cast("int")
    held = held.withColumn("__level", F.when(size > width, level).otherwise(0))
    levels = sorted(r[0] for r in held.select("__level").distinct().collect())  # logarithms of lengths: a few dozen at most
    cell = lambda c: F.floor(F.col(c).cast("double") / (width * F.pow(F.lit(float(STEP)), F.col("__level")))).cast("long")
    held = held.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high)))).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = left.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    placed = placed.withColumn("__cell", cell(value)).withColumn("__salt", dealt(left, salts))
    met = placed.join(held, ["__level", "__cell", "__salt"])
    return met.filter((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("__level", "__cell", "__salt")


def as_of(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str], slices: int | None = None) -> DataFrame:
    """left with the columns of the last row of right at or before it, within the same keys; null without one, and where on is
    null. Of rows of right at one point the one with the largest columns counts.

    Keys are cut into slices of the axis (four a task unless given), so a hot key, or none at all, is many tasks' work; the
    last row of each slice is carried over to later ones by a table of one row a key and slice. No pairs are made."""
    kinds = dict(left.dtypes)
    mine = [c for c in left.columns if c not in (on, *by)]
    axis = F.col(on).cast("timestamp").cast("double") if kinds[on] in ("date", "timestamp_ntz") else F.col(on).cast("double")
    ends = left.agg(F.min(axis).alias("a"), F.max(axis).alias("z")).first()
    slices = slices or 4 * _partitions(left)
    span = (ends.z - ends.a) / slices if ends.a is not None and ends.z > ends.a else 1.0
    place = F.greatest(F.lit(0), F.least(F.lit(slices - 1), F.floor((axis - F.lit(ends.a or 0.0)) / F.lit(span)))).cast("int")
    a = left.select(*by, on, F.lit(1).alias("__side"), F.struct(*(F.col(c) for c in mine)).alias("__left") if mine else F.struct(F.lit(1)).alias("__left"), F.lit(None).alias("__right"))
    b = right.filter(F.col(on).isNotNull()).select(*by, F.col(on).cast(kinds[on]).alias(on), F.lit(0).alias("__side"), F.lit(None).alias("__left"), F.struct(*(F.col(c) for c in columns)).alias("__right"))
    both = a.unionByName(b).withColumn("__slice", place)
    seen = F.last("__right", ignorenulls=True).over(Window.partitionBy(*by, "__slice").orderBy(on, "__side", "__right").rowsBetween(Window.unboundedPreceding, 0))
    newest = F.max(F.when(F.col("__side") == 0, F.struct(on, "__right"))).alias("__newest")
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*by, "__slice").agg(newest).withColumn("__before", F.last("__newest", ignorenulls=True).over(before))
    carried = carried.filter("__before is not null").select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), F.col("__slice").alias("__at"), F.col("__before.__right").alias("__carried"))
    same = F.col("__slice") == F.col("__at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    out = both.withColumn("__seen", seen).filter("__side = 1").join(carried, same, "left")
    found = F.when(F.col(on).isNotNull(), F.coalesce("__seen", "__carried")).alias("__found")
    out = out.select(*by, on, "__left", found)
    return out.select(*by, on, *(F.col(f"__left.{c}").alias(c) for c in mine), *(F.col(f"__found.{c}").alias(c) for c in columns))
