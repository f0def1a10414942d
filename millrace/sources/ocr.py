"""Words with places on a page to rows and columns, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far words of a row may lie apart in height, what gap parts columns, and how near boundaries are one.
ROW_GAP, COLUMN_GAP, MERGE = 12.0, 20.0, 30.0


def layout(words: DataFrame, row_gap: float = ROW_GAP, column_gap: float = COLUMN_GAP, merge: float = MERGE) -> DataFrame:
    """(page, line, column, text) of words (page, x, y, width, text). Each page is a group of its own."""
    down = Window.partitionBy("page").orderBy("y", "x")
    rows = words.withColumn("new", F.coalesce((F.col("y") - F.lag("y").over(down) > row_gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("line", F.sum("new").over(down))
    across = Window.partitionBy("page", "line").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(across)
    rows = rows.withColumn("starts", gap.isNull() | (gap > column_gap))
    edges = Window.partitionBy("page").orderBy("x")
    starts = rows.filter("starts").select("page", "x").distinct().withColumn("far", F.coalesce(F.col("x") - F.lag("x").over(edges) > merge, F.lit(True)))
    columns = starts.filter("far").withColumn("column", F.row_number().over(edges) - 1).withColumn("until", F.lead("x").over(edges))
    placed = rows.join(columns.select("page", F.col("x").alias("from"), "until", "column"), "page").filter((F.col("x") >= F.col("from")) & (F.col("until").isNull() | (F.col("x") < F.col("until"))))
    cells = placed.groupBy("page", "line", "column").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("w"))
    return cells.select("page", "line", "column", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"))
