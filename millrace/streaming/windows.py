"""Streaming forms: windows and calendar buckets behind a watermark, deduplication, running totals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import exprs
from ..operators import align, filters


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files below path, in one of Spark's formats."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def _figures(value: str) -> list:
    return [F.sum(value).alias("total"), F.avg(value).alias("average"), F.count(value).alias("records")]


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """df behind a watermark; times without a zone are the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(df: DataFrame, ts: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, keys, total, average, records): tumbling windows, or sliding ones."""
    grouped = _timed(df, ts, late).groupBy(F.window(ts, width, slide or width).alias("w"), *keys).agg(*_figures(value))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "total", "average", "records")


def sessions(df: DataFrame, ts: str, value: str, gap: str, keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """(start, end, keys, total, average, records) of runs of events with pauses shorter than gap."""
    grouped = _timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*_figures(value))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "total", "average", "records")


def buckets(df: DataFrame, ts: str, value: str, bucket: str = "M", late: str = "1 day") -> DataFrame:
    """Calendar buckets, which are no fixed intervals: keyed by their start, for update or complete mode."""
    unit = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}[bucket]
    grouped = _timed(df, ts, late).groupBy(F.date_trunc(unit, ts).alias("start")).agg(*_figures(value))
    return grouped.select(exprs.period_label(F.col("start"), bucket).alias("period"), "total", "average", "records")


def deduplicate(df: DataFrame, ts: str, columns: list[str], late: str = "10 minutes") -> DataFrame:
    """The first of rows with equal columns that come within the watermark."""
    return _timed(df, ts, late).dropDuplicatesWithinWatermark(columns)


_RUNNING = "n long, total double"


def running(df: DataFrame, keys: tuple[str, ...], ts: str, value: str, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(keys, n, total, closed): a row for each key and trigger that brought rows, with all that it has had so far; a key that
    brings nothing for idle after the watermark ends with closed true and is forgotten. For append and update mode."""
    kinds = dict(df.dtypes)
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), _RUNNING, "closed boolean"])
    names = [*keys, "n", "total", "closed"]
    wait = int(df.sparkSession.sql(f"select unix_millis(timestamp_millis(0) + interval {idle})").first()[0])

    def step(key, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, n, total, True)], columns=names)
            return
        for rows in batches:
            n, total = n + len(rows), total + float(rows[value].sum())
        state.update((n, total))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + wait)
        yield pd.DataFrame([(*key, n, total, False)], columns=names)

    marked = _timed(df.select(*keys, ts, F.col(value).cast("double").alias(value)), ts, late)
    return marked.groupBy(*keys).applyInPandasWithState(step, out, _RUNNING, "update", GroupStateTimeout.EventTimeTimeout)


def aligned(df: DataFrame, spec: align.AlignmentSpec) -> DataFrame:
    """Alignment of a stream: casts, filters and derived columns need no state."""
    return align.align(df, spec).df


def matching(df: DataFrame, rules: list[filters.FilterRule]) -> DataFrame:
    return filters.apply(df, rules)
