"""Functions of the user's own, by name: for expressions, for aggregates and as tables, in DataFrames and in SQL alike.

Scalars and aggregates work on Arrow batches (pandas Series), never row by row."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

_KINDS: dict[str, str] = {}
_MADE: dict[str, Any] = {}


def _add(name: str, kind: str, made: Any) -> None:
    if not name.isidentifier():
        raise ValueError(f"not a name: {name!r}")
    _KINDS[name], _MADE[name] = kind, made


def _pandas(f: Callable, returns: str, kind: int) -> Any:
    """The kind says what type hints would, so any callable will do."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        return F.pandas_udf(f, returnType=returns, functionType=kind)


def register_scalar(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """f takes Series, one an argument, and gives a Series as long; null is NaN or None there."""
    made = _pandas(f, returns, PandasUDFType.SCALAR)
    _add(name, "scalar", made)
    spark.udf.register(name, made)


def register_aggregate(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """f takes the Series of one group and gives a value. A group must fit a worker: for groups of any size use built-in
    functions or merge() of partial results. Spark doesn't mix these with built-in aggregates in one query."""
    made = _pandas(f, returns, PandasUDFType.GROUPED_AGG)
    _add(name, "aggregate", made)
    spark.udf.register(name, made)


def register_table(spark: SparkSession, name: str, f: Callable[..., Iterable[tuple]], returns: str) -> None:
    """f takes the values of a row and gives any number of rows."""

    class Rows:
        def eval(self, *args: Any) -> Iterable[tuple]:
            yield from f(*args)

    made = F.udtf(Rows, returnType=returns)
    _add(name, "table", made)
    spark.udtf.register(name, made)


def names(kind: str | None = None) -> list[str]:
    return sorted(n for n, k in _KINDS.items() if kind in (None, k))


def call(name: str, *columns: Column | str) -> Column:
    """A registered scalar or aggregate as a column."""
    if _KINDS.get(name) not in ("scalar", "aggregate"):
        raise KeyError(name)
    return _MADE[name](*columns)


def explode(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """df with the rows that a registered table function gives for each of its rows."""
    if _KINDS.get(name) != "table":
        raise KeyError(name)
    return df.lateralJoin(_MADE[name](*(F.col(c).outer() for c in columns)))


def merge(df: DataFrame, keys: list[str], partial: Callable, merge_: Callable, schema: str) -> DataFrame:
    """An aggregate of the user's own over groups of any size: partial() makes one pandas frame of schema (the keys and any
    state) out of each batch of rows, merge_() one frame out of two or more of the same key; both keep the keys' columns.

    Batches are made small before the shuffle; a key's states are merged in rounds, so no task holds the rows of a hot key."""
    made = df.mapInPandas(lambda batches: (partial(b) for b in batches if len(b)), schema)
    salted = made.withColumn("__turn", F.pmod(F.spark_partition_id(), F.lit(16)))
    inner = salted.groupBy(*keys, "__turn").applyInPandas(lambda g: merge_(g.drop(columns="__turn")), schema)
    return inner.groupBy(*keys).applyInPandas(merge_, schema)
