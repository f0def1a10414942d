"""Alignment: select and rename, cast with captured errors, filter, derive - one lazy plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from . import filters

ROW = "_row_index"


@dataclass(frozen=True)
class FieldMapping:
    source_column: str
    target_field: str
    target_type: str | None = None
    keep: bool = True


@dataclass(frozen=True)
class ComputedColumn:
    name: str
    expression: str


@dataclass(frozen=True)
class AlignmentSpec:
    mappings: list[FieldMapping] = field(default_factory=list)
    filters: list[filters.FilterRule] = field(default_factory=list)
    computed: list[ComputedColumn] = field(default_factory=list)


@dataclass
class Aligned:
    """df: the aligned rows. errors: (column, row_index, raw_value, target_type, message) of cells that could not be cast;
    they count before the filters. cast: the rows before the filters."""

    df: DataFrame
    errors: DataFrame
    cast: DataFrame

    def counts(self) -> dict[str, int]:
        """Source, aligned and filtered rows, and errors."""
        source, kept = self.cast.count(), self.df.count()
        return {"total_rows_source": source, "total_rows_aligned": kept, "filtered_out_rows": source - kept, "coercion_errors_count": self.errors.count()}

    def preview(self, n: int = 20) -> list[dict[str, Any]]:
        return preview(self.df, n)


_CASTS = {
    "int": exprs.to_bigint,
    "float": exprs.to_double,
    "currency": exprs.to_double,
    "string": lambda c: c.cast("string"),
    "datetime": exprs.to_timestamp,
    "boolean": exprs.to_boolean,
}


def cast(c: Column, kind: str | None) -> Column:
    """The column as one of the target types; unknown types leave it alone."""
    return _CASTS[kind](c) if kind in _CASTS else c


def visible(df: DataFrame) -> list[str]:
    """Column names without lineage columns."""
    return [c for c in df.columns if not c.startswith("_")]


def show(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, in the table's order, and its lineage columns; unknown names count for nothing."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in columns or c.startswith("_")))


def hide(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table without the named columns; lineage columns stay."""
    return show(df, [c for c in df.columns if c not in columns])


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by row index (without one, as they come). Where indexes have no gaps, a filter on them finds these
    rows without a pass over the table."""
    if ROW not in df.columns:
        return df.limit(n)
    first = df.filter(F.col(ROW) < n)
    return first.orderBy(ROW) if first.count() == n else df.orderBy(ROW).limit(n)


def preview(df: DataFrame, n: int = 20) -> list[dict[str, Any]]:
    """The first rows by row index (else as they come), made safe for JSON."""
    rows = exprs.json_safe(head(df, n).select(*(F.col(f"`{c}`") for c in visible(df)))).collect()
    return [r.asDict() for r in rows]


_EXPRESSION = re.compile(r"\s*([A-Za-z0-9_]+)\s*([*+\-/])\s*([A-Za-z0-9_]+)\s*")


def computed(df: DataFrame, column: ComputedColumn) -> DataFrame:
    """Add 'a op b' of two columns; x/0 is null; other expressions and unknown columns add nothing."""
    m = _EXPRESSION.fullmatch(column.expression)
    if not m or m[1] not in df.columns or m[3] not in df.columns:
        return df
    a, b = exprs.as_number(df, m[1]), exprs.as_number(df, m[3])
    value = {"*": lambda: a * b, "+": lambda: a + b, "-": lambda: a - b, "/": lambda: exprs.safe_divide(a, b)}[m[2]]()
    return df.withColumn(column.name, value)


def align(df: DataFrame, spec: AlignmentSpec) -> Aligned:
    """Mapped columns in mapping order (all columns if no mapping names one); see Aligned."""
    chosen: dict[str, FieldMapping] = {}
    for m in spec.mappings:
        if m.keep and m.source_column in df.columns:
            chosen[m.source_column] = m
    index = F.col(ROW) if ROW in df.columns else F.lit(None).cast("long")
    if chosen:
        out = [cast(F.col(f"`{s}`"), m.target_type).alias(m.target_field) for s, m in chosen.items()]
    else:
        out = [F.col(f"`{c}`") for c in visible(df)]
    typed = df.select(*([F.col(ROW)] if ROW in df.columns else []), *out)
    cells = []
    for s, m in chosen.items():
        if m.target_type in _CASTS and m.target_type != "string":
            raw = F.col(f"`{s}`").cast("string")
            failed = raw.isNotNull() & (raw != "") & cast(F.col(f"`{s}`"), m.target_type).isNull()
            said = F.struct(
                F.lit(m.target_field).alias("column"), index.alias("row_index"), raw.alias("raw_value"), F.lit(m.target_type).alias("target_type"),
                F.concat(F.lit("cannot read "), raw, F.lit(f" as {m.target_type}")).alias("message"),
            )
            cells.append(F.when(failed, said))
    empty = "array<struct<column:string,row_index:bigint,raw_value:string,target_type:string,message:string>>"
    found = F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast(empty)
    errors = df.select(F.explode(found).alias("e")).select("e.*")
    kept = filters.apply(typed, spec.filters, {s: m.target_field for s, m in chosen.items()})
    for c in spec.computed:
        kept = computed(kept, c)
    return Aligned(kept, errors, typed)
