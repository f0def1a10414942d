"""Analyses: a strategy resolves columns from a schema, declares aggregates, and renders what they return."""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..functions import exprs
from ..operators.align import visible


class AnalysisValidationError(ValueError):
    """The request doesn't fit the data."""


@dataclass(frozen=True)
class Kpi:
    label: str
    value: Any
    formatted: str
    change_pct: float | None = None
    subtext: str | None = None


@dataclass(frozen=True)
class Chart:
    chart_type: str
    title: str
    labels: list[str]
    series: list[dict[str, Any]]
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class AnalysisResult:
    """table: the relational part, still a DataFrame; the rest is small and already computed."""

    analysis_type: str
    summary: str
    detailed_findings: list[str] = field(default_factory=list)
    kpis: list[Kpi] = field(default_factory=list)
    charts: list[Chart] = field(default_factory=list)
    table: DataFrame | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    result_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def to_dict(self, rows: int | None = None) -> dict[str, Any]:
        """For JSON; the table as at most so many records (None: all)."""
        out = {k: getattr(self, k) for k in ("result_id", "analysis_type", "summary", "detailed_findings", "metadata")}
        out |= {"kpis": [asdict(k) for k in self.kpis], "charts": [asdict(c) for c in self.charts]}
        table = self.table if self.table is None or rows is None else self.table.limit(rows)
        out["table_columns"] = None if table is None else table.columns
        out["table_data"] = None if table is None else [r.asDict() for r in exprs.json_safe(table).toLocalIterator()]
        return out


@dataclass(frozen=True)
class AnalysisRequest:
    analysis_type: str
    comparison_type: str | None = None
    target_columns: list[str] = field(default_factory=list)
    category_columns: list[str] = field(default_factory=list)
    date_column: str | None = None
    options: dict[str, Any] = field(default_factory=dict)


class Analysis(ABC):
    name: str

    @abstractmethod
    def run(self, df: DataFrame, options: dict[str, Any]) -> AnalysisResult:
        """options holds the request's fields too."""

    def analyze(self, df: DataFrame, request: AnalysisRequest) -> AnalysisResult:
        fields = {k: getattr(request, k) for k in ("comparison_type", "target_columns", "category_columns", "date_column")}
        return self.run(df, fields | request.options)


_REGISTRY: dict[str, Analysis] = {}


def register(strategy: Analysis) -> Analysis:
    _REGISTRY[strategy.name] = strategy
    return strategy


def get(name: str) -> Analysis:
    if name not in _REGISTRY:
        raise KeyError(f"unknown analysis {name!r}; known: {', '.join(names())}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def clear() -> None:
    _REGISTRY.clear()


# Column resolution: decided on the driver from the schema alone.


def numeric(df: DataFrame) -> list[str]:
    return [c for c in visible(df) if exprs.is_numeric(df, c)]


def named(columns: Iterable[str], words: Iterable[str]) -> list[str]:
    """The columns whose name holds one of the words."""
    return [c for c in columns if any(w in c.lower() for w in words)]


def metric(df: DataFrame, options: dict[str, Any], purpose: str) -> str:
    """The first numeric target, or else the first numeric column."""
    known = numeric(df)
    for c in [*(options.get("target_columns") or []), *known]:
        if c in known:
            return c
    raise AnalysisValidationError(f"{purpose} needs a numeric column")


def date_column(df: DataFrame, options: dict[str, Any], words: Iterable[str]) -> str | None:
    """The named date column, or else the first that is temporal or is called so."""
    if (c := options.get("date_column")) and c in df.columns:
        return c
    return next((c for c in visible(df) if exprs.is_temporal(df, c) or named([c], words)), None)


def title(name: str) -> str:
    return name.replace("_", " ").title()


def money(name: str, value: float) -> str:
    sign = "$" if any(w in name for w in ("price", "rev", "sales")) else ""
    return f"{sign}{value:,.2f}"


def growth_pct(first: float, last: float) -> float:
    """Change in percent; 0 unless the first value is positive."""
    return (last - first) / first * 100 if first > 0 else 0.0
