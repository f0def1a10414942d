"""Layouts: rules from profiles to chart specifications, and the rows that charts show."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import periods
from ..operators.align import ROW
from ..operators.profile import TableProfile

#: How many series, rows and metrics a chart takes.
SERIES, CATEGORIES, METRICS = 8, 24, 6


@dataclass(frozen=True)
class ChartSpec:
    chart_id: str
    chart_type: str
    title: str
    table: str | None = None
    x_col: str | None = None
    y_cols: tuple[str, ...] = ()
    row_filter: str = "all"


@dataclass
class LayoutPlan:
    charts: list[ChartSpec]
    drilldown_tables: list[str] = field(default_factory=list)
    highlight_mismatches: bool = False
    highlight_anomalies: bool = False


def plan(profiles: list[TableProfile]) -> LayoutPlan:
    """A KPI strip; a line for time columns, else bars for measures; panels for findings; a drilldown of every table."""
    out = LayoutPlan([ChartSpec("kpi_strip", "kpi", "Summary")])

    def add(kind: str, title: str, p: TableProfile, **more) -> None:
        out.charts.append(ChartSpec(f"chart_{len(out.charts) - 1}_{kind}", kind, f"{p.name}: {title}", p.name, **more))

    for p in profiles:
        measures = [c.header for c in p.of_type("numeric", "currency") if not c.is_computed]
        times = [c.header for c in p.of_type("time_period") if not c.is_computed]
        x = next((c.header for c in [*p.of_type("category", "identifier"), *p.columns]), None)
        if p.time and times:
            add("line", "over time", p, x_col=x, y_cols=tuple(times), row_filter="detail")
        elif not p.time and len(measures) == 1:
            add("bar_horizontal", measures[0], p, x_col=x, y_cols=(measures[0],), row_filter="detail")
        elif not p.time and measures:
            add("grouped_bar", "measures", p, x_col=x, y_cols=tuple(measures[:METRICS]), row_filter="detail")
        out.drilldown_tables.append(p.name)
        if not p.mismatches.isEmpty():
            out.highlight_mismatches = True
            add("mismatch", "computed columns that differ", p)
        if not p.anomalies.isEmpty():
            out.highlight_anomalies = True
            add("anomaly", "anomalies", p)
    return out


def _rows(p: TableProfile, spec: ChartSpec) -> DataFrame:
    kept = {"detail": ["detail"], "subtotal": ["subtotal", "grand_total"]}.get(spec.row_filter)
    rows = p.rows.filter(F.col("_row_role").isin(*kept)) if kept else p.rows
    return rows.orderBy(ROW)


def line_data(p: TableProfile, spec: ChartSpec) -> DataFrame:
    """(series, period, value) of the first rows, one series a row."""
    head = _rows(p, spec).limit(SERIES).select(ROW, F.col(f"`{spec.x_col}`").cast("string").alias("series"), *(exprs.cell_number(F.col(f"`{c}`")).alias(c) for c in spec.y_cols))
    chosen = periods.TimeStructure(p.time.kind, p.time.start, p.time.end, {c: x for c, x in p.time.columns.items() if c in spec.y_cols})
    return periods.to_long(head, chosen, [ROW, "series"]).orderBy(ROW, "period").drop(ROW)


def bar_data(p: TableProfile, spec: ChartSpec) -> DataFrame:
    """(label, metrics) of the first rows."""
    return _rows(p, spec).limit(CATEGORIES).select(F.col(f"`{spec.x_col}`").cast("string").alias("label"), *(exprs.cell_number(F.col(f"`{c}`")).alias(c) for c in spec.y_cols))


def kpis(profiles: list[TableProfile]) -> dict[str, int]:
    return {"tables": len(profiles), "rows": sum(p.total_rows for p in profiles), "columns": sum(len(p.columns) for p in profiles), "period_columns": sum(len(p.time.columns) for p in profiles)}
