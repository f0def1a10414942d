"""The built-in analyses. Each runs a few aggregates and collects only their bounded results."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators.align import head, visible
from . import aggregates as agg
from .base import Analysis, AnalysisResult, AnalysisValidationError, Chart, Kpi, date_column, growth_pct, metric, money, named, numeric, register, title

# Words by which columns are recognised (fixed values).
REVENUE = ("revenue", "sales", "total_price", "amount", "total")
QUANTITY = ("qty", "quantity", "units")
PRICE = ("unit_price", "price", "rate", "cost")
CATEGORY = ("product", "category", "item", "segment", "region", "department", "channel")
SALES_DATE = ("date", "time", "order_date", "day")
TREND_DATE = ("date", "time", "day", "month", "created", "period")
PERIOD = ("date", "quarter", "month", "year")
BUCKET_NAMES = {"D": "Daily", "W": "Weekly", "M": "Monthly", "Q": "Quarterly", "Y": "Yearly"}


def _not_empty(df: DataFrame, purpose: str) -> None:
    if df.isEmpty():
        raise AnalysisValidationError(f"{purpose} needs rows")


def _series(name: str, data: list[Any], kind: str) -> dict[str, Any]:
    return {"name": name, "data": data, "type": kind}


class Sales(Analysis):
    """Totals, top categories, monthly totals and their growth. options: growth_mode first (default) or previous."""

    name = "sales_analysis"

    def resolve(self, df: DataFrame, options: dict[str, Any]) -> tuple[DataFrame, str, str | None, str | None]:
        """(rows, value column, category, date); a value may be made of quantity and price."""
        known = numeric(df)
        value = next((c for c in options.get("target_columns") or [] if c in known), None) or next(iter(named(known, REVENUE)), None)
        if value is None:
            quantity = named(known, QUANTITY)
            price = [c for c in named(known, PRICE) if c not in quantity]
            if quantity and price:
                value = "calculated_revenue"
                df = df.withColumn(value, F.col(quantity[-1]) * F.col(price[-1]))
        value = value or next(iter(known), None)
        if value is None:
            raise AnalysisValidationError("sales analysis needs a numeric column")
        columns = visible(df)
        given = [c for c in options.get("category_columns") or [] if c in columns]
        category = next(iter([*given, *named(columns, CATEGORY), *(c for c in columns if c != value and not exprs.is_numeric(df, c))]), None)
        return df, value, category, date_column(df, options, SALES_DATE)

    def run(self, df: DataFrame, options: dict[str, Any]) -> AnalysisResult:
        _not_empty(df, "sales analysis")
        df, value, category, date = self.resolve(df, options)
        whole = agg.totals(df, value).first()
        kpis = [
            Kpi(f"Total {title(value)}", round(whole.total, 2), money(value, whole.total), subtext=f"{whole.records:,} records"),
            Kpi(f"Average {title(value)}", round(whole.average or 0.0, 2), money(value, whole.average or 0.0), subtext="per record"),
            Kpi("Total Record Count", whole.records, f"{whole.records:,}", subtext="records read"),
        ]
        findings, charts = [], []
        summary = f"{title(value)} sums to {kpis[0].formatted} over {whole.records:,} records, {kpis[1].formatted} on average."
        if category and (top := agg.segments(df, category, value).limit(10).collect()):
            charts.append(Chart("bar", f"Top {len(top)} {title(category)} by {title(value)}", [str(r[0]) for r in top], [_series(title(value), [round(r.total, 2) for r in top], "bar")], {"horizontal": False}))
            share = top[0].total / whole.total * 100 if whole.total > 0 else 0.0
            kpis.append(Kpi(f"Top {title(category)}", str(top[0][0]), f"{top[0][0]} ({share:.1f}%)", subtext=money(value, top[0].total)))
            findings.append(f"{top[0][0]} leads {category} with {money(value, top[0].total)}, {share:.1f}% of {value}.")
            summary += f" {top[0][0]} leads {category} with {share:.1f}%."
        if date and (months := agg.buckets(df, date, value).collect()):
            totals = [round(r.total, 2) for r in months]
            charts.append(Chart("line", f"{title(value)} by Month", [r.period for r in months], [_series("Monthly Total", totals, "line")]))
            if len(months) > 1:
                at = -2 if options.get("growth_mode") == "previous" else 0
                growth = growth_pct(totals[at], totals[-1])
                kpis.append(Kpi("Period Growth", round(growth, 1), f"{growth:+.1f}%", round(growth, 1), f"{months[at].period} to {months[-1].period}"))
                findings.append(f"{title(value)} changed by {growth:+.1f}% from {months[at].period} to {months[-1].period}.")
        return AnalysisResult(self.name, summary, findings, kpis, charts, head(df, 20).select(*visible(df)), {"revenue_column": value, "category_column": category, "date_column": date, "row_count": whole.records})


class Trend(Analysis):
    """Calendar buckets and their least-squares slope. options: bucket D, W, M (default), Q, Y or auto; moving_average: width."""

    name = "trend_analysis"

    def run(self, df: DataFrame, options: dict[str, Any]) -> AnalysisResult:
        _not_empty(df, "trend analysis")
        date = date_column(df, options, TREND_DATE)
        if date is None:
            raise AnalysisValidationError("trend analysis needs a date column")
        value = metric(df, options, "trend analysis")
        bucket = str(options.get("bucket", "M")).upper()
        ts = exprs.as_timestamp(df, date)
        if bucket == "AUTO":
            span = df.agg(F.date_diff(F.max(ts), F.min(ts))).first()[0] or 0
            bucket = "D" if span <= 14 else "W" if span <= 60 else "M"
        bucket = bucket if bucket in agg.BUCKETS else "M"
        periods = agg.buckets(df, date, value, bucket)
        table = periods.select(F.col("period").alias("Period"), F.col("total").alias(f"Total_{value}"), F.col("average").alias(f"Average_{value}"), F.col("records").alias("Records"))
        if width := options.get("moving_average"):
            moved = agg.moving_average(periods, int(width))
            table = moved.select(F.col("period").alias("Period"), F.col("total").alias(f"Total_{value}"), F.col("average").alias(f"Average_{value}"), F.col("records").alias("Records"), F.col("moving_average").alias("Moving_Average")).orderBy("Period")
        rows = periods.collect()
        if not rows:
            raise AnalysisValidationError(f"no readable dates in column {date!r}")
        s = agg.slope(periods).first()
        name = BUCKET_NAMES[bucket]
        kpis = [
            Kpi("Trend Direction", s.direction, s.direction, subtext=f"{name} slope: {s.slope_pct:+.1f}%/period"),
            Kpi(f"Peak {name} {title(value)}", s.peak, f"{s.peak:,.2f}", subtext=f"in {s.peak_period}"),
            Kpi(f"Lowest {name} {title(value)}", s.trough, f"{s.trough:,.2f}", subtext=f"in {s.trough_period}"),
        ]
        if s.n > 1:
            findings = [f"The {name.lower()} trend is {s.direction}, {s.slope_pct:+.1f}% a period.", f"From {rows[0].period} ({s['first']:,}) to {rows[-1].period} ({s['last']:,}): {s.growth_pct:+.1f}%."]
            summary = f"{title(value)} over {s.n} {name.lower()} periods: {s.direction}, {s.growth_pct:+.1f}% in all."
        else:
            findings = ["One period has no slope."]
            summary = f"All dates fall into one {name.lower()} period, {rows[0].period}."
        lines = [_series(f"Total {title(value)}", [round(r.total, 2) for r in rows], "line"), _series(f"Average {title(value)}", [None if r.average is None else round(r.average, 2) for r in rows], "line")]
        charts = [Chart("line", f"{name} Trend: {title(value)}", [r.period for r in rows], lines)]
        return AnalysisResult(self.name, summary, findings, kpis, charts, table, {"date_column": date, "metric_column": value, "bucket": bucket, "slope_pct": s.slope_pct, "growth_pct": s.growth_pct, "period_count": s.n})


class Comparison(Analysis):
    """Segments by total. comparison_type: category_comparison, period_over_period (by option bucket) or before_after (option split)."""

    name = "comparison"

    def run(self, df: DataFrame, options: dict[str, Any]) -> AnalysisResult:
        _not_empty(df, "comparison")
        value = metric(df, options, "comparison")
        kind = (options.get("comparison_type") or "category_comparison").lower()
        columns = [c for c in visible(df) if c != value]
        segment = None
        if kind == "before_after":
            date = date_column(df, options, PERIOD)
            if date is None or not options.get("split"):
                raise AnalysisValidationError("before_after needs a date column and the option split")
            segment, ts = "phase", exprs.as_timestamp(df, date)
            df = df.filter(ts.isNotNull()).withColumn(segment, F.when(ts < exprs.to_timestamp(F.lit(str(options["split"]))), "before").otherwise("after"))
        elif kind == "period_over_period" and (date := next((c for c in columns if exprs.is_temporal(df, c) or named([c], PERIOD)), None)):
            segment = date
            if exprs.is_temporal(df, date):
                df = df.withColumn(date, exprs.period_label(F.col(date), str(options.get("bucket", "M")).upper()))
        given = [c for c in options.get("category_columns") or [] if c in columns]
        segment = segment or next(iter([*given, *(c for c in columns if not exprs.is_numeric(df, c)), *columns]), None)
        if segment is None:
            raise AnalysisValidationError("comparison needs a column to compare by")
        top = agg.segments(df, segment, value)
        best = agg.leader(df, segment, value).first()
        if best.leader is None:
            raise AnalysisValidationError(f"column {segment!r} has no segments")
        kpis = [Kpi(f"Top Segment ({title(segment)})", str(best.leader), f"{best.leader} (${best.leader_total:,.2f})", subtext=f"{best.share_pct:.1f}% of the whole")]
        findings = [f"{best.leader} is the largest {segment}: {best.leader_total:,.2f}, {best.share_pct:.1f}% of {value}."]
        if best.variance is not None:
            kpis.append(Kpi("Leader vs Runner-up", round(best.variance, 2), f"{best.variance:+,.2f} ({best.variance_pct:+.1f}%)", round(best.variance_pct, 1), f"{best.leader} against {best.runner_up}"))
            findings.append(f"It exceeds {best.runner_up} by {best.variance:,.2f} ({best.variance_pct:+.1f}%).")
        shown = top.limit(10).collect()
        bars = [_series(f"Total {title(value)}", [round(r.total, 2) for r in shown], "bar"), _series(f"Average {title(value)}", [None if r.average is None else round(r.average, 2) for r in shown], "bar")]
        charts = [Chart("bar", f"{title(value)} by {title(segment)}", [str(r[0]) for r in shown], bars)]
        table = top.select(F.col(segment), F.col("total").alias(f"Total_{value}"), F.col("average").alias(f"Average_{value}"), F.col("records").alias("Records"))
        return AnalysisResult(self.name, f"{best.leader} leads {segment} by {value} with {best.leader_total:,.2f}.", findings, kpis, charts, table, {"metric_column": value, "segment_column": segment, "leader": str(best.leader), "comparison_type": kind})


class SummaryStats(Analysis):
    """Descriptive statistics of all numeric columns in one pass. options: include_quartiles, exact (default)."""

    name = "summary_stats"

    def run(self, df: DataFrame, options: dict[str, Any]) -> AnalysisResult:
        _not_empty(df, "summary statistics")
        known = numeric(df)
        columns = [c for c in options.get("target_columns") or [] if c in known] or known
        if not columns:
            raise AnalysisValidationError("summary statistics need a numeric column")
        stats = agg.statistics(df, columns, bool(options.get("exact", True)))
        rows = stats.collect()  # one row a column
        s = rows[0]
        if not s["count"]:
            raise AnalysisValidationError(f"column {s.column!r} has only nulls")
        shape = "Symmetric" if abs(s.skew) < 0.5 else "Right-skewed (positive)" if s.skew > 0 else "Left-skewed (negative)"
        kpis = [
            Kpi(f"Mean ({s.column})", round(s.mean, 2), f"{s.mean:,.2f}", subtext=f"Median: {s.median:,.2f}"),
            Kpi("Std Deviation", round(s.std, 2), f"±{s.std:,.2f}", subtext=f"{s['count']:,} values"),
            Kpi("Min / Max Range", round(s.max - s.min, 2), f"[{s.min:,.2f} – {s.max:,.2f}]", subtext=f"IQR: {s.iqr:,.2f} (Q1={s.q1:,.2f}, Q3={s.q3:,.2f})"),
            Kpi("Distribution Shape", shape, shape, subtext=f"Skewness: {s.skew:+.2f}"),
        ]
        charts = []
        if s["count"] >= 4:
            bins = agg.histogram(df, s.column).collect()
            charts.append(Chart("bar", f"Distribution of {s.column}", [f"{b.low:.1f}-{b.high:.1f}" for b in bins], [_series("Count", [b.records for b in bins], "bar")]))
        names = {"column": "Column", "count": "Count", "mean": "Mean", "median": "Median", "std": "StdDev", "min": "Min", "max": "Max"} | ({"q1": "Q1", "q3": "Q3"} if options.get("include_quartiles") else {})
        table = stats.select(*(F.col(k).alias(v) if k in ("column", "count") else F.round(k, 2).alias(v) for k, v in names.items()))
        summary = f"{s.column}: mean {s.mean:,.2f}, median {s.median:,.2f}, standard deviation {s.std:,.2f}; {len(columns)} column(s) described."
        findings = [f"{len(columns)} numeric column(s).", f"{s.column} runs from {s.min:,.2f} to {s.max:,.2f} and is {shape.lower()}."]
        return AnalysisResult(self.name, summary, findings, kpis, charts, table, {"target_columns": columns, "primary_column": s.column, "skewness": round(s.skew, 3)})


class Outliers(Analysis):
    """Rows beyond fences. options: method iqr (default; multiplier 1.5) or zscore (z_threshold 2.5); exact (default) quantiles."""

    name = "outlier_detection"

    def run(self, df: DataFrame, options: dict[str, Any]) -> AnalysisResult:
        _not_empty(df, "outlier detection")
        column = metric(df, options, "outlier detection")
        method = "zscore" if str(options.get("method", "iqr")).lower() == "zscore" else "iqr"
        how = {"method": method, "multiplier": float(options.get("multiplier", 1.5)), "z": float(options.get("z_threshold", 2.5)), "exact": bool(options.get("exact", True))}
        s = agg.outlier_summary(df, column, **how).first()
        if s.valid < 4:
            raise AnalysisValidationError(f"outlier detection needs at least 4 values in column {column!r}, which has {s.valid}")
        normal = s.rows - s.outliers
        kpis = [
            Kpi("Outliers Detected", s.outliers, f"{s.outliers} records ({s.outlier_pct:.1f}%)", subtext=f"{method.upper()}: [{s.low:,.2f} – {s.high:,.2f}]"),
            Kpi("Normal Records", normal, f"{normal:,} records", subtext=f"{100 - s.outlier_pct:.1f}% within bounds"),
            Kpi("Normal Expected Range", round(s.high - s.low, 2), f"[{s.low:,.2f} to {s.high:,.2f}]", subtext=None),
        ]
        findings = [f"{method.upper()} test of {column} over {s.rows:,} rows: {s.outliers} beyond [{s.low:,.2f}, {s.high:,.2f}]."]
        if s.outliers:
            findings.append(f"The most extreme value is {s.extreme:,.2f}.")
        charts = [Chart("pie", f"Outliers of {column}", ["Normal Records", "Flagged Outliers"], [_series("Record Count", [normal, s.outliers], "pie")])]
        flagged = agg.flag_outliers(df, column, **how).filter("_is_outlier")
        table = head(flagged, 25).select(*visible(df), "_is_outlier")
        summary = f"{s.outliers or 'No'} outlier(s) in {column} by {method.upper()}; the normal range is [{s.low:,.2f}, {s.high:,.2f}]."
        return AnalysisResult(self.name, summary, findings, kpis, charts, table, {"target_column": column, "method": method, "lower_bound": round(s.low, 4), "upper_bound": round(s.high, 4), "outlier_count": s.outliers, "outlier_pct": s.outlier_pct})


class CustomAggregation(Analysis):
    """Any keys and functions. options: measures {column: [functions]} (default: sum of the targets), sets group, rollup or cube."""

    name = "custom_aggregation"

    def run(self, df: DataFrame, options: dict[str, Any]) -> AnalysisResult:
        keys = [c for c in options.get("category_columns") or [] if c in df.columns]
        measures = options.get("measures") or {c: ["sum"] for c in options.get("target_columns") or [] if c in numeric(df)}
        if not keys or not measures:
            raise AnalysisValidationError("custom aggregation needs category columns and measures")
        table = agg.custom(df, keys, measures, options.get("sets", "group"))
        return AnalysisResult(self.name, f"{', '.join(table.columns[len(keys):])} by {', '.join(keys)}.", table=table, metadata={"keys": keys, "measures": measures})


def register_all() -> None:
    for kind in (Sales, Trend, Comparison, SummaryStats, Outliers, CustomAggregation):
        register(kind())


register_all()
