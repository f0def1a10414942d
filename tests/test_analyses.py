from __future__ import annotations

import datetime as dt

import pytest

from millrace.operators.align import AlignmentSpec, ComputedColumn, FieldMapping, align
from millrace.operators.filters import FilterRule
from millrace.plans import aggregates as agg
from millrace.plans import analyses, base
from millrace.plans.base import AnalysisRequest, AnalysisResult, AnalysisValidationError

ROWS = """2026-01-05,Laptop Pro,10,$1200.00,West|2026-01-12,Wireless Mouse,50,$25.50,West|2026-02-02,Monitor 4K,12,$350.00,West|2026-02-10,Laptop Pro,3,$1200.00,East|2026-03-09,Mechanical Keyboard,20,$85.00,West|2026-03-11,USB-C Hub,30,$45.00,South|2026-04-01,Laptop Pro,11,$1200.00,West|bad,Monitor 4K,x,$350.00,West"""


@pytest.fixture(scope="module")
def sales(spark):
    raw = spark.createDataFrame([(k, *r.split(",")) for k, r in enumerate(ROWS.split("|"))], "_row_index long, `Order Date` string, Product string, Qty string, `Unit Price` string, Region string")
    spec = AlignmentSpec(
        [FieldMapping("Order Date", "date", "datetime"), FieldMapping("Product", "product", "string"), FieldMapping("Qty", "quantity", "int"), FieldMapping("Unit Price", "unit_price", "float"), FieldMapping("Region", "region", "string")],
        [FilterRule("region", "equals", "west")],
        [ComputedColumn("revenue", "quantity * unit_price")],
    )
    return align(raw, spec).df.cache()


def run(df, kind, **fields) -> AnalysisResult:
    return base.get(kind).analyze(df, AnalysisRequest(kind, **fields))


def test_sales(sales):
    r = run(sales, "sales_analysis", category_columns=["product"])
    assert r.metadata == {"revenue_column": "revenue", "category_column": "product", "date_column": "date", "row_count": 6}
    assert r.kpis[0].value == 12000 + 1275 + 4200 + 1700 + 13200 and r.kpis[3].value == "Laptop Pro"
    assert r.charts[0].labels[0] == "Laptop Pro" and r.charts[1].labels == ["2026-01", "2026-02", "2026-03", "2026-04"]
    assert r.kpis[4].value == round((13200 - 13275) / 13275 * 100, 1)
    assert run(sales, "sales_analysis", options={"growth_mode": "previous"}).kpis[4].value == round((13200 - 1700) / 1700 * 100, 1)
    assert len(r.to_dict()["table_data"]) == 6
    made = run(sales.drop("revenue"), "sales_analysis")
    assert made.metadata["revenue_column"] == "calculated_revenue" and made.kpis[0].value == r.kpis[0].value


def test_trend(sales, spark):
    r = run(sales, "trend_analysis", target_columns=["revenue"], options={"moving_average": 2})
    assert r.metadata["period_count"] == 4 and r.charts[0].series[0]["data"] == [13275.0, 4200.0, 1700.0, 13200.0]
    assert r.kpis[1].value == 13275.0 and r.kpis[2].value == 1700.0
    assert [x["Moving_Average"] for x in r.to_dict()["table_data"]] == [13275.0, 8737.5, 2950.0, 7450.0]
    labels = {b: run(sales, "trend_analysis", target_columns=["revenue"], options={"bucket": b}).charts[0].labels[0] for b in ("D", "W", "Q", "Y", "zz")}
    assert labels == {"D": "2026-01-05", "W": "2026-01-05/2026-01-11", "Q": "2026Q1", "Y": "2026", "zz": "2026-01"}
    up = spark.createDataFrame([(dt.datetime(2026, m, 1), 100.0 * m) for m in range(1, 7)], "day timestamp, v double")
    assert run(up, "trend_analysis").kpis[0].value == "Upward / Growth"
    assert run(up.filter("v = 100"), "trend_analysis").kpis[0].value == "Neutral / Stable"


def test_comparison(sales):
    r = run(sales, "comparison", target_columns=["revenue"], category_columns=["product"])
    assert r.metadata["leader"] == "Laptop Pro" and r.kpis[1].value == 25200 - 4200
    r = run(sales, "comparison", comparison_type="period_over_period", target_columns=["revenue"])
    assert r.metadata["segment_column"] == "date" and "2026-01" in r.charts[0].labels
    r = run(sales, "comparison", comparison_type="before_after", target_columns=["revenue"], options={"split": "2026-02-15"})
    assert {x["phase"]: x["Total_revenue"] for x in r.to_dict()["table_data"]} == {"before": 17475.0, "after": 14900.0}


def test_summary_and_histogram(spark):
    df = spark.createDataFrame([(float(x), "t", True) for x in (1, 2, 3, 4, 100)] + [(None, "u", False)], "v double, s string, b boolean")
    r = run(df, "summary_stats", options={"include_quartiles": True})
    assert r.metadata["target_columns"] == ["v"] and r.metadata["skewness"] == 2.232
    assert r.to_dict()["table_data"] == [{"Column": "v", "Count": 5, "Mean": 22.0, "Median": 3.0, "StdDev": 43.62, "Min": 1.0, "Max": 100.0, "Q1": 2.0, "Q3": 4.0}]
    assert r.charts[0].series[0]["data"] == [4, 0, 0, 0, 1] and r.kpis[3].value == "Right-skewed (positive)"
    flat = spark.createDataFrame([(5.0,)] * 12, "v double")
    assert [b.records for b in agg.histogram(flat, "v").collect()] == [0, 0, 0, 0, 0, 12, 0, 0, 0, 0]
    assert run(flat, "summary_stats").metadata["skewness"] == 0


def test_outliers(spark):
    df = spark.createDataFrame([(x,) for x in (10.0, 10.2, 9.8, 10.1, 10.5, 9.9, 10.3, 500.0, 10.0, -100.0)], "response_time double")
    r = run(df, "outlier_detection")
    assert r.metadata["outlier_count"] == 2 and (r.metadata["lower_bound"], r.metadata["upper_bound"]) == (9.4, 10.8)
    assert run(df, "outlier_detection", options={"method": "zscore", "z_threshold": 2.0}).metadata["outlier_count"] == 1
    assert run(spark.createDataFrame([(1.0,)] * 5, "v double"), "outlier_detection", options={"method": "zscore"}).metadata["outlier_count"] == 0
    assert run(df, "outlier_detection", options={"exact": False}).metadata["outlier_count"] == 2
    assert {x["response_time"] for x in r.to_dict()["table_data"]} == {500.0, -100.0}


def test_validation(spark):
    text = spark.createDataFrame([("a", "b")], "name string, city string")
    for kind in ("sales_analysis", "trend_analysis", "comparison", "summary_stats", "outlier_detection", "custom_aggregation"):
        with pytest.raises(AnalysisValidationError):
            run(text, kind)
        with pytest.raises(AnalysisValidationError):
            run(text.filter("false"), kind)
    with pytest.raises(AnalysisValidationError, match="date"):
        run(spark.createDataFrame([(1, "x")], "value int, label string"), "trend_analysis")
    with pytest.raises(AnalysisValidationError, match="at least 4"):
        run(spark.createDataFrame([(1.0,), (2.0,)], "val double"), "outlier_detection")
    with pytest.raises(KeyError):
        base.get("nope")


def test_custom_and_plug_in(sales):
    r = run(sales, "custom_aggregation", category_columns=["product", "region"], options={"measures": {"revenue": ["sum", "max"], "product": ["distinct"]}, "sets": "rollup"})
    rows = r.to_dict()["table_data"]
    assert len(rows) == 4 + 4 + 1 and next(x for x in rows if x["product"] is None)["distinct_product"] == 4

    class Count(base.Analysis):
        name = "count_rows"

        def run(self, df, options):
            return AnalysisResult(self.name, str(df.count()))

    base.register(Count())
    assert run(sales, "count_rows").summary == "6" and "count_rows" in base.names()
    base.clear()
    analyses.register_all()
    assert base.names() == ["comparison", "custom_aggregation", "outlier_detection", "sales_analysis", "summary_stats", "trend_analysis"]


def test_interactive_group_by(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), (None, "5"), ("b", None)], "k string, v string")
    assert {r.k: r.value for r in agg.group_by(df, "k", "v").collect()} == {"a": 1.0, "—": 5.0, "b": 0.0}
    assert {r.k: r.value for r in agg.group_by(df, "k", "v", "count").collect()} == {"a": 1.0, "—": 1.0, "b": 0.0}
