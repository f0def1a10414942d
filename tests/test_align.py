from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import exprs
from millrace.operators.align import AlignmentSpec, ComputedColumn, FieldMapping, align
from millrace.operators.filters import FilterRule, apply


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("$1,200.50", 1200.5), ("12%", 12.0), ("abc", None), ("nan", None), ("", None), (None, None), ("€ 5", 5.0)])
def test_to_double(spark, text, want):
    assert one(spark, text, exprs.to_double) == want


@pytest.mark.parametrize(("text", "want"), [("2.5", 2), ("3.5", 4), ("-0.5", 0), ("1e30", None), ("x", None)])
def test_to_bigint(spark, text, want):
    assert one(spark, text, exprs.to_bigint) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("2026-01-05", (2026, 1, 5)), ("2026-01-05T10:11:12", (2026, 1, 5, 10, 11, 12)), ("3/4/2026", (2026, 3, 4)), ("25/12/2026", (2026, 12, 25)), ("5 jan 2026", (2026, 1, 5)), ("Mar 7, 2026", (2026, 3, 7)), ("Feb 2026", (2026, 2, 1)), ("no", None), ("2026-13-01", None)],
)
def test_to_timestamp(spark, text, want):
    assert one(spark, text, exprs.to_timestamp) == (dt.datetime(*want) if want else None)


def test_names():
    assert exprs.sanitize_names(["date", "sales", "date", "sales", "", "Unnamed: 5"]) == ["date", "sales", "date_1", "sales_1", "column_5", "column_6"]
    assert len(set(exprs.sanitize_names(["a", "a_1", "a", "a"]))) == 4
    assert exprs.suggest_name(" Unit Price ($) ") == "unit_price_"


def test_bad_cells_become_errors_and_rows_stay(spark):
    raw = spark.createDataFrame([(0, "2026-01-01", "2", "$10.00", "n"), (1, "2026-01-02", "invalid_num", "$5.50", "n"), (2, "bad", "", None, "n")], "_row_index long, `Order Date` string, Qty string, `Unit Price` string, Notes string")
    spec = AlignmentSpec([FieldMapping("Order Date", "date", "datetime"), FieldMapping("Qty", "quantity", "int"), FieldMapping("Unit Price", "price", "currency"), FieldMapping("Notes", "notes", keep=False), FieldMapping("Nope", "x")])
    got = align(raw, spec)
    assert got.df.columns == ["_row_index", "date", "quantity", "price"]
    assert {(e.column, e.row_index, e.raw_value) for e in got.errors.collect()} == {("quantity", 1, "invalid_num"), ("date", 2, "bad")}
    assert got.counts() == {"total_rows_source": 3, "total_rows_aligned": 3, "filtered_out_rows": 0, "coercion_errors_count": 2}
    assert [r["quantity"] for r in got.preview()] == [2, None, None]


def test_computed_columns(spark):
    df = spark.createDataFrame([(2, 100.0, 0), (5, 20.0, 4)], "qty int, price double, z int")
    got = align(df, AlignmentSpec(computed=[ComputedColumn("a", "qty * price"), ComputedColumn("b", "price / z"), ComputedColumn("c", "qty ** 2"), ComputedColumn("d", "qty - nope")])).df
    assert [(r.a, r.b) for r in got.collect()] == [(200.0, None), (100.0, 5.0)] and got.columns[-1] == "b"


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, " West ", 10.0, dt.datetime(2026, 1, 1)), (2, "east", 25.0, dt.datetime(2026, 2, 1, 12)), (3, None, None, None), (4, "", 100.0, dt.datetime(2026, 3, 1))], "id int, region string, v double, t timestamp")


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        (("region", "equals", "WEST"), [1]), (("region", "not_equals", "west"), [2, 3, 4]), (("region", "not_null", None), [1, 2]), (("region", "contains", "ea?st"), [1, 2]), (("region", "in_list", "West, EAST"), [1, 2]),
        (("v", "equals", "25"), [2]), (("v", "not_equals", 25), [1, 4]), (("v", "range", [20, 80]), [2]), (("v", "range", "..25"), [1, 2]), (("v", "range", {"min": 25}), [2, 4]), (("v", "in_list", [10, 100]), [1, 4]), (("v", "not_null", None), [1, 2, 4]),
        (("t", "range", ["2026-01-15", "2026-02-01"]), []), (("t", "range", ["2026-01-15", "2026-03-01"]), [2, 4]), (("region", "range", ["a", "f"]), [2]), (("nope", "equals", 1), [1, 2, 3, 4]), (("v", "unknown", 1), [1, 2, 3, 4]),
    ],
)
@pytest.mark.filterwarnings("ignore:filter on unknown")
def test_filters(people, rule, want):
    assert sorted(r.id for r in apply(people, [FilterRule(*rule)]).collect()) == want


def test_rules_are_one_filter_that_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = apply(df, [FilterRule("l_quantity", "range", [5, 10]), FilterRule("l_discount", "range", [0.01, None])])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_" in plan and plan.count("Filter (") == 1 and "l_discount#" in plan
