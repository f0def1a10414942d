from __future__ import annotations

import pytest

from millrace.operators import compose, infer, periods, profile, rows
from millrace.plans import layout


def table(spark, text):
    head, *lines = [x.split(",") for x in text.strip().splitlines()]
    data = [(k, *(v or None for v in line)) for k, line in enumerate(lines)]
    return spark.createDataFrame(data, "_row_index long, " + ", ".join(f"`{h}` string" for h in head))


BUDGET = """Dept,Jan 2026,February 2026,Mar-26,Total,Note
North,10,20,30,60,
,,,,,
,,,,,
,,,,,
South,1,2,3,7,a < b
South,1,2,3,7,a < b
West,5,5,-5,5,c
Subtotal,17,29,31,80,
Europe,,,,,
Grand Total,17,29,31,80,"""


def test_budget(spark):
    p = profile.profile(table(spark, BUDGET), "budget")
    assert {c.header: c.inferred_type for c in p.columns} == {"Dept": "identifier", "Jan 2026": "time_period", "February 2026": "time_period", "Mar-26": "time_period", "Total": "numeric", "Note": "free_text"}
    assert (p.time.kind, p.time.start, p.time.end) == ("monthly", "2026-01", "2026-03") and p.columns[4].is_computed
    assert p.role_counts == {"detail": 7, "subtotal": 1, "grand_total": 1, "section_header": 1} and p.has_hierarchy
    assert {(m.row_index, m.delta) for m in p.mismatches.collect()} == {(4, 1.0), (5, 1.0)}
    found = {(a.anomaly_type, a.row_index, a.column) for a in p.anomalies.collect()}
    assert ("blank_run", 1, "Dept") in found and ("duplicate_row", 5, None) in found and ("ocr_corruption", 4, "Note") in found
    assert ("duplicate_row", 2, None) in found
    plan = layout.plan([p])
    assert [c.chart_type for c in plan.charts] == ["kpi", "line", "mismatch", "anomaly"] and plan.highlight_anomalies
    line = layout.line_data(p, plan.charts[1]).collect()
    assert (line[0].series, line[0].period, line[0].value) == ("North", "2026-01", 10.0)
    assert "Row 4, Total: 7 stands for 6." in profile.summary(p)
    c = compose.compose([p])
    assert [x["header"] for x in compose.search_catalogue(c.unified_columns, "NUMERIC")] == ["Total"]
    assert c.total_records == 10 and c.health_score < 80 and c.unified_columns[0]["total_count"] == 10


def test_negatives_and_bars(spark):
    text = "Product,Price,Share,Active,When,Meta\n" + "\n".join(f'P{k % 3},${k},{k / 20},yes,2026-01-{k + 1:02d},{{"a":{k}}}' for k in range(19)) + "\nP1,-$5,0.5,no,2026-02-01,{}"
    p = profile.profile(table(spark, text.replace('{"a"', '{"a"')), "t")
    assert [c.inferred_type for c in p.columns] == ["category", "currency", "percentage", "boolean", "date", "complex"]
    assert [(a.row_index, a.raw_value) for a in p.anomalies.filter("anomaly_type like 'neg%'").collect()] == [(19, "-$5")]
    assert compose.category_cardinality([p, p]) == 3 and layout.kpis([p])["rows"] == 20
    plan = layout.plan([p])
    assert plan.charts[1].chart_type == "bar_horizontal" and layout.bar_data(p, plan.charts[1]).count() == 20


def test_blank_runs_join_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(profile, "CHUNK", 4)
    df = spark.createDataFrame([(k, None if 2 <= k <= 9 or k in (12, 13) or k >= 15 else "x") for k in range(20)], "_row_index long, c string")
    got = sorted((a.row_index, a.detail) for a in profile.blank_runs(df, ["c"]).collect())
    assert got == [(2, "8"), (15, "5")]


@pytest.mark.parametrize(
    ("header", "want"),
    [("Jul 2025", "2025-07"), ("September 2025", "2025-09"), ("Déc-24", "2024-12"), ("07/2025", "2025-07"), ("2025/7", "2025-07"), ("Q1FY26", "2026-Q1"), ("1Q2025", "2025-Q1"), ("H2 2025", "2025-H2"), ("1999", "1999"), ("FY26", "FY2026"), ("2025/13", None), ("Total", None), ("Mon-25", None), ("jan 75", "1975-01")],
)
def test_periods(header, want):
    p = periods.parse(header)
    assert (p and p.label) == want


def test_schema(spark):
    df = spark.createDataFrame(
        [(k, f"2026-01-{k + 1:02d}", f"${k},250.00", k * 3, f"SKU-{k:03d}", "yes" if k % 2 else "no", float(k), k + 0.5, ["West", "East"][k % 2], None) for k in range(8)],
        "_row_index long, `Order Date` string, Money string, Qty int, product_code string, ok string, whole double, frac double, area string, none string",
    )
    s = infer.detect(df)
    assert [(c.dtype, c.semantic_label) for c in s.columns] == [("datetime", "date"), ("float", "currency"), ("int", "quantity"), ("string", "id"), ("boolean", "boolean"), ("int", "numeric"), ("float", "numeric"), ("string", "category"), ("string", "text")]
    assert (s.columns[1].min_val, s.columns[1].max_val) == (250.0, 7250.0) and s.columns[8].null_pct == 100 and s.columns[3].unique_count == 8 and s.row_count == 8 and len(s.preview) == 8
    assert infer.annotate(df, s).schema["Qty"].metadata["semantic_label"] == "quantity"
    sparse = spark.range(1000).selectExpr("id as _row_index", "case when id >= 900 then cast(id as string) end as late")
    assert infer.detect(sparse).columns[0].dtype == "int"


def test_rows(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id as v")
    assert [r[0] for r in rows.with_row_index(df).filter("_row_index <> v").collect()] == []
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, n string")
    b = spark.createDataFrame([("3", 1.5)], "id string, z double")
    u = rows.union({"a": a, "b": b})
    assert u.columns == ["_source_table", "id", "n", "z"] and {(r._source_table, r.id) for r in u.collect()} == {("a", "1"), ("a", "2"), ("b", "3")}
    assert rows.search(a, "X").count() == 1 and rows.search(a, "2").count() == 1
    mixed = spark.createDataFrame([("10",), ("9",), ("b",), (None,)], "s string")
    assert [r.s for r in rows.sort_rows(mixed, "s").collect()] == ["9", "10", None, "b"]
    assert [r.v for r in rows.page(df.orderBy("v"), 2, 10).collect()] == list(range(20, 30))
    assert rows.drop_empty(spark.createDataFrame([(None, None, 1), (None, None, None)], "a int, b int, `` int")).columns == ["column_1"]


def test_composition():
    assert compose.shared_keys({"users": {"user_id", "name"}, "orders": {"order_id", "user_id", "total"}}) == [{"table_a": "users", "table_b": "orders", "matching_column": "user_id", "type": "shared_key"}]
    assert compose.can_unify([{"a", "b", "c"}, {"a", "b", "c", "d"}]) and not compose.can_unify([{"a", "b"}, {"a"}])
    assert compose.health(100, 10, 2, 1, 3) == 82.5 and compose.completeness(0, 0) == 100 and compose.health(1, 1, 99, 99, 99) == 10.0


def test_joins(spark):
    from millrace.operators import joins

    a = spark.createDataFrame([(1, 10, "x"), (1, 20, "y"), (2, 5, "z"), (3, 1, "w")], "k int, t int, v string")
    b = spark.createDataFrame([(1, 9, 0.5), (1, 20, 0.7), (2, 6, 0.9)], "k int, t int, q double")
    assert {(r.v, r.q) for r in joins.as_of(a, b, "t", ["k"], ["q"]).collect()} == {("x", 0.5), ("y", 0.7), ("z", None), ("w", None)}
    assert joins.equi(a, b.select("k").distinct(), ["k"], "left_anti").count() == 1 and joins.equi(a, b.select("k", "q"), ["k"], "full").count() == 6
    ranges = spark.createDataFrame([("r", 4, 12), ("s", 20, 20), ("t", 30, 10)], "name string, lo int, hi int")
    assert {(r.v, r.name) for r in joins.in_range(a, ranges, "t", "lo", "hi", 5).collect()} == {("x", "r"), ("z", "r"), ("y", "s")}


def test_partitioning_changes_nothing(spark, sf_dir):
    from millrace.plans import aggregates as agg

    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id as _row_index", "ts", "event_type", "cast(value as decimal(18,2)) as value", "'detail' as _row_role").filter("_row_index < 3000")

    def results(df):
        yield sorted(map(tuple, agg.buckets(df, "ts", "value", "W").collect()))
        yield list(map(tuple, agg.segments(df, "event_type", "value").collect()))
        yield sorted(map(tuple, profile.duplicates(df, ["event_type", "value"]).collect()))
        yield sorted(map(tuple, profile.blank_runs(df.selectExpr("_row_index", "case when value > 30 then 1 end as v"), ["v"]).collect()))
        yield [sorted(s.items()) for s in profile.signals(df, ["event_type", "value"])]
        yield list(map(tuple, agg.statistics(df, ["value"]).select("count", "median", "q1", "min", "max").collect()))

    one, many = events.coalesce(1), events.repartition(13, "value")
    for a, b in zip(results(one), results(many), strict=True):
        assert a == b
