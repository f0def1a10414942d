"""Functions of the user's own, and files that only bytes tell how to read."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.api import ApiError, Engine
from millrace.functions import registry
from millrace.operators import infer, profile
from millrace.operators.compose import Composition
from millrace.operators.filters import AllOf, AnyOf, FilterRule, Not, apply
from millrace.sources import connect, files, pdf, sinks


def test_scalars_aggregates_and_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (2, None)], "k int, t string")

    def shout(t: pd.Series) -> pd.Series:
        return t.str.upper() + "!"

    def spread(k: pd.Series) -> float:
        return float(k.max() - k.min())

    registry.register_scalar(spark, "shout", shout, "string")
    registry.register_aggregate(spark, "spread", spread, "double")
    registry.register_table(spark, "split_words", lambda t: [(i, w) for i, w in enumerate((t or "").split())], "place int, word string")
    assert [r[0] for r in df.select(registry.call("shout", "t")).collect()] == ["A B!", "C!", None]
    df.createOrReplaceTempView("own_rows")
    assert spark.sql("select spread(k) as s from own_rows").first() == (1.0,)
    assert sorted(map(tuple, registry.explode(df, "split_words", "t").select("k", "place", "word").collect())) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    assert spark.sql("select count(*) from own_rows, lateral split_words(t)").first()[0] == 3
    assert "split_words" in registry.names("table") and {"shout", "spread"} <= set(registry.names())
    for bad in (lambda: registry.call("nope", "t"), lambda: registry.explode(df, "shout", "t")):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        registry.register_scalar(spark, "not a name", shout, "string")


def test_aggregates_of_hot_keys_merge_partial_states(spark):
    df = spark.range(5000).selectExpr("cast(if(id % 10 < 8, 0, id % 10) as int) AS k", "cast(id as double) AS v").repartition(6)

    def partial(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("k", as_index=False).agg(n=("v", "size"), s=("v", "sum"), low=("v", "min"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("k", as_index=False).agg(n=("n", "sum"), s=("s", "sum"), low=("low", "min"))

    got = sorted(map(tuple, registry.merge(df, ["k"], partial, merge, "k int, n long, s double, low double").collect()))
    assert got == sorted(map(tuple, df.groupBy("k").agg(F.count("*"), F.sum("v"), F.min("v")).collect()))


def test_uploads_as_people_have_them(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")

    def rows(data: bytes, name: str):
        (tmp_path / name).write_bytes(data)
        up = engine.upload(f"file://{tmp_path}/{name}")
        df = engine.table(up["file_id"]).orderBy("_row_index")
        return df.columns[:-1] if df.columns[-1] == "_row_index" else [c for c in df.columns if c != "_row_index"], [tuple(r)[:] for r in df.drop("_row_index").collect()]

    assert rows(b'note,n\n"line one\nline two",1\n"say ""hi"", ok",2\n', "quoted.csv") == (["note", "n"], [("line one\nline two", "1"), ('say "hi", ok', "2")])
    assert rows("naïve,city\nJosé,Málaga\n".encode("latin-1"), "latin.csv") == (["naïve", "city"], [("José", "Málaga")])
    assert rows("name,city\nJosé,Málaga\n".encode(), "utf.csv")[1] == [("José", "Málaga")]
    assert rows("﻿a,b\n1,2\n".encode(), "mark.csv") == (["a", "b"], [("1", "2")])
    assert rows("a;b\r\n1;x\r\n\r\n2;y\r\n".encode("utf-16"), "wide.csv") == (["a", "b"], [("1", "x"), ("2", "y")])
    assert rows(b"a,b\n1,2\n3,4,5\n6\n7,8\n", "bad.csv") == (["a", "b"], [("1", "2"), ("6", None), ("7", "8")])
    assert rows(b"a\tb\n1\t2\n", "t.tsv") == (["a", "b"], [("1", "2")])
    # only files whose cells go on in the next line are read as one piece
    assert [files.csv_traits(spark, f"file://{tmp_path}/{n}.csv").multiline for n in ("quoted", "latin", "bad")] == [True, False, False]


def test_sizes_and_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n" + b"1,2\n" * 50)
    with pytest.raises(ApiError, match="(?s)."):
        Engine(spark, f"file://{tmp_path}/s1", most_bytes=20).upload(f"file://{tmp_path}/a.csv")
    engine = Engine(spark, f"file://{tmp_path}/s2", most_bytes=10**12)
    from millrace.operators.align import AlignmentSpec

    got = engine.align(engine.upload(f"file://{tmp_path}/a.csv")["file_id"], AlignmentSpec())
    engine.export_table(got["aligned_id"], f"file://{tmp_path}/out", "orc")
    assert spark.read.orc(f"file://{tmp_path}/out").count() == 50
    with pytest.raises(ApiError) as e:
        engine.export(got["aligned_id"], most_rows=10)
    assert e.value.status == 413


def test_nested_filters(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], None if k == 4 else k * 1.0) for k in range(8)], "k int, s string, v double")
    low, high, a = FilterRule("v", "range", "..1"), FilterRule("v", "range", "6.."), FilterRule("s", "equals", "A")
    ids = lambda *rules: [r.k for r in apply(df, list(rules)).orderBy("k").collect()]
    assert ids(AnyOf((low, high))) == [0, 1, 6, 7] and ids(AnyOf((low, high)), a) == [0, 6]
    assert ids(Not(AnyOf((low, high)))) == [2, 3, 4, 5] and ids(Not(AllOf((a, high)))) == [0, 1, 2, 3, 4, 5, 7]
    assert ids(AnyOf(())) == list(range(8)) == ids(AllOf(()))
    renamed = apply(df, [AnyOf((FilterRule("old", "equals", "b"), Not(a)))], {"old": "s"})
    assert renamed.count() == 4
    scan = df.write.mode("overwrite")
    assert scan is not None


def test_label_rules_can_be_added():
    assert infer.label("iban", "string", ["DE89"], 100, 100) == "text"
    infer.register_label(infer.LabelRule("account", lambda e: e.name == "iban"), before="id")
    try:
        assert infer.label("iban", "string", ["DE89"], 100, 100) == "account" and infer.label("cust_id", "int", [1], 9, 9) == "id"
    finally:
        infer.LABELS.pop(next(k for k, r in enumerate(infer.LABELS) if r.label == "account"))
    assert [infer.label(n, d, s, u, 100) for n, d, s, u in (("When", "datetime", [], 1), ("x", "string", ["5 €"], 99), ("x", "float", ["5%"], 99), ("num_items", "int", [], 3), ("ok", "boolean", [], 2), ("kind", "string", ["a"], 15), ("words", "string", ["a"], 90))] == ["date", "currency", "percentage", "quantity", "boolean", "category", "text"]


def test_half_years_and_medians(spark):
    import re

    shape = profile.DATE_SHAPES.replace("(?i)", "")
    assert [bool(re.match(shape, x, re.I)) for x in ("H1 2024", "H2 FY24", "H3 2024", "H4 24", "Q4 2024", "Q5 2024")] == [True, True, False, False, True, False]
    df = spark.createDataFrame([("a", "10"), ("b", "12"), ("c", "(40)"), ("d", None)], "t string, v string")
    from millrace.plans import aggregates

    found = aggregates.medians(df, ["t", "v"])
    assert found == {"t": None, "v": 10.0}
    assert [r[0] for r in df.orderBy("t").select(profile.exceeds_median(found)).collect()] == [False, False, True, False]


def test_columnar_files(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 AS k", "cast(id as string) AS t")
    for kind in ("parquet", "orc", "json"):
        connect.write_table(df, kind, f"file://{tmp_path}/{kind}", by=["k"])
        got = connect.read_table(spark, kind, f"file://{tmp_path}/{kind}", ["id"], "k = 1 and id > 50")
        assert sorted(r.id for r in got.collect()) == [k for k in range(51, 100) if k % 3 == 1]
        if kind != "json":
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "GreaterThan(id,50)" in plan and "(k#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "t:string" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError):
        connect.read_table(spark, "exe", "x")
    with pytest.raises(ValueError):
        connect.read_database(spark, "jdbc:x", "t", split="id")


def test_pdf_tables_and_reports(spark):
    data = pdf.write_pdf([("title", "Figures (2026)"), ("text", "Some words before."), ("table", [["Region", "Sales", "Note"], ["North", "1,200", "a \\ b"], ["South", "", "é"], ["West", "7", None]])])
    found = files.extract(data, "x.pdf")
    assert not found.warnings and [t.method for t in found.tables] == ["pdf_table"]
    assert found.tables[0].headers == ["Region", "Sales", "Note"] and [c for *_, c in found.tables[0].rows] == [["North", "1,200", "a \\ b"], ["South", None, "é"], ["West", "7", None]]
    many = pdf.write_pdf([("table", [["a", "b"], *([k, k * k] for k in range(200))])])
    pages = files.extract(many, "y.pdf").tables
    assert len(pages) > 2 and sum(len(t.rows) + 1 for t in pages) == 201 and pages[1].page == 2
    # kerned pieces, hex strings, a font with its own codes, cells by relative moves
    cmap = b"beginbfchar <01> <0041> endbfchar beginbfrange <02> <04> <0062> endbfrange"
    body = b"BT /F9 12 Tf 50 700 Td <0102> Tj 200 0 Td [(\\003) -500 (\\004)] TJ -200 -20 Td (\\001) Tj 200 0 Td <04> Tj ET"
    raw = b"%PDF-1.5\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Type /Pages /Kids [3 0 R]>> endobj 3 0 obj <</Type /Page /Resources <</Font <</F9 5 0 R>>>> /Contents [4 0 R]>> endobj 4 0 obj <<>> stream\n" + body + b"\nendstream endobj 5 0 obj <</ToUnicode 6 0 R>> endobj 6 0 obj <<>> stream\n" + cmap + b"\nendstream endobj"
    t = files.extract(raw, "z.pdf").tables[0]
    assert t.headers == ["Ab", "c d"] and [c for *_, c in t.rows] == [["A", "d"]]
    assert files.extract(b"%PDF-1.4\n", "e.pdf").warnings and files.extract(pdf.write_pdf([]), "n.pdf").warnings
    df = spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "1")], "name string, amount string")
    p = profile.profile(df, "small")
    shown = files.extract(sinks.report_pdf([p], Composition(99.0, 100.0, 3, [], False, [], ["one insight"])), "r.pdf")
    assert any("name" in str(t.rows) for t in shown.tables)
