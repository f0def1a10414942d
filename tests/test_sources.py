from __future__ import annotations

import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.api import ApiError, Engine
from millrace.operators.align import AlignmentSpec, ComputedColumn, FieldMapping
from millrace.operators.filters import FilterRule
from millrace.plans.base import AnalysisRequest
from millrace.sources import files, ocr, office, sinks, textual


def tables(data, name):
    if isinstance(data, str):
        data = data.encode()
    return files.extract(data, name)


def one(data, name):
    found = tables(data, name).tables
    assert len(found) == 1
    return found[0].headers, [c for _, _, c in found[0].rows]


def test_json_forms():
    heads, rows = one(json.dumps([{"id": 1, "customer": {"name": "A", "city": "B"}, "tags": ["x", "y"], "active": True}, {"id": 2, "amount": 1.5, "customer": {"name": "C"}}]), "orders.json")
    assert heads == ["id", "customer.name", "customer.city", "tags", "active", "amount"] and rows[0][3:5] == ["x, y", "true"] and rows[1][2] is None
    found = tables(json.dumps({"users": [{"a": 1}], "orders": [{"b": 2}], "version": 3}), "x.json").tables
    assert [(t.name, t.headers) for t in found] == [("users", ["a"]), ("orders", ["b"]), ("Metadata", ["version"])]
    geo = json.dumps({"type": "FeatureCollection", "features": [{"properties": {"n": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]})
    assert one(geo, "m.geojson") == (["n", "_geometry_type", "_coordinates"], [["p", "Point", "[1, 2]"]])
    lines = tables('{"a": 1}\nbad\n{"a": 2}', "x.jsonl")
    assert len(lines.tables[0].rows) == 2 and lines.unparsed[0][0] == 2
    assert one("5", "x.json") == (["Value"], [["5"]]) and one('{"a": {"b": {"c": {"d": {"e": 1}}}}}', "x.json")[0] == ["a.b.c.d"]


def test_text_forms():
    assert one("Product\tCategory\tPrice\nMouse\tX\t5\nKey\tY\t6\n", "inventory.tsv") == (["Product", "Category", "Price"], [["Mouse", "X", "5"], ["Key", "Y", "6"]])
    heads, rows = one("2026-09-14 12:00:00 [INFO] auth: User in\n2026-09-14 12:00:05 [ERROR] db: Lost\nplain line\n", "system.log")
    assert heads == ["Timestamp", "Level", "Module", "Message"] and rows[1] == ["2026-09-14 12:00:05", "ERROR", "db", "Lost"] and rows[2][1] == "INFO"
    assert one("# T\n| Region | Q1 |\n|---|:-:|\n| N | 1 |\n| S | 2 |\n", "report.md") == (["Region", "Q1"], [["N", "1"], ["S", "2"]])
    assert one("# c\na = 1\nb: two\nc.d='x'\n", "x.conf") == (["Key", "Value"], [["a", "1"], ["b", "two"], ["c.d", "x"]])
    assert one("just words here\n\nand more\n", "x.txt")[1] == [["1", "just words here", "3", "15"], ["3", "and more", "2", "8"]]
    assert one("Metric;Value;Date\na;1;2026\nb;2;2026\nc;3;2026", "telemetry.custom")[0] == ["Metric", "Value", "Date"]
    heads, rows = one('\n\na,,c\n1,"x\ny",3,4\n\n5\n', "x.csv")
    assert heads == ["a", "Col_1", "c"] and rows == [["1", "x\ny", "3"], ["5", None, None]]
    assert tables(b"\xe9;1\n\xe8;2\n", "x.csv").tables[0].headers == ["é", "1"]
    assert tables("", "x.csv").warnings and tables("{bad", "x.json").warnings


def test_markup():
    page = "<table><caption>Cap</caption><tr><th>a</th><th></th></tr><tr><td>1 &amp; 2</td><td>x</td><td>y</td></tr></table><p>no</p><table></table>"
    assert one(page, "x.html") == (["a", "Col_1"], [["1 & 2", "x"]]) and tables(page, "x.html").tables[0].name == "Cap"
    assert one("<ul><li>one two</li></ul><script>x</script><p>three</p>", "x.html")[1] == [["1", "one two", "2"], ["2", "three", "1"]]
    xml = '<?xml version="1.0"?><r xmlns="u"><rec id="1"><n>A</n></rec><rec id="2"><n>B</n><z>q</z></rec></r>'
    assert one(xml, "x.xml") == (["@id", "n", "z"], [["1", "A", None], ["2", "B", "q"]])
    assert tables("<a><b></a>", "x.xml").warnings
    assert tables(b"\x00\x01http://x.y\x00\x02ab\x00word here", "x.bin").tables[0].rows[0][2][2] == "url"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_office():
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("Project", "Budget"), ("X", "5"))) + "</w:tbl>"
    assert one(docx(body), "specs.docx") == (["Project", "Budget"], [["X", "5"]])
    assert one(docx("<w:p><w:r><w:t>two words</w:t></w:r></w:p>"), "unknown")[1] == [["1", "two words", "2"]]
    pptx = io.BytesIO()
    with zipfile.ZipFile(pptx, "w") as z:
        z.writestr("ppt/presentation.xml", "<p/>")
        for k in (10, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f'<p:s xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:t>slide {k}</a:t></a:p></p:sp></p:s>')
    assert [r[0] for r in one(pptx.getvalue(), "x.pptx")[1]] == ["2", "10"]
    db = sqlite3.connect(":memory:")
    db.executescript("create table employees(id int, name text); insert into employees values (1, 'A'), (2, null); create view v as select id from employees")
    found = tables(db.serialize(), "company.sqlite").tables
    assert [(t.name, len(t.rows)) for t in found] == [("employees", 2), ("v", 2)]
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x00\x03\x00\x00\x00\x04"
    assert one(png, "x")[1][0][1:4] == ["png", "3", "4"]
    pdf = b"%PDF-1.4\nstream\nBT (Hello \\(x\\)) Tj T* (World) Tj ET\nendstream\n"
    assert one(pdf, "x.pdf")[1] == [["Hello (x)"], ["World"]]


def test_workbook():
    data = office.write_xlsx({"Q1_Sales": [["Region", "Revenue"], ["N", 61000.0], ["S & T", True], [None, "=B2+1"]], "Q2_Sales": [["Revenue"], [2]], "Empty": []})
    assert office.Workbook(data).names() == ["Q1_Sales", "Q2_Sales", "Empty"]
    found = files.extract(data, "sample.xlsx")
    assert [t.name for t in found.tables] == ["Q1_Sales", "Q2_Sales"] and found.tables[0].rows[0][2] == ["N", "61000"] and found.tables[0].rows[1][2] == ["S & T", "true"]
    assert len(office.read_xlsx(data, "x", "Q2_Sales").tables) == 1 and found.warnings
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            content = a.read(n).decode()
            if n == "xl/workbook.xml":
                content = content.replace('name="Q2_Sales"', 'name="Q2_Sales" state="hidden"')
            if n.endswith("sheet1.xml"):
                content = content.replace("</sheetData>", '</sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells>')
            b.writestr(n, content)
    merged = files.extract(out.getvalue(), "m.xlsx").tables
    assert len(merged) == 1 and [r[2][0] for r in merged[0].rows][:2] == ["N", "N"]
    assert office.sheet_names(["a/b", "a:b", "x" * 40, "x" * 40]) == ["a_b", "a_b_2", "x" * 31, "x" * 29 + "_2"]


def test_archive_and_dataset(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "bundle.zip", "w") as z:
        z.writestr("users.json", json.dumps([{"user_id": 1, "username": "a"}]))
        z.writestr("d/orders.csv", "order_id,user_id,total\n7,1,9.5\n8,1,1.5\n")
        z.writestr("__MACOSX/x.csv", "a,b\n")
        z.writestr(".hidden", "a")
    engine = Engine(spark, f"{tmp_path}/store")
    profiles, comp, plan = engine.profile_file(f"{tmp_path}/bundle.zip")
    assert [p.name for p in profiles] == ["users.json - users.json", "orders.csv - orders.csv"]
    assert comp.relationships[0]["matching_column"] == "user_id" and comp.total_records == 3 and comp.completeness_pct == 100
    assert plan.charts[0].chart_type == "kpi"
    said = json.loads(sinks.profiles_to_json(profiles, comp, "t1"))
    assert set(said) == {"task_id", "composition", "tables"} and said["tables"][1]["records"][0]["total"] == "9.5"
    flat = sinks.profiles_to_csv(profiles)
    assert flat.startswith(b"\xef\xbb\xbf_table_index,_source_sheet,_source_page,_row_index,user_id,username,order_id,total\r\n") and flat.count(b"\r\n") == 4
    book = files.extract(sinks.profiles_to_xlsx(profiles), "x.xlsx").tables
    assert len(book) == 3 and book[1].rows[0][2][0] == "7"
    assert b"orders.csv" in sinks.report(profiles, comp)


CSV = "Order Date,Product,Qty,Unit Price,Region\n2026-01-05,Laptop,2,$1200.00,West\n2026-02-05,Mouse,x,$25.00,West\n2026-02-07,Laptop,1,$1200.00,East\n2026-03-01,Mouse,4,$25.00,west \n"


def test_whole_course(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(CSV)
    engine = Engine(spark, f"{tmp_path}/store")
    up = engine.upload(f"{tmp_path}/sales.csv")
    schema = engine.schema(up["file_id"])
    assert [(c["name"], c["dtype"], c["semantic_label"]) for c in schema["columns"]][:2] == [("Order Date", "datetime", "date"), ("Product", "string", "name")]
    spec = AlignmentSpec([FieldMapping("Order Date", "date", "datetime"), FieldMapping("Product", "product", "string"), FieldMapping("Qty", "quantity", "int"), FieldMapping("Unit Price", "unit_price", "float"), FieldMapping("Region", "region", "string")], [FilterRule("Region", "equals", "West")], [ComputedColumn("revenue", "quantity * unit_price")])
    got = engine.align(up["file_id"], spec)
    assert (got["total_rows_source"], got["total_rows_aligned"], got["filtered_out_rows"], got["coercion_errors_count"]) == (4, 3, 1, 1)
    assert got["coercion_error_samples"][0]["raw_value"] == "x" and got["columns"][-1] == "revenue"
    result = engine.analyze(got["aligned_id"], AnalysisRequest("sales_analysis", category_columns=["product"]))
    assert "Laptop" in result.summary
    assert engine.export(result.result_id, "csv").splitlines()[1] == b"2026-01-05,Laptop,2,1200.0,West,2400.0"
    assert json.loads(engine.export(got["aligned_id"], "json"))["data"][2]["revenue"] == 100.0
    book = files.extract(engine.export(result.result_id, "xlsx"), "x.xlsx").tables
    assert [t.name for t in book] == ["Executive Summary", "Aligned Data"] and len(book[1].rows) == 3
    assert engine.store.info(result.result_id)["analysis"]["analysis_type"] == "sales_analysis" and engine.health()["status"] == "healthy"
    for call, status in ((lambda: engine.table("nope"), 404), (lambda: engine.export("nope"), 404), (lambda: engine.export(got["aligned_id"], "pdf"), 400), (lambda: engine.analyze(got["aligned_id"], AnalysisRequest("nope")), 400), (lambda: engine.analyze("nope", AnalysisRequest("comparison")), 404)):
        with pytest.raises(ApiError) as e:
            call()
        assert e.value.status == status
    (tmp_path / "x.exe").write_text("a")
    with pytest.raises(ApiError):
        engine.upload(f"{tmp_path}/x.exe")
    with pytest.raises(ValueError):
        files.check_upload("a.csv", 51 << 20)


def test_large_file_readers(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("a\tb\ta\n" + "".join(f"{k}\tx{k}\t\n" for k in range(500)))
    df = files.read_csv(spark, f"{tmp_path}/a.tsv")
    assert df.columns == ["a", "b", "a_1", "_row_index"]
    assert df.filter("cast(a as long) <> _row_index").count() == 0
    (tmp_path / "a.jsonl").write_text('{"a": {"b": 1, "c": [1, 2]}, "d": [{"x": 1}]}\n{"a": {"b": 2}}\n')
    assert {r["a.b"]: (r["a.c"], r.d) for r in files.read_json_lines(spark, f"{tmp_path}/a.jsonl").collect()} == {1: ("1, 2", '[{"x":1}]'), 2: (None, None)}
    text = spark.createDataFrame([("2026-09-14 12:00:00 [warn] auth: hi",), ("free text: x",), ("k = 'v'",), ("# k = 1",), ("| a | b |",), ("|---|---|",)], "value string")
    assert files.parse_log(text).first()[1:] == ("2026-09-14 12:00:00", "WARN", "auth", "hi")
    assert [(r.key, r.setting) for r in files.parse_key_values(text).collect()] == [("k", "v")]
    assert [r.cells for r in files.parse_markdown(text).collect()] == [["a", "b"]]
    assert [tuple(r)[1:] for r in files.text_lines(spark.createDataFrame([("one two\n\n x ",)], "t string"), "t").collect()] == [(1, "one two", 2, 7), (3, "x", 1, 1)]
    assert files.lines(spark, f"{tmp_path}/a.tsv").count() == 501


def test_word_layout(spark):
    words = spark.createDataFrame([(1, 10.0, 5.0, 30.0, "Name"), (1, 200.0, 8.0, 20.0, "Qty"), (1, 12.0, 40.0, 20.0, "Red"), (1, 36.0, 41.0, 20.0, "pen"), (1, 205.0, 40.0, 9.0, "7")], "page int, x double, y double, width double, text string")
    got = {(r.line, r.column): r.text for r in ocr.layout(words).collect()}
    assert got == {(0, 0): "Name", (0, 1): "Qty", (1, 0): "Red pen", (1, 1): "7"}


def test_streams(spark, tmp_path):
    from millrace.streaming import windows

    rows = [(k, f"2026-01-0{1 + k // 4} 0{k % 4}:30:00", "a" if k % 2 else "b", float(k)) for k in range(12)] + [(3, "2026-01-01 03:30:00", "a", 3.0)]
    df = spark.createDataFrame(rows, "id long, t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(f"{tmp_path}/in")
    source = lambda: windows.read_stream(spark, f"{tmp_path}/in", df.schema)

    def drain(stream, mode):
        q = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/c{len(list(tmp_path.iterdir()))}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table("out").collect()

    assert sum(r.records for r in drain(windows.windowed(source(), "t", "v", "1 hour"), "complete")) == 13
    assert sum(r.records for r in drain(windows.windowed(source(), "t", "v", "2 hours", "1 hour"), "complete")) == 26
    assert {(r.k, r.records) for r in drain(windows.sessions(source(), "t", "v", "5 hours", ("k",)), "complete")} == {("a", 3), ("a", 2), ("b", 2)}
    assert {(r.period, r.total) for r in drain(windows.buckets(source(), "t", "v"), "complete")} == {("2026-01", 69.0)}
    assert len(drain(windows.deduplicate(source(), "t", ["id"]), "append")) == 12
    assert len(drain(windows.matching(source(), [FilterRule("k", "equals", "A")]), "append")) == 7
    assert textual.sniff("") == ","
