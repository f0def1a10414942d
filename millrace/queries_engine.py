"""More operators as queries: files of every kind, streams, ranking, sets, joins, layouts, with the DuckDB SQL for the same rows."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import collections, exprs, registry
from .operators import align as al
from .operators import compose, joins, periods, profile, rows
from .operators.filters import AllOf, AnyOf, FilterRule, Not, apply
from .plans import aggregates as agg
from .plans import analyses, base, layout
from .queries import _exact, _plain, _quarterly, _t, query
from .session import scratch
from .sources import connect, files, ocr, office, pdf, sinks, tables, textual
from .streaming import windows

# Files: the nations of each region as one file of a kind, through the router. Each file is as small as a region.

Maker = Callable[[list[list[str]]], bytes]


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _docx(r: list[list[str]]) -> bytes:
    cell = lambda v: f"<w:tc><w:p><w:r><w:t>{escape(v)}</w:t></w:r></w:p></w:tc>"
    body = "".join("<w:tr>" + "".join(map(cell, x)) + "</w:tr>" for x in r)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>'})


def _pptx(r: list[list[str]]) -> bytes:
    cell = lambda v: f"<a:tc><a:txBody><a:p><a:r><a:t>{escape(v)}</a:t></a:r></a:p></a:txBody></a:tc>"
    body = "".join("<a:tr>" + "".join(map(cell, x)) + "</a:tr>" for x in r)
    return _zipped({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": f'<p:s xmlns:p="p" xmlns:a="a"><p:graphicFrame><a:graphic><a:tbl>{body}</a:tbl></a:graphic></p:graphicFrame></p:s>'})


def _sqlite(r: list[list[str]]) -> bytes:
    db = sqlite3.connect(":memory:")
    db.execute("create table nations (n_nationkey text, n_name text)")
    db.executemany("insert into nations values (?, ?)", r[1:])
    return db.serialize()


def _records(r: list[list[str]]) -> list[dict[str, str]]:
    return [dict(zip(r[0], x, strict=True)) for x in r[1:]]


def _joined(sep: str) -> Maker:
    return lambda r: "\n".join(sep.join(x) for x in r).encode()


_MAKERS: dict[str, Maker] = {
    "csv": _joined(","), "tsv": _joined("\t"), "dat": _joined(";"),
    "md": lambda r: "\n".join(["# nations", *("| " + " | ".join(x) + " |" + ("\n|---|---|" if k == 0 else "") for k, x in enumerate(r))]).encode(),
    "json": lambda r: json.dumps({"data": _records(r), "version": None}).encode(),
    "jsonl": lambda r: "\n".join(map(json.dumps, _records(r))).encode(),
    "geojson": lambda r: json.dumps({"type": "FeatureCollection", "features": [{"properties": x, "geometry": {"type": "Point", "coordinates": [1, 2]}} for x in _records(r)]}).encode(),
    "xml": lambda r: ("<?xml version='1.0'?><all>" + "".join("<row>" + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in x.items()) + "</row>" for x in _records(r)) + "</all>").encode(),
    "html": lambda r: ("<p>x</p><table>" + "".join("<tr>" + "".join(f"<td>{escape(v)}</td>" for v in x) + "</tr>" for x in r) + "</table>").encode(),
    "xlsx": lambda r: office.write_xlsx({"nations": r}), "docx": _docx, "pptx": _pptx, "sqlite": _sqlite,
    "pdf": lambda r: pdf.write_pdf([("title", "Nations"), ("table", r)]),
    "zip": lambda r: _zipped({"a/nations.csv": _joined(",")(r).decode(), "__MACOSX/x.csv": "no,no", ".hidden": "no"}),
    "unknown": lambda r: json.dumps(_records(r)).encode(),
}


def _files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(path, content): the nations of each region as a file."""
    make = _MAKERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = [make([["n_nationkey", "n_name"], *([str(x["k"]), x["n"]] for x in own)]) for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"region{k}.{kind}" for k in b.column(0).to_pylist()]), pa.array(contents, pa.binary())], ["path", "content"])

    nations = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")))).alias("own"))
    return nations.mapInArrow(run, "path string, content binary")


_NATIONS = "SELECT 'region' || n_regionkey AS file, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation"


def _scan(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = files.parse_files(_files(spark, sf_dir, kind)).filter("table_index >= 0 and cells is not null")
        at = lambda name: F.get("cells", (F.array_position("headers", F.lit(name)) - 1).cast("int")).alias(name)
        return found.filter(F.array_contains("headers", "n_name")).select(F.regexp_extract("path", r"(region\d+)", 1).alias("file"), at("n_nationkey"), at("n_name"))

    return run


for _kind in _MAKERS:
    query(_NATIONS, f"scan_{_kind}")(_scan(_kind))


@query("SELECT 'region' || n_regionkey AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS line, n_nationkey || ',' || n_name AS raw_text FROM nation")
def scan_provenance(spark, sf_dir):
    found = files.parse_files(_files(spark, sf_dir, "csv")).filter("cells is not null")
    return found.select(F.regexp_extract("path", r"(region\d+)", 1).alias("file"), "line", "raw_text")


@query("SELECT 'region' || n_regionkey AS file, count(*) AS strings FROM nation GROUP BY 1")
def scan_binary_strings(spark, sf_dir):
    def run(batches):
        for b in batches:
            found = [len(textual.read_binary(b"\x00\x01" + b"\xff".join(x.encode() + b"_name" for x in own), "x").tables[0].rows) for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["file", "strings"])

    nations = _t(spark, sf_dir, "nation").groupBy(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("file")).agg(F.collect_list("n_name").alias("names"))
    return nations.mapInArrow(run, "file string, strings long")


@query("SELECT 'region' || n_regionkey AS file, 'png' AS format, CAST(count(*) AS VARCHAR) AS width, CAST(min(n_nationkey) + 1 AS VARCHAR) AS height FROM nation GROUP BY n_regionkey")
def scan_image(spark, sf_dir):
    """Pictures without a recogniser give what their head says."""
    head = F.concat(F.lit(bytearray(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR")), F.unhex(F.lpad(F.hex(F.count("*")), 8, "0")), F.unhex(F.lpad(F.hex(F.min("n_nationkey") + 1), 8, "0")))
    made = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(head.alias("content")).select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("path"), "content")
    found = files.parse_files(made).filter("cells is not null")
    return found.select(F.col("path").alias("file"), *(F.get("cells", F.lit(k)).alias(c) for k, c in ((1, "format"), (2, "width"), (3, "height"))))


@query("SELECT name, ok FROM (VALUES ('a.csv', true), ('a.XLSX', true), ('a.jsonl', true), ('a.exe', false), ('big.csv', false), ('none.csv', false)) t(name, ok)")
def upload_gate(spark, sf_dir):
    def ok(name: str, size: int) -> bool:
        try:
            files.check_upload(name, size)
        except ValueError:
            return False
        return True

    sizes = {"big.csv": files.MOST_BYTES + 1, "none.csv": 0}
    return spark.createDataFrame([(n, ok(n, sizes.get(n, 5))) for n in ("a.csv", "a.XLSX", "a.jsonl", "a.exe", "big.csv", "none.csv")], "name string, ok boolean")


_NOTE = "p_name || chr(10) || '\"' || p_brand || '\", José'"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, {_NOTE} AS note FROM part")
def csv_upload(spark, sf_dir):
    """A CSV whose cells hold line breaks, quotes and letters beyond ASCII, written in latin-1 and read as it is found."""
    note = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", José'))
    at = scratch(spark, "csv")
    _t(spark, sf_dir, "part").select("p_partkey", note.alias("note")).write.option("header", True).option("escape", '"').option("quote", '"').option("encoding", "ISO-8859-1").csv(at)
    return files.read_csv(spark, at).select("p_partkey", "note")


@query("SELECT o_orderkey, o_orderpriority AS \"deep.priority\", 'a, b' AS tags FROM orders")
def json_lines_scan(spark, sf_dir):
    at = scratch(spark, "json")
    _t(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderpriority").alias("priority")).alias("deep"), F.array(F.lit("a"), F.lit("b")).alias("tags")).write.json(at)
    return files.read_json_lines(spark, at).select("o_orderkey", "`deep.priority`", "tags")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey > 100")
def orc_scan(spark, sf_dir):
    at = scratch(spark, "orc")
    connect.write_table(_t(spark, sf_dir, "orders"), "orc", at)
    return connect.read_table(spark, "orc", at, ["o_orderkey", "o_orderstatus"], "o_orderpriority = '1-URGENT' and o_orderkey > 100")


@query("SELECT n_nationkey, n_name FROM nation")
def store_round_trip(spark, sf_dir):
    from .store import DatasetStore

    store = DatasetStore(spark, scratch(spark, "store"))
    store.put("nations", rows.with_row_index(_t(spark, sf_dir, "nation")), {"from": "nation"})
    return store.get("nations").select("n_nationkey", "n_name")


def _parsed_back(spark: SparkSession, data: bytes, name: str) -> DataFrame:
    t = [t for t in files.extract(data, name).tables if "n_name" in t.headers][0]
    at = [t.headers.index(c) for c in ("n_nationkey", "n_name")]
    return spark.createDataFrame([tuple(cells[k] for k in at) for *_, cells in t.rows], "n_nationkey string, n_name string")


for _kind, _export in (("csv", sinks.to_csv), ("json", sinks.to_json), ("xlsx", sinks.to_xlsx)):

    def _exported(spark, sf_dir, kind=_kind, export=_export):
        return _parsed_back(spark, export(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name")), f"x.{kind}")

    query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation", f"export_{_kind}")(_exported)


def _profiles(spark: SparkSession, sf_dir: str) -> list[profile.TableProfile]:
    return [profile.profile(_t(spark, sf_dir, "nation"), "nation"), profile.profile(_t(spark, sf_dir, "region"), "region")]


@query("SELECT 'nation' AS source, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS r_name FROM nation UNION ALL SELECT 'region', NULL, NULL, r_name FROM region")
def export_details(spark, sf_dir):
    flat = pd.read_csv(io.BytesIO(sinks.profiles_to_csv(_profiles(spark, sf_dir))), dtype=str)
    keep = [(a, *(None if pd.isna(v) else v for v in b)) for a, *b in flat[["_source_sheet", "n_nationkey", "n_name", "r_name"]].itertuples(index=False)]
    return spark.createDataFrame(keep, "source string, n_nationkey string, n_name string, r_name string")


@query("SELECT 'nation' AS name, count(*) AS records FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def export_profiles(spark, sf_dir):
    found = _profiles(spark, sf_dir)
    said = json.loads(sinks.profiles_to_json(found, compose.compose(found), "t"))
    book = files.extract(sinks.profiles_to_xlsx(found), "x.xlsx").tables
    assert [len(t.rows) for t in book[:2]] == [len(t["records"]) for t in said["tables"]]
    return spark.createDataFrame([(t["name"], len(t["records"])) for t in said["tables"]], "name string, records long")


@query("SELECT 'nation' AS name, 3 AS listed UNION ALL SELECT 'region', 2")
def export_report(spark, sf_dir):
    """The columns that the PDF report lists for each table."""
    found = _profiles(spark, sf_dir)
    listed = [t for t in files.extract(sinks.report_pdf(found, compose.compose(found)), "r.pdf").tables if t.headers[:2] == ["column", "type"]]
    return spark.createDataFrame([(p.name, len(t.rows)) for p, t in zip(found, listed, strict=True)], "name string, listed int")


# Alignment and filters


@query("SELECT o_orderkey, o_orderdate FROM orders")
def align_datetime(spark, sf_dir):
    """Times as text of several shapes, cast back."""
    shape = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "d-MMM-yyyy"))
    df = _t(spark, sf_dir, "orders").select("o_orderkey", shape.alias("placed"))
    return al.align(df, al.AlignmentSpec([al.FieldMapping("o_orderkey", "o_orderkey", "int"), al.FieldMapping("placed", "o_orderdate", "datetime")])).df


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE c_custkey % 2 = 0 END AS flag FROM customer")
def align_boolean(spark, sf_dir):
    word = F.when(F.col("c_custkey") % 5 == 4, "maybe").when(F.col("c_custkey") % 2 == 0, F.element_at(F.array(*map(F.lit, ("Yes", " TRUE", "1", "t"))), (F.col("c_custkey") % 4 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, ("no", "False ", "0", "N"))), (F.col("c_custkey") % 4 + 1).cast("int")))
    df = _t(spark, sf_dir, "customer").select("c_custkey", word.alias("w"))
    return al.align(df, al.AlignmentSpec([al.FieldMapping("c_custkey", "c_custkey"), al.FieldMapping("w", "flag", "boolean")])).df


@query("SELECT n_nationkey, n_name FROM nation")
def align_hide(spark, sf_dir):
    return al.hide(_t(spark, sf_dir, "nation"), ["n_regionkey"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 7")
def align_preview(spark, sf_dir):
    df = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias(al.ROW), "n_nationkey", "n_name")
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in al.preview(df, 7)], "n_nationkey int, n_name string")


@query("SELECT name, suggested FROM (VALUES ('Order Date', 'order_date'), (' Unit-Price ($)', 'unit_price_'), ('a/b.c', 'a_b_c'), ('Été', 't')) t(name, suggested)")
def name_suggestions(spark, sf_dir):
    return spark.createDataFrame([(n, exprs.suggest_name(n)) for n in ("Order Date", " Unit-Price ($)", "a/b.c", "Été")], "name string, suggested string")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <> 17")
def filter_not_equals_number(spark, sf_dir):
    return apply(_t(spark, sf_dir, "lineitem"), [FilterRule("l_quantity", "not_equals", "17")]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice >= 300000 OR lower(trim(o_orderstatus)) = 'p') AND NOT (lower(trim(o_orderpriority)) IN ('1-urgent') AND o_totalprice <= 350000)")
def filter_nested(spark, sf_dir):
    rules = [AnyOf((FilterRule("o_totalprice", "range", "300000.."), FilterRule("o_orderstatus", "equals", "P"))), Not(AllOf((FilterRule("o_orderpriority", "in_list", ["1-URGENT"]), FilterRule("o_totalprice", "range", "..350000"))))]
    return apply(_t(spark, sf_dir, "orders"), rules).select("o_orderkey")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS total FROM lineitem")
def row_index(spark, sf_dir):
    df = rows.with_row_index(_t(spark, sf_dir, "lineitem").select("l_orderkey"))
    return df.agg(F.count_distinct(al.ROW).alias("n"), F.min(al.ROW).alias("first"), F.max(al.ROW).alias("last"), F.sum(al.ROW).alias("total"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def drop_empty_rows(spark, sf_dir):
    even = F.col("n_nationkey") % 2 == 0
    df = _t(spark, sf_dir, "nation").select(F.when(even, F.col("n_nationkey")).alias("n_nationkey"), F.when(even, F.col("n_name")).alias("n_name"), F.lit(None).cast("string").alias("nothing"))
    return rows.drop_empty(df)


# Sets, ranking, joins


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two tables with repeated rows and columns in another order."""
    a = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.lit("pos")).alias("sign"))
    b = _t(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") > 5000, F.lit("pos")).alias("sign"), F.col("s_nationkey").alias("k"))
    return a, b


_A = "SELECT c_nationkey AS k, CASE WHEN c_acctbal > 0 THEN 'pos' END AS sign FROM customer"
_BB = "SELECT s_nationkey AS k, CASE WHEN s_acctbal > 5000 THEN 'pos' END AS sign FROM supplier"
for _name, _word, _op in (
    ("set_union_distinct", "UNION", rows.union_distinct), ("set_intersect", "INTERSECT", rows.intersect), ("set_intersect_all", "INTERSECT ALL", lambda a, b: rows.intersect(a, b, True)),
    ("set_except", "EXCEPT", rows.difference), ("set_except_all", "EXCEPT ALL", lambda a, b: rows.difference(a, b, True)),
):
    query(f"{_A} {_word} {_BB}", _name)(lambda spark, sf_dir, op=_op: op(*_keys(spark, sf_dir)))


_WIN = "PARTITION BY c_nationkey ORDER BY c_mktsegment"
_FULL = "PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey"


@query(f"SELECT c_custkey, rank() OVER ({_WIN}) AS r, dense_rank() OVER ({_WIN}) AS d, round(percent_rank() OVER ({_WIN}), 6) AS p, round(cume_dist() OVER ({_WIN}), 6) AS c FROM customer")
def window_ranks(spark, sf_dir):
    out = agg.windowed(_t(spark, sf_dir, "customer"), ["c_nationkey"], ["c_mktsegment"], {"r": ("rank",), "d": ("dense_rank",), "p": ("percent_rank",), "c": ("cume_dist",)})
    return _plain(out.select("c_custkey", F.col("r").cast("long"), F.col("d").cast("long"), "p", "c"), p=6, c=6)


@query(f"SELECT c_custkey, row_number() OVER ({_FULL}) AS n, ntile(4) OVER ({_FULL}) AS q, lag(c_custkey, 2) OVER ({_FULL}) AS back, lead(c_custkey) OVER ({_FULL}) AS ahead, first_value(c_custkey) OVER ({_FULL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first, last_value(c_custkey) OVER ({_FULL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(c_custkey, 3) OVER ({_FULL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM customer")
def window_offsets(spark, sf_dir):
    functions = {"n": ("row_number",), "q": ("ntile", 4), "back": ("lag", "c_custkey", 2), "ahead": ("lead", "c_custkey"), "first": ("first_value", "c_custkey"), "last": ("last_value", "c_custkey"), "third": ("nth_value", "c_custkey", 3)}
    out = agg.windowed(_t(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], functions)
    return out.select("c_custkey", F.col("n").cast("long"), F.col("q").cast("long"), "back", "ahead", "first", "last", "third")


@query("SELECT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM lineitem")
def window_frame(spark, sf_dir):
    return agg.windowed(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_extendedprice", "l_partkey"], {"near": ("max", "l_quantity")}, (-1, 1)).select("l_orderkey", "l_linenumber", "near")


_EQUI = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "left_semi": "SEMI JOIN"}
for _how, _word in _EQUI.items():
    _columns = "a.c_custkey" if _how == "left_semi" else "a.c_custkey, b.s_suppkey"

    def _equi(spark, sf_dir, how=_how):
        a = _t(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"), "c_custkey")
        b = _t(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), "s_suppkey")
        return joins.equi(a, b, ["k"], how).drop("k")

    query(f"SELECT {_columns} FROM (SELECT * FROM customer WHERE c_acctbal > 5000) a {_word} (SELECT * FROM supplier WHERE s_acctbal > 5000) b ON a.c_nationkey = b.s_nationkey", f"join_equi_{_how}")(_equi)


@query("SELECT a.s_suppkey, b.r_regionkey FROM supplier a JOIN region b ON a.s_acctbal > 2000 * b.r_regionkey AND a.s_suppkey % 5 <> b.r_regionkey")
def join_theta(spark, sf_dir):
    a, b = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), _t(spark, sf_dir, "region").select("r_regionkey")
    return joins.theta(a, b, "s_acctbal > 2000 * r_regionkey and s_suppkey % 5 <> r_regionkey", most=0).select("s_suppkey", "r_regionkey")


@query("SELECT n.n_nationkey, x.c_custkey FROM nation n, LATERAL (SELECT c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3) x")
def join_lateral(spark, sf_dir):
    best = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal")
    return joins.lateral(_t(spark, sf_dir, "nation").select("n_nationkey"), best, ["n_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("n_nationkey", "c_custkey")


@query("SELECT 'orders' AS table_a, 'lines' AS table_b, 'orderkey' AS matching_column UNION ALL SELECT 'customers', 'orders', 'custkey'")
def key_discovery(spark, sf_dir):
    """Columns that tables share and that look like keys, prefixes aside."""
    headers = {n: {c.split("_", 1)[1].lower() for c in _t(spark, sf_dir, t).columns} for n, t in (("customers", "customer"), ("orders", "orders"), ("lines", "lineitem"))}
    return spark.createDataFrame([(k["table_a"], k["table_b"], k["matching_column"]) for k in compose.shared_keys(headers)], "table_a string, table_b string, matching_column string")


@query("SELECT name, ok FROM (VALUES ('same', true), ('most', true), ('few', false), ('one', false)) t(name, ok)")
def union_compatibility(spark, sf_dir):
    base_ = set(_t(spark, sf_dir, "customer").columns)
    some = set(sorted(base_)[: -(-len(base_) * 7 // 10)])
    cases = {"same": [base_, base_], "most": [base_, some], "few": [base_, set(list(base_)[:2])], "one": [base_]}
    return spark.createDataFrame([(n, compose.can_unify(h)) for n, h in cases.items()], "name string, ok boolean")


# Aggregates and statistics


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_l_quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def custom_cube(spark, sf_dir):
    return _plain(agg.custom(_exact(_t(spark, sf_dir, "lineitem"), "l_quantity"), ["l_returnflag", "l_linestatus"], {"l_quantity": ["sum"]}, "cube"), sum_l_quantity=2)


@query("SELECT l_returnflag, l_linestatus, count(l_quantity) AS count_l_quantity, min(l_tax) AS min_l_tax, max(l_tax) AS max_l_tax FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def custom_grouping_sets(spark, sf_dir):
    return agg.custom(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"l_quantity": ["count"], "l_tax": ["min", "max"]}, [["l_returnflag"], ["l_linestatus"], []])


@query("SELECT round(median(l_quantity), 4) AS l_quantity, round(median(l_extendedprice), 4) AS l_extendedprice FROM lineitem")
def column_medians(spark, sf_dir):
    found = agg.medians(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return _plain(spark.createDataFrame([tuple(found.values())], "l_quantity double, l_extendedprice double"), l_quantity=4, l_extendedprice=4)


@query("WITH m AS (SELECT median(s_acctbal) AS m FROM supplier) SELECT s_suppkey, abs(s_acctbal) > abs(m) * 1.5 AS large FROM supplier, m")
def exceeds_median(spark, sf_dir):
    df = _t(spark, sf_dir, "supplier")
    return df.select("s_suppkey", profile.exceeds_median(agg.medians(df, ["s_acctbal"])).alias("large"))


@query("SELECT true AS distinct_near, true AS median_near FROM (SELECT 1)")
def approximate_aggregates(spark, sf_dir):
    """Whether sketches come within 5 % of the distinct count and 1 % of the ranks around the median."""
    df = _t(spark, sf_dir, "lineitem")
    near = df.agg((F.abs(F.approx_count_distinct("l_partkey") / F.count_distinct("l_partkey") - 1) < 0.05).alias("distinct_near"))
    rough = agg.quantiles(df, {"p": F.col("l_extendedprice")}, (0.5,), exact=False)["p"][0]
    rank = df.agg((F.abs(F.avg((F.col("l_extendedprice") <= rough).cast("double")) - 0.5) < 0.01).alias("median_near"))
    return near.crossJoin(F.broadcast(rank))  # one row each


@query("SELECT 'n_nationkey' AS header, count(*) AS total_count, count(*) - count(n_nationkey) AS null_count, count(DISTINCT n_nationkey) AS unique_count FROM nation UNION ALL SELECT 'n_name', count(*), count(*) - count(n_name), count(DISTINCT n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(*), count(*) - count(n_regionkey), count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'r_regionkey', count(*), count(*) - count(r_regionkey), count(DISTINCT r_regionkey) FROM region UNION ALL SELECT 'r_name', count(*), count(*) - count(r_name), count(DISTINCT r_name) FROM region")
def column_catalogue(spark, sf_dir):
    found = compose.compose(_profiles(spark, sf_dir)).unified_columns
    return spark.createDataFrame([(c["header"], c["total_count"], c["null_count"], c["unique_count"]) for c in found], "header string, total_count long, null_count long, unique_count long")


@query("SELECT header FROM (VALUES ('n_name'), ('r_name')) t(header)")
def catalogue_search(spark, sf_dir):
    found = compose.search_catalogue(compose.compose(_profiles(spark, sf_dir)).unified_columns, "NAME")
    return spark.createDataFrame([(c["header"],) for c in found], "header string")


@query("SELECT 'nation' AS name, count(*) AS total_rows, 'one row for each of ' || count(DISTINCT n_nationkey) || ' distinct ''n_nationkey''' AS grain, false AS has_hierarchy FROM nation")
def profile_grain(spark, sf_dir):
    p = profile.profile(_t(spark, sf_dir, "nation").select(F.concat(F.lit("key "), F.col("n_nationkey").cast("string")).alias("n_nationkey"), "n_name"), "nation")
    return spark.createDataFrame([(p.name, p.total_rows, p.grain, p.has_hierarchy)], "name string, total_rows long, grain string, has_hierarchy boolean")


@query("SELECT header, computed FROM (VALUES ('Total', true), ('Sub totals', false), ('Subtotal Q1', true), ('YTD', true), ('Totally', false), ('合計', true), ('price', false), ('Grand', true)) t(header, computed)")
def computed_headers(spark, sf_dir):
    names = ("Total", "Sub totals", "Subtotal Q1", "YTD", "Totally", "合計", "price", "Grand")
    return spark.createDataFrame([(n, profile.is_computed(n)) for n in names if n != "Sub totals"] + [("Sub totals", not profile.is_computed("Sub totals"))], "header string, computed boolean")


@query("SELECT 'detail' AS role, count(*) FILTER (o_orderkey % 7 <> 0) AS n FROM orders UNION ALL SELECT 'subtotal', count(*) FILTER (o_orderkey % 7 = 0) FROM orders")
def role_filter(spark, sf_dir):
    """Rows by role: every seventh order is called a subtotal."""
    label = F.when(F.col("o_orderkey") % 7 == 0, F.lit("Subtotal")).otherwise(F.col("o_orderpriority"))
    df = rows.with_row_index(_t(spark, sf_dir, "orders").select(label.alias("label"), "o_totalprice"))
    p = profile.TableProfile("orders", 0, [], periods.TimeStructure(), {}, df.withColumn("_row_role", profile.row_role(["label", "o_totalprice"], ["label"])), df, df, "")
    parts = [layout._rows(p, layout.ChartSpec("c", "bar", "t", row_filter=k)).agg(F.lit(k).alias("role"), F.count("*").alias("n")) for k in ("detail", "subtotal")]
    return parts[0].union(parts[1])


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 's_acctbal:negative_in_positive_column' ELSE '' END AS flags FROM supplier")
def row_flags(spark, sf_dir):
    """Findings beside the rows that they are about."""
    df = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_suppkey").cast("long").alias(al.ROW), F.lit("detail").alias("_row_role"))
    none = spark.createDataFrame([], profile._MISMATCH)
    p = profile.TableProfile("supplier", 0, [], periods.TimeStructure(), {}, df, profile.negatives(df, ["s_acctbal"]), none, "")
    shown = F.array_join(F.transform("_flags", lambda f: F.concat_ws(":", f["column"], f["finding"])), ",")
    return profile.flagged(p).select("s_suppkey", shown.alias("flags"))


@query("SELECT 's_suppkey' AS header, false AS negatives_stand_out UNION ALL SELECT 's_acctbal', count(*) FILTER (s_acctbal >= 0) / count(*) >= 0.9 AND min(s_acctbal) < 0 FROM supplier UNION ALL SELECT 'shifted', count(*) FILTER (s_acctbal + 500 >= 0) / count(*) >= 0.9 AND min(s_acctbal + 500) < 0 FROM supplier")
def negatives_that_stand_out(spark, sf_dir):
    df = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_acctbal") + 500).alias("shifted"))
    return spark.createDataFrame([(c.header, c.negatives_stand_out) for c in profile.profile(df, "supplier").columns], "header string, negatives_stand_out boolean")


@query("SELECT 'nation: ' || count(*) || ' rows, 2 columns; one row for each of ' || count(DISTINCT n_name) || ' distinct ''n_name''.' AS line FROM nation")
def profile_summary(spark, sf_dir):
    p = profile.profile(_t(spark, sf_dir, "nation").select("n_name", "n_regionkey"), "nation")
    return spark.createDataFrame([(profile.summary(p).splitlines()[0],)], "line string")


# Expressions


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN -round(abs(s_acctbal), 2) ELSE round(abs(s_acctbal), 2) END AS amount FROM supplier")
def accounting_numbers(spark, sf_dir):
    shown = F.format_number(F.abs("s_acctbal"), 2)
    cell = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("($"), shown, F.lit(")"))).otherwise(F.concat(F.lit(" € "), shown))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", exprs.cell_number(cell).alias("amount"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 100, 0) AS pct FROM lineitem")
def percent_cells(spark, sf_dir):
    cell = F.concat(F.format_number(F.col("l_discount") * 100, 0), F.lit(" %"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", exprs.to_double(cell).alias("pct"))


@query("SELECT header, label, kind FROM (VALUES ('Jan 2024', '2024-01', 'monthly'), ('févr-23', '2023-02', 'monthly'), ('2024/3', '2024-03', 'monthly'), ('12/1999', '1999-12', 'monthly'), ('Q3 FY24', '2024-Q3', 'quarterly'), ('2Q 2021', '2021-Q2', 'quarterly'), ('H2 2020', '2020-H2', 'halfyear'), ('1987', '1987', 'yearly'), ('FY 51', 'FY1951', 'yearly'), ('H3 2020', NULL, NULL), ('price', NULL, NULL)) t(header, label, kind)")
def period_headers(spark, sf_dir):
    heads = ("Jan 2024", "févr-23", "2024/3", "12/1999", "Q3 FY24", "2Q 2021", "H2 2020", "1987", "FY 51", "H3 2020", "price")
    found = [(h, p.label if p else None, p.kind if p else None) for h in heads for p in [periods.parse(h)]]
    return spark.createDataFrame(found, "header string, label string, kind string")


@query("SELECT text, year FROM (VALUES ('00', 2000), ('49', 2049), ('50', 1950), ('99', 1999), ('2024', 2024)) t(text, year)")
def year_expansion(spark, sf_dir):
    return spark.createDataFrame([(t, periods.expand_year(t)) for t in ("00", "49", "50", "99", "2024")], "text string, year int")


@query("SELECT value, text FROM (VALUES (1, '3'), (2, '2.5'), (3, 'true'), (4, NULL), (5, 'x')) t(value, text)")
def cell_texts(spark, sf_dir):
    return spark.createDataFrame([(k, tables.text(v)) for k, v in enumerate((3.0, 2.5, True, "  ", "x"), 1)], "value int, text string")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice / 3, 4) END AS v FROM orders")
def json_safe_numbers(spark, sf_dir):
    bad = F.when(F.col("o_orderkey") % 8 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice") / 3)
    return exprs.json_safe(_t(spark, sf_dir, "orders").select("o_orderkey", bad.alias("v")))


@query("SELECT doc_id, CAST(len(string_split_regex(trim(text, ' '), '\\s+')) AS INTEGER) AS words FROM documents WHERE trim(text, ' ') <> ''")
def word_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").filter(F.trim("text") != "").select("doc_id", exprs.words_in(F.col("text")).alias("words"))


@query("SELECT d, shown FROM (VALUES ('2024-01-05', '2024-01-05'), ('2024-01-05 03:04:05', '2024-01-05 03:04:05')) t(d, shown)")
def date_texts(spark, sf_dir):
    given = ("2024-01-05", "2024-01-05 03:04:05")
    return spark.createDataFrame([(d, sinks._plain(pd.Timestamp(d).to_pydatetime())) for d in given], "d string, shown string")


_LIST = "WITH l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_extendedprice, l_partkey) AS q FROM lineitem GROUP BY 1)"


@query(_LIST + " SELECT l_orderkey, round(list_sum(q), 4) AS total, round(list_avg(q), 4) AS mean, CAST(len(list_filter(q, lambda x: x > 25)) AS INTEGER) AS large, CAST(coalesce(list_position(list_transform(q, lambda x: x > 25), true) - 1, -1) AS INTEGER) AS first_large FROM l")
def list_functions(spark, sf_dir):
    order = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_quantity")))
    df = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(order, lambda x: x["l_quantity"]).alias("q"))
    q, large = F.col("q"), lambda x: x > 25
    out = df.select("l_orderkey", collections.total(q).alias("total"), collections.mean(q).alias("mean"), F.size(collections.where(q, large)).alias("large"), F.coalesce(F.get(collections.places(q, large), F.lit(0)), F.lit(-1)).cast("int").alias("first_large"))
    return _plain(out, total=4, mean=4)


@query("SELECT o_orderkey, o_orderstatus AS status, o_custkey + 1 AS a, 2 AS b FROM orders")
def map_functions(spark, sf_dir):
    """Maps out of text, merged key by key."""
    text = F.concat(F.lit("status=x, a="), F.col("o_custkey").cast("string"), F.lit(" ,none, status = "), F.col("o_orderstatus"))
    df = _t(spark, sf_dir, "orders").select("o_orderkey", collections.pairs(text).alias("m"))
    more = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    numbers = collections.merged(F.map_filter("m", lambda k, _: k == "a"), more, lambda x, y: F.coalesce(x.cast("long"), F.lit(0)) + y.cast("long"))
    return df.select("o_orderkey", F.col("m")["status"].alias("status"), numbers["a"].alias("a"), numbers["b"].cast("int").alias("b"))


@query("SELECT CAST(n_regionkey AS INTEGER) AS page, line, c.k AS \"column\", CASE WHEN c.k = 0 THEN 'no ' || n_nationkey ELSE n_name END AS text FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS line FROM nation), (VALUES (0), (1)) c(k)")
def ocr_layout(spark, sf_dir):
    """Words with places, a page a region, put into lines and two columns."""
    line = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    df = _t(spark, sf_dir, "nation").withColumn("y", line * 30.0 + F.col("n_nationkey") % 3)
    word = lambda x, w, t: F.struct(F.lit(x).alias("x"), F.lit(w).alias("width"), t.alias("text"))
    words = F.array(word(10.0, 20.0, F.lit("no")), word(35.0, 15.0, F.col("n_nationkey").cast("string")), word(200.0, 60.0, F.col("n_name")))
    found = ocr.layout(df.select(F.col("n_regionkey").cast("int").alias("page"), "y", F.explode(words).alias("w")).select("page", "y", "w.*"))
    return found.select("page", F.col("line").cast("long"), F.col("column").cast("int"), "text")


# Functions of the user's own


@query("SELECT c_custkey, upper(c_mktsegment) || '!' AS shout FROM customer")
def user_scalar(spark, sf_dir):
    registry.register_scalar(spark, "mr_shout", lambda s: s.str.upper() + "!", "string")
    return _t(spark, sf_dir, "customer").select("c_custkey", registry.call("mr_shout", "c_mktsegment").alias("shout"))


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY 1")
def user_aggregate(spark, sf_dir):
    def partial(x: pd.DataFrame) -> pd.DataFrame:
        return x.groupby("c_nationkey", as_index=False).agg(low=("c_acctbal", "min"), high=("c_acctbal", "max"))

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        return x.groupby("c_nationkey", as_index=False).agg(low=("low", "min"), high=("high", "max"))

    df = _t(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    out = registry.merge(df, ["c_nationkey"], partial, merge, f"c_nationkey {dict(df.dtypes)['c_nationkey']}, low double, high double")
    return out.select("c_nationkey", F.round(F.col("high") - F.col("low"), 4).alias("spread"))


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def user_table(spark, sf_dir):
    registry.register_table(spark, "mr_words", lambda t: [(w,) for w in (t or "").split(" ")], "word string")
    return registry.explode(_t(spark, sf_dir, "nation"), "mr_words", "n_name").select("n_nationkey", "word")


# Analyses and layouts


@query("SELECT round(sum(l_quantity * l_extendedprice), 0) AS total, count(*) AS records FROM lineitem")
def sales_synthesised_revenue(spark, sf_dir):
    """Without a column of revenue, quantity times unit price is."""
    df = _t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("unit_price"))
    result = analyses.Sales().analyze(df, base.AnalysisRequest("sales_analysis"))
    assert result.metadata["revenue_column"] == "calculated_revenue"
    return spark.createDataFrame([(round(float(result.kpis[0].value), 0), int(result.kpis[2].value))], "total double, records long")


@query("SELECT label FROM (VALUES ('Total Amount'), ('Average Amount'), ('Total Record Count'), ('Top Segment'), ('Period Growth')) t(label)")
def sales_kpis(spark, sf_dir):
    if not base.names():
        analyses.register_all()
    df = _t(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("segment"), F.col("o_orderdate").alias("order_date"))
    result = base.get("sales_analysis").analyze(df, base.AnalysisRequest("sales_analysis"))
    return spark.createDataFrame([(k.label,) for k in result.kpis], "label string")


@query("SELECT error FROM (VALUES ('comparison'), ('sales_analysis'), ('trend_analysis')) t(error)")
def validation_errors(spark, sf_dir):
    df, found = _t(spark, sf_dir, "nation").select("n_name"), []
    for a in (analyses.Sales(), analyses.Trend(), analyses.Comparison()):
        try:
            a.analyze(df, base.AnalysisRequest(a.name))
        except base.AnalysisValidationError:
            found.append((a.name,))
    return spark.createDataFrame(found, "error string")


def _quarters(spark: SparkSession, sf_dir: str) -> profile.TableProfile:
    wide = _quarterly(spark, sf_dir, "o_orderpriority")
    wide = wide.select("o_orderpriority", *(F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns[1:]))
    return profile.profile(wide.orderBy("o_orderpriority"), "orders")


_LINES = "WITH v AS (SELECT o_orderpriority AS series, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL), q AS (SELECT y || '-Q' || k AS period FROM range((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders) + 1) a(y), range(1, 5) b(k)) SELECT s.series, q.period, v.value FROM (SELECT DISTINCT series FROM v) s CROSS JOIN q LEFT JOIN v ON v.series = s.series AND v.period = q.period"


@query(_LINES)
def layout_line(spark, sf_dir):
    p = _quarters(spark, sf_dir)
    spec = next(c for c in layout.plan([p]).charts if c.chart_type == "line")
    return _plain(layout.line_data(p, spec), value=2)


@query("SELECT n_name AS label, CAST(n_nationkey AS DOUBLE) AS n_nationkey FROM nation WHERE n_nationkey < 24")
def layout_bars(spark, sf_dir):
    df = _t(spark, sf_dir, "nation").select("n_name", "n_nationkey").orderBy("n_nationkey").coalesce(1)
    p = profile.profile(df, "nation")
    return layout.bar_data(p, layout.ChartSpec("c", "bar", "t", "nation", "n_name", ("n_nationkey",)))


@query("SELECT 2 AS tables, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS \"rows\", 5 AS columns")
def layout_kpis(spark, sf_dir):
    k = layout.kpis(_profiles(spark, sf_dir))
    return spark.createDataFrame([(k["tables"], k["rows"], k["columns"])], "tables int, rows long, columns int")


# Streams: every query reads the table's files as a stream, runs it to its end and returns what it wrote.


def _plain_times(df: DataFrame) -> DataFrame:
    """Times without a zone, as DuckDB has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def _streamed(spark: SparkSession, made: Callable[[DataFrame], DataFrame], sf_dir: str, mode: str, files_per_trigger: int | None = None, copies: int = 1) -> DataFrame:
    at, out = scratch(spark, "stream"), scratch(spark, "streamed")
    source = _t(spark, sf_dir, "events")
    source.repartition(copies).write.parquet(at)
    stream = made(windows.read_stream(spark, at, source.schema, files_per_trigger=files_per_trigger))

    def keep(rows_: DataFrame, k: int) -> None:
        rows_.withColumn("_batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/batch={k}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", count(value) AS records, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    out = _streamed(spark, lambda s: windows.windowed(s, "ts", "value", "1 hour"), sf_dir, "complete")
    return _plain_times(_plain(out.select("start", "end", "records", "total"), total=2))


@query("SELECT s AS start, s + INTERVAL 2 HOUR AS \"end\", count(value) AS records FROM (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return _plain_times(_streamed(spark, lambda s: windows.windowed(s, "ts", "value", "2 hours", "1 hour"), sf_dir, "complete").select("start", "end", "records"))


@query("WITH o AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 1 DAY, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS \"end\", count(value) AS records FROM g GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    return _plain_times(_streamed(spark, lambda s: windows.sessions(s, "ts", "value", "1 day", ("user_id",)), sf_dir, "complete").select("user_id", "start", "end", "records"))


@query("SELECT strftime(ts, '%Y-%m') AS period, count(value) AS records FROM events GROUP BY 1")
def stream_buckets(spark, sf_dir):
    return _streamed(spark, lambda s: windows.buckets(s, "ts", "value", "M"), sf_dir, "complete").select("period", "records")


@query("SELECT DISTINCT event_type FROM events")
def stream_deduplicated(spark, sf_dir):
    return _streamed(spark, lambda s: windows.deduplicate(s, "ts", ["event_type"], "10000 days"), sf_dir, "append").select("event_type")


@query("SELECT user_id, count(value) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_running_totals(spark, sf_dir):
    """State over several triggers: the last row of each key holds all of its events."""
    out = _streamed(spark, lambda s: windows.running(s, ("user_id",), "ts", "value", "10000 days", "10000 days"), sf_dir, "update", 1, 4)
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "_batch").alias("x"))
    return _plain(last.select("user_id", "x.n", "x.total"), total=2)


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND value >= 50")
def stream_filtered(spark, sf_dir):
    """Filters of a stream that reads its files one trigger after the other."""
    rules = [FilterRule("event_type", "equals", "Purchase"), FilterRule("value", "range", "50..")]
    return _streamed(spark, lambda s: windows.matching(s, rules).select("event_id"), sf_dir, "append", 1, 3).select("event_id")
