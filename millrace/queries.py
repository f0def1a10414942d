"""The engine's operators as queries over the driver's tables, each with the DuckDB SQL that gives the same rows.

Sums of money are taken over decimals so that both engines agree to the last bit; other floats are rounded."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs
from .operators import align as al
from .operators import compose, infer, joins, periods, profile, rows
from .operators.filters import FilterRule, apply
from .plans import aggregates as agg
from .sources import files, textual

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def money(c: str | Column) -> Column:
    """Two-place decimals, so that sums don't depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def _exact(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: money(c) for c in columns})


def _plain(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})


def _means(df: DataFrame) -> DataFrame:
    """total as a double, and average as its quotient: rounding would differ between engines where a mean is halfway."""
    total = F.round(F.col("total").cast("double"), 4)
    return df.withColumns({"total": total, "average": total / F.col("records")})


# Alignment


@query("SELECT o_orderkey AS id, CAST(o_orderstatus AS VARCHAR) AS status, CAST(round_even(o_totalprice, 0) AS BIGINT) AS total, o_orderdate AS placed FROM orders")
def align_select_rename_cast(spark, sf_dir):
    spec = al.AlignmentSpec([al.FieldMapping("o_orderkey", "id", "int"), al.FieldMapping("o_orderstatus", "status", "string"), al.FieldMapping("o_totalprice", "total", "int"), al.FieldMapping("o_orderdate", "placed"), al.FieldMapping("o_custkey", "x", keep=False)])
    return al.align(_t(spark, sf_dir, "orders"), spec).df


@query("SELECT 'brand' AS \"column\", CAST(NULL AS BIGINT) AS row_index, p_brand AS raw_value, 'int' AS target_type, 'cannot read ' || p_brand || ' as int' AS message FROM part WHERE p_brand <> '' AND TRY_CAST(regexp_replace(p_brand, '[$,€£¥%\\s]', '', 'g') AS DOUBLE) IS NULL")
def align_coercion_errors(spark, sf_dir):
    spec = al.AlignmentSpec([al.FieldMapping("p_partkey", "id", "int"), al.FieldMapping("p_brand", "brand", "int")])
    return al.align(_t(spark, sf_dir, "part"), spec).errors


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 6) AS given FROM lineitem")
def computed_column_revenue(spark, sf_dir):
    df = al.computed(_t(spark, sf_dir, "lineitem"), al.ComputedColumn("given", "l_extendedprice * l_discount"))
    return _plain(df.select("l_orderkey", "l_linenumber", "given"), given=6)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / NULLIF(l_discount, 0), 4) AS ratio FROM lineitem")
def computed_safe_division(spark, sf_dir):
    df = al.computed(_t(spark, sf_dir, "lineitem"), al.ComputedColumn("ratio", "l_extendedprice / l_discount"))
    return _plain(df.select("l_orderkey", "l_linenumber", "ratio"), ratio=4)


def _filtered(table: str, rule: FilterRule, *columns: str) -> Query:
    return lambda spark, sf_dir: apply(_t(spark, sf_dir, table), [rule]).select(*columns)


for _name, _table, _rule, _columns, _where in (
    ("filter_equals_ci", "orders", FilterRule("o_orderpriority", "equals", " 1-urgent "), ("o_orderkey", "o_orderpriority"), "lower(trim(o_orderpriority)) = '1-urgent'"),
    ("filter_equals_number", "lineitem", FilterRule("l_quantity", "equals", "17"), ("l_orderkey", "l_linenumber"), "l_quantity = 17"),
    ("filter_not_equals", "documents", FilterRule("lang", "not_equals", "EN"), ("doc_id", "lang"), "lower(trim(lang)) IS DISTINCT FROM 'en'"),
    ("filter_contains", "part", FilterRule("p_type", "contains", "brass|TIN"), ("p_partkey", "p_type"), "regexp_matches(p_type, '(?i)brass|tin')"),
    ("filter_in_list", "customer", FilterRule("c_mktsegment", "in_list", "building, Machinery"), ("c_custkey", "c_mktsegment"), "lower(trim(c_mktsegment)) IN ('building', 'machinery')"),
    ("filter_not_null", "events", FilterRule("props", "not_null"), ("event_id",), "props IS NOT NULL AND props <> ''"),
    ("filter_range_numeric", "lineitem", FilterRule("l_discount", "range", [0.02, 0.05]), ("l_orderkey", "l_linenumber", "l_discount"), "l_discount BETWEEN 0.02 AND 0.05"),
    ("filter_range_datetime", "orders", FilterRule("o_orderdate", "range", {"min": "1995-01-01", "max": "1996-06-30"}), ("o_orderkey", "o_orderdate"), "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'"),
    ("filter_range_string", "part", FilterRule("p_brand", "range", "Brand#2..Brand#4"), ("p_partkey", "p_brand"), "p_brand BETWEEN 'Brand#2' AND 'Brand#4'"),
):
    query(f"SELECT {', '.join(_columns)} FROM {_table} WHERE {_where}", _name)(_filtered(_table, _rule, *_columns))


@query("SELECT o_orderkey FROM orders WHERE lower(trim(o_orderstatus)) = 'f' AND o_totalprice >= 100000 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def filter_conjunction(spark, sf_dir):
    rules = [FilterRule("o_orderstatus", "equals", "F"), FilterRule("o_totalprice", "range", [100000, None]), FilterRule("o_orderdate", "range", "1995-01-01..")]
    return apply(_t(spark, sf_dir, "orders"), rules).select("o_orderkey")


# Sales


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(_t(spark, sf_dir, "orders"), "o_totalprice")


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average, count(*) AS records FROM orders")
def sales_totals(spark, sf_dir):
    return _means(agg.totals(_orders(spark, sf_dir), "o_totalprice"))


_SEGMENT = "SELECT {k}, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average, count(*) AS records FROM orders WHERE {k} IS NOT NULL GROUP BY {k}"


@query(_SEGMENT.format(k="o_custkey") + " ORDER BY total DESC, o_custkey LIMIT 10")
def sales_top_categories(spark, sf_dir):
    return _means(agg.segments(_orders(spark, sf_dir), "o_custkey", "o_totalprice").limit(10))


_LABEL = {
    "D": "strftime({d}, '%Y-%m-%d')", "W": "strftime(date_trunc('week', {d}), '%Y-%m-%d') || '/' || strftime(date_trunc('week', {d}) + INTERVAL 6 DAY, '%Y-%m-%d')",
    "M": "strftime({d}, '%Y-%m')", "Q": "year({d}) || 'Q' || quarter({d})", "Y": "strftime({d}, '%Y')",
}


def _bucket_sql(bucket: str, value: str = "CAST(o_totalprice AS DECIMAL(18,2))", date: str = "o_orderdate", table: str = "orders") -> str:
    return f"SELECT {_LABEL[bucket].format(d=date)} AS period, CAST(sum({value}) AS DOUBLE) AS total, CAST(sum({value}) AS DOUBLE) / count({value}) AS average, count({value}) AS records FROM {table} WHERE {date} IS NOT NULL GROUP BY 1"


_REVENUE = "(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))"


@query(_bucket_sql("M", _REVENUE, "l_shipdate", "lineitem"))
def sales_monthly(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select("l_shipdate", (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("revenue"))
    return _means(agg.buckets(df, "l_shipdate", "revenue", "M"))


def _trend(bucket: str) -> Query:
    return lambda spark, sf_dir: _means(agg.buckets(_orders(spark, sf_dir), "o_orderdate", "o_totalprice", bucket))


for _bucket, _name in (("D", "daily"), ("W", "weekly"), ("M", "monthly"), ("Q", "quarterly"), ("Y", "yearly")):
    query(_bucket_sql(_bucket), f"trend_{_name}")(_trend(_bucket))

_PERIODS = f"WITH p AS ({_bucket_sql('M')}), i AS (SELECT *, row_number() OVER (ORDER BY period) AS k FROM p)"


def _periods(spark: SparkSession, sf_dir: str, bucket: str = "M") -> DataFrame:
    return _means(agg.buckets(_orders(spark, sf_dir), "o_orderdate", "o_totalprice", bucket))


@query(_PERIODS + " SELECT arg_min(period, period) AS first_period, arg_max(period, period) AS last_period, round((arg_max(total, period) - arg_min(total, period)) / arg_min(total, period) * 100, 4) AS growth_pct FROM p")
def sales_growth(spark, sf_dir):
    p = _periods(spark, sf_dir)
    out = p.agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.min_by("total", "period").alias("a"), F.max_by("total", "period").alias("z"))
    return out.select("first_period", "last_period", F.round(exprs.share_pct(F.col("z") - F.col("a"), F.col("a")), 4).alias("growth_pct"))


_SEGMENTS = f"WITH s AS ({_SEGMENT.format(k='o_orderpriority')}), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, o_orderpriority) AS k, sum(total) OVER () AS whole FROM s)"


@query(_SEGMENTS + " SELECT o_orderpriority AS leader, total AS leader_total, round(total / whole * 100, 4) AS share_pct FROM r WHERE k = 1")
def sales_leader_share(spark, sf_dir):
    return _plain(agg.leader(_orders(spark, sf_dir), "o_orderpriority", "o_totalprice"), leader_total=2, share_pct=4).select("leader", "leader_total", "share_pct")


@query(_PERIODS + " SELECT count(*) AS n, round(regr_slope(total, k), 4) AS slope, round(round(regr_slope(total, k) / avg(total) * 100, 1), 1) AS slope_pct FROM i")
def trend_slope(spark, sf_dir):
    return _plain(agg.slope(_periods(spark, sf_dir)), slope=4, slope_pct=1).select("n", "slope", "slope_pct")


@query(_PERIODS + " SELECT CASE WHEN x > 3 THEN 'Upward / Growth' WHEN x < -3 THEN 'Downward / Decline' ELSE 'Stable' END AS direction FROM (SELECT round(regr_slope(total, k) / avg(total) * 100, 1) AS x FROM i)")
def trend_direction(spark, sf_dir):
    return agg.slope(_periods(spark, sf_dir)).select("direction")


@query(_PERIODS + " SELECT max(total) AS peak, (SELECT period FROM i ORDER BY total DESC, period LIMIT 1) AS peak_period, min(total) AS trough, (SELECT period FROM i ORDER BY total, period LIMIT 1) AS trough_period FROM i")
def trend_peak(spark, sf_dir):
    return agg.slope(_periods(spark, sf_dir)).select("peak", "peak_period", "trough", "trough_period")


@query(_PERIODS + " SELECT period, total, lag(total) OVER (ORDER BY period) AS previous, round((total - lag(total) OVER (ORDER BY period)) / lag(total) OVER (ORDER BY period) * 100, 4) AS change_pct FROM p")
def mom_growth(spark, sf_dir):
    return _plain(agg.changes(_periods(spark, sf_dir)), change_pct=4).select("period", "total", "previous", "change_pct")


@query(_PERIODS + " SELECT period, round(avg(total) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_average, round(sum(total) OVER (ORDER BY period), 2) AS running_total FROM p")
def moving_average(spark, sf_dir):
    return _plain(agg.moving_average(_periods(spark, sf_dir)), moving_average=4, running_total=2).select("period", "moving_average", "running_total")


# Comparison


@query(_SEGMENT.format(k="o_orderpriority"))
def comparison_segments(spark, sf_dir):
    return _means(agg.segments(_orders(spark, sf_dir), "o_orderpriority", "o_totalprice"))


@query(_SEGMENTS + " SELECT a.o_orderpriority AS leader, b.o_orderpriority AS runner_up, round(a.total - b.total, 2) AS variance, round((a.total - b.total) / b.total * 100, 4) AS variance_pct FROM r a, r b WHERE a.k = 1 AND b.k = 2")
def comparison_variance(spark, sf_dir):
    return _plain(agg.leader(_orders(spark, sf_dir), "o_orderpriority", "o_totalprice"), variance=2, variance_pct=4).select("leader", "runner_up", "variance", "variance_pct")


@query("SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'before' ELSE 'after' END AS phase, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average, count(*) AS records FROM orders GROUP BY 1")
def before_after(spark, sf_dir):
    return _means(agg.before_after(_orders(spark, sf_dir), "o_orderdate", "o_totalprice", "1996-01-01"))


# Statistics


def _stats_sql(table: str, columns: list[str], skew: bool) -> str:
    more = ", round(skewness({c}), 4) AS skew" if skew else ", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3"
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS \"count\"{more.format(c=c)} FROM {table}" for c in columns)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_stats_sql("lineitem", _LINE, False))
def summary_stats(spark, sf_dir):
    s = agg.statistics(_t(spark, sf_dir, "lineitem"), _LINE).select("column", "count", "mean", "median", "std", "min", "max", "q1", "q3")
    return _plain(s, **dict.fromkeys(("mean", "median", "std", "min", "max", "q1", "q3"), 4))


@query(_stats_sql("part", ["p_retailprice", "p_size"], True))
def summary_skew(spark, sf_dir):
    return _plain(agg.statistics(_t(spark, sf_dir, "part"), ["p_retailprice", "p_size"]), skew=4).select("column", "count", "skew")


@query("WITH s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem) SELECT CAST(least(floor((l_extendedprice - a) / ((z - a) / 10)), 9) AS INTEGER) AS bin, count(*) AS records FROM lineitem, s GROUP BY 1")
def histogram_price(spark, sf_dir):
    return agg.histogram(_t(spark, sf_dir, "lineitem"), "l_extendedprice").select("bin", "records").filter("records > 0")


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def outlier_iqr(spark, sf_dir):
    return agg.flag_outliers(_t(spark, sf_dir, "events"), "value").filter("_is_outlier").select("event_id", "value")


@query("WITH q AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) SELECT l_orderkey, l_linenumber FROM lineitem, q WHERE abs(l_extendedprice - m) > 2.0 * s")
def outlier_zscore(spark, sf_dir):
    return agg.flag_outliers(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "zscore", z=2.0).filter("_is_outlier").select("l_orderkey", "l_linenumber")


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), f AS (SELECT *, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS hit FROM events, q) SELECT count(value) AS valid, count(*) AS \"rows\", count(*) FILTER (hit) AS outliers, round(count(*) FILTER (hit) / count(*) * 100, 2) AS outlier_pct FROM f")
def outlier_counts(spark, sf_dir):
    return agg.outlier_summary(_t(spark, sf_dir, "events"), "value").select("valid", "rows", "outliers", "outlier_pct")


# Profiles


def _profile_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count({c}) FILTER (trim({c}::VARCHAR) <> '') AS total, count(DISTINCT lower(trim({c}::VARCHAR))) FILTER (trim({c}::VARCHAR) <> '') AS \"unique\" FROM {table}" for c in columns)


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(_profile_sql("customer", _CUSTOMER))
def profile_columns(spark, sf_dir):
    found = profile.signals(_t(spark, sf_dir, "customer"), _CUSTOMER)
    return spark.createDataFrame([(s["column"], s["rows"], s["total"], s["unique"]) for s in found], "column string, rows long, total long, unique long")


@query("SELECT 'n_nationkey' AS \"column\", 'numeric' AS inferred_type UNION ALL SELECT 'n_name', CASE WHEN (SELECT count(DISTINCT n_name) / count(*) FROM nation) > 0.85 THEN 'identifier' ELSE 'free_text' END UNION ALL SELECT 'n_regionkey', 'numeric'")
def column_types(spark, sf_dir):
    found = profile.signals(df := _t(spark, sf_dir, "nation"), df.columns)
    return spark.createDataFrame([(s["column"], profile.decide(s, False)[0]) for s in found], "column string, inferred_type string")


def _group(how: str) -> Query:
    return lambda spark, sf_dir: _plain(agg.group_by(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", how), value=4)


for _how in ("sum", "avg", "count", "min", "max"):
    query(f"SELECT l_returnflag, round(CAST({_how}(l_quantity) AS DOUBLE), 4) AS value FROM lineitem GROUP BY 1", f"group_by_dynamic_{_how}")(_group(_how))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_l_quantity, count(DISTINCT l_suppkey) AS distinct_l_suppkey FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def custom_rollup(spark, sf_dir):
    df = _exact(_t(spark, sf_dir, "lineitem"), "l_quantity")
    return _plain(agg.custom(df, ["l_returnflag", "l_linestatus"], {"l_quantity": ["sum"], "l_suppkey": ["distinct"]}, "rollup"), sum_l_quantity=2)


@query("SELECT * FROM nation WHERE contains(lower(n_nationkey || chr(1) || n_name || chr(1) || n_regionkey), 'an')")
def full_row_search(spark, sf_dir):
    return rows.search(_t(spark, sf_dir, "nation"), "AN")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50")
def sort_page(spark, sf_dir):
    df = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return rows.page(rows.sort_rows(df, "p_retailprice", True, "p_partkey"), 2, 25)


@query("SELECT 'customer' AS _source_table, c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return rows.union({"customer": a, "supplier": b})


@query("SELECT count(DISTINCT v) AS n FROM (SELECT lower(trim(c_mktsegment)) AS v FROM customer UNION ALL SELECT lower(trim(c_nationkey::VARCHAR)) FROM customer)")
def distinct_categories(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select(F.explode(F.array(exprs.fold(F.col("c_mktsegment")), exprs.fold(F.col("c_nationkey")))).alias("v"))
    return df.agg(F.count_distinct("v").alias("n"))


_CELLS = "SELECT 3 * count(*) AS cells, count(*) FILTER (trim(p_name) = '' OR p_name IS NULL) + count(*) FILTER (trim(p_brand) = '' OR p_brand IS NULL) + count(*) FILTER (p_size IS NULL) AS nulls FROM part"


@query(f"SELECT round((cells - nulls) / cells * 100, 1) AS completeness_pct, round(100 - 25 * nulls / cells, 1) AS health_score FROM ({_CELLS})")
def completeness_and_health(spark, sf_dir):
    names = ["p_name", "p_brand", "p_size"]
    found = profile.signals(_t(spark, sf_dir, "part"), names)
    cells, full = sum(s["rows"] for s in found), sum(s["total"] for s in found)
    return spark.createDataFrame([(compose.completeness(cells, cells - full), compose.health(cells, cells - full, 0, 0))], "completeness_pct double, health_score double")


@query("SELECT count(DISTINCT c.c_nationkey) FILTER (n.n_nationkey IS NOT NULL) / count(DISTINCT c.c_nationkey) AS share FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def key_containment(spark, sf_dir):
    a, b = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return spark.createDataFrame([(compose.containment(a, b, "k"),)], "share double")


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


_ROLE_TEXT = "doc_id || ' ' || text"
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: The words as the rule has them, apart from profile's, so that a wrong one there shows.
_GRAND_SQL = r"(?i)(?:grand\s?total|total\s?general|net\s?total|overall\s?total|grand\s?sum|总计|합계)"
_TOTALS_SQL = rf"(?i){_B}(?:totals?|sub[\s\-]?totals?|grand\s?total|net\s?total|sum\s?total|sum|sous[\s\-]total|totaal|summe|suma|totale|total\s?geral|itog|totalt|того|итого|всего){_E}|合計|小計|总计|總計|합계"


@query(f"SELECT doc_id, CASE WHEN regexp_matches({_ROLE_TEXT}, '{_GRAND_SQL}') THEN 'grand_total' WHEN regexp_matches({_ROLE_TEXT}, '{_TOTALS_SQL}') THEN 'subtotal' ELSE 'detail' END AS _row_role FROM documents")
def row_roles(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", profile.row_role(["doc_id", "text"]).alias("_row_role"))


def _detail(df: DataFrame, order: str) -> DataFrame:
    return df.withColumns({al.ROW: F.col(order).cast("long"), "_row_role": F.lit("detail")})


@query("SELECT s_suppkey AS row_index, 's_acctbal' AS \"column\", s_acctbal AS amount FROM supplier WHERE s_acctbal < 0")
def negative_in_positive(spark, sf_dir):
    found = profile.negatives(_detail(_t(spark, sf_dir, "supplier"), "s_suppkey"), ["s_acctbal"])
    return found.select("row_index", "column", F.col("raw_value").cast("double").alias("amount"))


@query("WITH b AS (SELECT event_id, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE value < 30) SELECT min(event_id) AS row_index, CAST(count(*) AS VARCHAR) AS detail FROM b GROUP BY g HAVING count(*) >= 3")
def blank_runs(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("value") >= 30, F.col("value")).alias("v"))
    return profile.blank_runs(_detail(df, "event_id"), ["v"]).select("row_index", "detail")


@query("WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(trim(text))) AS first FROM documents) SELECT doc_id AS row_index, CAST(first AS VARCHAR) AS detail FROM d WHERE doc_id > first")
def duplicate_rows(spark, sf_dir):
    return profile.duplicates(_detail(_t(spark, sf_dir, "documents"), "doc_id"), ["text"]).select("row_index", "detail")


_ODD = r"[^\p{L}\p{M}\p{N}_\s.,;:!?\-+=/\\()\[\]{}'\"@#$%^&*~`\x{A0}-\x{24F}\x{3000}-\x{303F}\x{20A0}-\x{20CF}\x{2018}\x{2019}\x{201C}\x{201D}]"


@query(f"SELECT doc_id AS row_index FROM documents WHERE regexp_matches(text, '{_re2(_ODD)}')")
def suspicious_chars(spark, sf_dir):
    return profile.suspicious(_detail(_t(spark, sf_dir, "documents"), "doc_id"), ["text"]).select("row_index")


@query("SELECT l_orderkey AS row_index, round(l_extendedprice, 4) AS source_value, round(l_quantity + l_tax, 4) AS recomputed_value FROM lineitem WHERE abs(l_extendedprice - (l_quantity + l_tax)) > 0.01")
def mismatch_check(spark, sf_dir):
    df = _detail(_t(spark, sf_dir, "lineitem"), "l_orderkey")
    found = profile.mismatches(df, ["l_extendedprice"], ["l_quantity", "l_tax"], "l_partkey")
    return _plain(found.select("row_index", "source_value", "recomputed_value"), source_value=4, recomputed_value=4)


@query("SELECT o_orderstatus, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL")
def wide_to_long(spark, sf_dir):
    """A table with a column for each quarter, whose headers are read as periods, turned into rows."""
    wide = _quarterly(spark, sf_dir, "o_orderstatus")
    long = periods.to_long(wide, periods.detect(wide.columns), ["o_orderstatus"])
    return _plain(long.filter("value is not null"), value=2)


def _quarterly(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Totals of orders by a key, with a column for each quarter from the first to the last year."""
    df = _orders(spark, sf_dir)
    first, last = df.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    heads = [f"Q{q} {y}" for y in range(first, last + 1) for q in (1, 2, 3, 4)]
    header = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string"))
    return df.groupBy(key, header.alias("h")).agg(F.sum("o_totalprice").alias("v")).groupBy(key).pivot("h", heads).agg(F.first("v"))


@query("SELECT 's_suppkey' AS name, 'int' AS dtype, 'numeric' AS semantic_label, count(DISTINCT s_suppkey) AS unique_count, CAST(min(s_suppkey) AS DOUBLE) AS min_val FROM supplier UNION ALL SELECT 's_name', 'string', 'name', count(DISTINCT s_name), NULL FROM supplier UNION ALL SELECT 's_nationkey', 'int', 'numeric', count(DISTINCT s_nationkey), CAST(min(s_nationkey) AS DOUBLE) FROM supplier UNION ALL SELECT 's_acctbal', 'float', 'numeric', count(DISTINCT s_acctbal), min(s_acctbal) FROM supplier")
def schema_detect(spark, sf_dir):
    found = infer.detect(_t(spark, sf_dir, "supplier")).columns
    return spark.createDataFrame([(c.name, c.dtype, c.semantic_label, c.unique_count, c.min_val) for c in found], "name string, dtype string, semantic_label string, unique_count long, min_val double")


# Text-like sources


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) SELECT doc_id, CAST(k AS BIGINT) AS line_no, CAST(len(string_split_regex(trim(line), '\s+')) AS BIGINT) AS word_count, CAST(length(trim(line)) AS BIGINT) AS char_count FROM l WHERE trim(line) <> ''")
def text_lines(spark, sf_dir):
    return files.text_lines(_t(spark, sf_dir, "documents"), "text").select("doc_id", "line_no", "word_count", "char_count")


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_flatten(spark, sf_dir):
    pairs = F.from_json("props", "map<string,string>")
    return _t(spark, sf_dir, "events").select("event_id", F.explode(pairs).alias("key", "value"))


_BARE = r"regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g')"
_MARKED = rf"regexp_replace(regexp_replace({_BARE}, '(?i)<(li|p)(\s[^>]*)?>', chr(1), 'g'), '(?i)</(li|p)>', chr(2), 'g')"
_ITEM = "string_split(x, chr(2))[1]"
_ITEM = rf"trim(replace(replace(replace(replace(regexp_replace({_ITEM}, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&'), ' ' || chr(10) || chr(9) || chr(13))"


@query(rf"WITH p AS (SELECT page_id, unnest(string_split({_MARKED}, chr(1))[2:]) AS x, generate_subscripts(string_split({_MARKED}, chr(1))[2:], 1) AS k FROM pages), c AS (SELECT page_id, k, {_ITEM} AS content FROM p) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS item_no, content, CAST(len(string_split_regex(content, '\s+')) AS BIGINT) AS word_count FROM c WHERE content <> ''")
def html_items(spark, sf_dir):
    """Items and tables of every page, through the file parser."""
    def run(batches):
        for b in batches:
            out = []
            for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in textual.read_html((html or "").encode(), "page").tables:
                    out += [(page, line, cells[1], int(cells[2])) for line, _, cells in t.rows]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["page_id", "item_no", "content", "word_count"])

    return _t(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id long, item_no long, content string, word_count long")


_LOG = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query(f"SELECT event_id, {_LOG} AS timestamp, 'WARN' AS level, event_type AS module, 'user ' || user_id AS message FROM events")
def log_parse(spark, sf_dir):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" [warn] "), F.col("event_type"), F.lit(": user "), F.col("user_id").cast("string"))
    return files.parse_log(_t(spark, sf_dir, "events").select("event_id", line.alias("value"))).drop("value")


@query("SELECT o_orderkey, 'status.' || o_orderkey AS key, o_orderstatus AS setting FROM orders")
def kv_parse(spark, sf_dir):
    line = F.concat(F.lit("status."), F.col("o_orderkey").cast("string"), F.lit(" = '"), F.col("o_orderstatus"), F.lit("'"))
    return files.parse_key_values(_t(spark, sf_dir, "orders").select("o_orderkey", line.alias("value"))).drop("value")


@query("SELECT p_partkey, p_name AS name, p_brand AS brand FROM part")
def markdown_parse(spark, sf_dir):
    df = _t(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.concat(F.lit("| "), F.col("p_name"), F.lit(" | "), F.col("p_brand"), F.lit(" |")), F.lit("|---|:-:|"), F.lit("text"))).alias("value"))
    return files.parse_markdown(df).select("p_partkey", F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(1)).alias("brand"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def turns_per_role(spark, sf_dir):
    return agg.custom(_t(spark, sf_dir, "conversations"), ["role"], {"turn": ["count"], "conv_id": ["distinct"]}).toDF("role", "turns", "conversations")


@query("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 150000")
def join_tables(spark, sf_dir):
    orders = apply(_t(spark, sf_dir, "orders"), [FilterRule("o_totalprice", "range", "150000.0001..")]).withColumnRenamed("o_custkey", "c_custkey")
    customers, nations = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.equi(joins.equi(orders, customers, ["c_custkey"]), nations, ["c_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def join_anti(spark, sf_dir):
    rich = _t(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("s_nationkey")).distinct()
    return joins.equi(_t(spark, sf_dir, "supplier"), rich, ["s_nationkey"], "left_anti").select("s_suppkey")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 2 AND s_acctbal + 2")
def join_range(spark, sf_dir):
    ranges = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 2).alias("low"), (F.col("s_acctbal") + 2).alias("high"))
    return joins.in_range(_t(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "low", "high", 4.0).select("p_partkey", "s_suppkey")


@query("SELECT a.event_id, b.event_id AS purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_as_of(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase"))
    return joins.as_of(events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "ts", ["user_id"], ["purchase"]).select("event_id", "purchase")


from . import queries_engine  # noqa: E402, F401  it adds its own
