"""Table profiles: column types by evidence, row roles, anomalies, checks of computed columns, grain."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from . import periods
from .align import ROW, head, visible
from .rows import with_row_index

# Words of total rows, headers of computed columns, characters that cells may hold, currency signs, date shapes.
# Signs stand apart from words because word boundaries don't apply to them; the date shapes are one pattern, so a value is
# tested once.
TOTAL_WORDS = r"totals?|sub[\s\-]?totals?|grand\s?total|net\s?total|sum\s?total|sum|sous[\s\-]total|totaal|summe|suma|totale|total\s?geral|itog|totalt|того|итого|всего"
TOTAL_SIGNS = "合計|小計|总计|總計|합계"
GRAND_WORDS = r"grand\s?total|total\s?general|net\s?total|overall\s?total|grand\s?sum|总计|합계"
COMPUTED_WORDS = r"totals?|subtotals?|sum|ytd|h1|h2|full\s?year|annual|grand"
COMPUTED_SIGNS = "合計|总计|總計|합계"
ALLOWED = r"\w\s.,;:!?\-+=/\\()\[\]{}'\"@#$%^&*~`\x{A0}-\x{24F}\x{400}-\x{4FF}\x{600}-\x{6FF}\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{AC00}-\x{D7AF}\x{20A0}-\x{20CF}\x{2018}\x{2019}\x{201C}\x{201D}"
CURRENCY_SIGNS = "[$£€₹¥₩₦₴₱฿]"
DATE_SHAPES = r"(?i)^(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s\-]\d{2,4}|(?:q[1-4]|h[12])\s*(?:fy)?\d{2,4}|\d{1,2}/\d{4})$"
# The shares from which on evidence decides.
BOOLEAN, COMPLEX, DATE, NUMERIC, PERCENT, UNIQUE, FEW, POSITIVE = 0.85, 0.5, 0.6, 0.8, 0.4, 0.85, 0.2, 0.9
RUN, DELTA = 3, 0.01

_TOTAL = rf"(?iU)\b(?:{TOTAL_WORDS})\b|{TOTAL_SIGNS}"
_GRAND = rf"(?iU)(?:{GRAND_WORDS})"
#: Rows whose blanks are counted together before runs are joined.
CHUNK = 1_000_000


def is_computed(header: str) -> bool:
    return bool(re.search(rf"\b(?:{COMPUTED_WORDS})\b|{COMPUTED_SIGNS}", header, re.I))


@dataclass
class ColumnProfile:
    header: str
    inferred_type: str
    confidence: float
    null_count: int
    unique_count: int
    is_computed: bool
    sample_values: list[Any] = field(default_factory=list)
    negatives_stand_out: bool = False


@dataclass
class TableProfile:
    """rows: the table with _row_role; anomalies: (anomaly_type, row_index, column, raw_value, detail); mismatches:
    (row_index, row_description, column, source_value, recomputed_value, delta). These three are lazy."""

    name: str
    total_rows: int
    columns: list[ColumnProfile]
    time: periods.TimeStructure
    role_counts: dict[str, int]
    rows: DataFrame
    anomalies: DataFrame
    mismatches: DataFrame
    grain: str

    @property
    def has_hierarchy(self) -> bool:
        return any(r != "detail" and n for r, n in self.role_counts.items())

    def of_type(self, *kinds: str) -> list[ColumnProfile]:
        return [c for c in self.columns if c.inferred_type in kinds]


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def signals(df: DataFrame, names: list[str], exact: bool = True) -> list[dict[str, Any]]:
    """Counts of what the values of each column look like, from one aggregation and one distinct for all columns."""
    parts = []
    for c in names:
        v = F.trim(_text(c))
        full = ~exprs.blank(_text(c))
        number = F.when(full, exprs.finite(F.regexp_replace(exprs.accounting(v), "%$", "").try_cast("double")))
        date = v.rlike(DATE_SHAPES) | ((F.length(v) > 4) & v.rlike(r"\d") & number.isNull() & exprs.to_timestamp(v).isNotNull())
        count = lambda p, full=full: F.count_if(full & p)
        distinct = F.when(full, F.lower(v))
        parts.append(
            F.struct(
                F.lit(c).alias("column"), F.count_if(full).alias("total"), F.count("*").alias("rows"), F.count(number).alias("numbers"), count(F.contains(v, F.lit("%"))).alias("percents"), count(v.rlike(CURRENCY_SIGNS)).alias("currency"),
                count(date).alias("dates"), count(v.rlike(r"^(?:19|20)\d{2}$")).alias("years"), count(F.lower(v).isin("true", "false", "yes", "no", "t", "f")).alias("booleans"), count(v.rlike(r"(?s)^[\{\[].*[\}\]]$")).alias("complex"),
                F.min(number).alias("low"), F.max(number).alias("high"), F.count_if(number >= 0).alias("positive"), (F.lit(0).cast("long") if exact else F.approx_count_distinct(distinct)).alias("unique"),
            )
        )
    unique = distinct_counts(df, {c: F.when(~exprs.blank(_text(c)), F.lower(F.trim(_text(c)))) for c in names}) if exact else {}
    # a few columns at a time keep generated code small
    found: list[dict[str, Any]] = []
    for k in range(0, len(parts), 25):
        found += [r.asDict() for r in df.agg(F.array(*parts[k : k + 25]).alias("s")).select(F.inline("s")).collect()]
    return [s | {"unique": unique.get(s["column"], s["unique"])} for s in found]


def distinct_counts(df: DataFrame, columns: dict[str, Column]) -> dict[str, int]:
    """How many different values that aren't null each named column has.

    Each task sends a value of a column once, and the count is spread over all tasks; several count-distincts of one aggregate
    would send every row as many times as there are columns."""
    if not columns:
        return {}
    cells = F.array(*(F.struct(F.lit(k).alias("k"), c.cast("string").alias("v")) for k, c in enumerate(columns.values())))
    values = df.select(F.explode(F.filter(cells, lambda x: x["v"].isNotNull())).alias("x")).select("x.*").distinct()
    found = {r.k: r["count"] for r in values.groupBy("k").count().collect()}
    return {name: found.get(k, 0) for k, name in enumerate(columns)}


def decide(s: dict[str, Any], is_period: bool) -> tuple[str, float]:
    """(type, confidence) of a column from its signals; the first rule that holds."""
    n = s["total"]
    if is_period:
        return "time_period", 1.0
    if not n:
        return "free_text", 0.5
    share = {k: s[k] / n for k in ("numbers", "percents", "dates", "booleans", "complex", "unique")}
    numeric = share["numbers"] >= NUMERIC
    if share["booleans"] >= BOOLEAN:
        return "boolean", share["booleans"]
    if share["complex"] >= COMPLEX:
        return "complex", share["complex"]
    if share["dates"] >= DATE or s["years"] == n:
        return "date", max(share["dates"], s["years"] / n)
    if numeric and (share["percents"] >= PERCENT or (s["low"] >= -1.5 and s["high"] <= 1.5)):
        return "percentage", share["numbers"]
    if numeric:
        signed = s["currency"] or re.search(CURRENCY_SIGNS, s["column"])
        return ("currency" if signed else "numeric"), share["numbers"]
    if share["unique"] > UNIQUE:
        return "identifier", 0.75
    if share["unique"] <= FEW and n >= 3:
        return "category", 0.75
    return "free_text", 0.5


def row_role(names: list[str], label_columns: list[str] | None = None) -> Column:
    """detail, subtotal, grand_total or section_header, from the text of the row (or of its label columns)."""
    text = F.concat_ws(" ", *(_text(c) for c in label_columns or names))
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.trim(_text(c)).alias("v")) for k, c in enumerate(names)))
    full = F.filter(cells, lambda x: x["v"].isNotNull() & (x["v"] != ""))
    first = F.get(full, F.lit(0))
    is_text = exprs.cell_number(first["v"]).isNull() & ~F.lower(first["v"]).isin("true", "false")
    header = (F.size(full) > 0) & is_text & ((F.size(full) / len(names) <= 0.25) | ((F.size(full) == 1) & (first["k"] <= 1)))
    return F.when(text.rlike(_GRAND), "grand_total").when(text.rlike(_TOTAL), "subtotal").when(header, "section_header").otherwise("detail")


def exceeds_median(medians: dict[str, float | None], factor: float = 1.5) -> Column:
    """Whether any number of a row lies further from zero than factor times its column's median does: a mark of totals."""
    hits = [F.coalesce(F.abs(exprs.cell_number(_text(c))) > abs(m) * factor, F.lit(False)) for c, m in medians.items() if m]
    return reduce(Column.__or__, hits, F.lit(False))


def _finding(kind: str, column: Column, raw: Column, detail: Column, row: Column | None = None) -> list[Column]:
    return [F.lit(kind).alias("anomaly_type"), (F.col(ROW) if row is None else row).alias("row_index"), column.alias("column"), raw.cast("string").alias("raw_value"), detail.cast("string").alias("detail")]


def negatives(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Negative cells of detail rows in columns that are positive otherwise."""
    cells = F.array(*(F.struct(F.lit(c).alias("c"), _text(c).alias("v")) for c in columns))
    found = rows.filter("_row_role = 'detail'").select(ROW, F.explode(F.filter(cells, lambda x: exprs.cell_number(x["v"]) < 0)).alias("x"))
    return found.select(*_finding("negative_in_positive_column", F.col("x.c"), F.col("x.v"), F.lit("column is positive otherwise")))


def blank_runs(rows: DataFrame, columns: list[str], least: int = RUN, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of blank cells in each column. Runs are found within chunks of rows; only those that touch a chunk's edge,
    two a chunk and column at most, are then joined with their neighbours."""
    cells = F.array(*(F.struct(F.lit(c).alias("c"), exprs.blank(_text(c)).alias("b")) for c in columns))
    blanks = rows.select(ROW, F.explode(F.filter(cells, lambda x: x["b"])).alias("x")).select(ROW, F.col("x.c").alias("c"), F.floor(F.col(ROW) / chunk).alias("part"))
    place = F.row_number().over(Window.partitionBy("c", "part").orderBy(ROW))
    runs = blanks.withColumn("g", F.col(ROW) - place).groupBy("c", "part", "g").agg(F.min(ROW).alias("a"), F.max(ROW).alias("z"))
    edge = (F.col("a") == F.col("part") * chunk) | (F.col("z") == (F.col("part") + 1) * chunk - 1)
    order = Window.partitionBy("c").orderBy("a")
    joined = runs.filter(edge).withColumn("new", F.coalesce((F.col("a") != F.lag("z").over(order) + 1).cast("int"), F.lit(1)))
    joined = joined.withColumn("run", F.sum("new").over(order)).groupBy("c", "run").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    every = runs.filter(~edge).select("c", "a", "z").union(joined.select("c", "a", "z"))
    size = F.col("z") - F.col("a") + 1
    return every.filter(size >= least).select(*_finding("blank_run", F.col("c"), F.lit(None), size, F.col("a")))


def suspicious(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Cells with characters beyond the allowed ones."""
    odd = f"(?U)[^{ALLOWED}]"
    cells = F.array(*(F.struct(F.lit(c).alias("c"), _text(c).alias("v")) for c in columns))
    found = rows.select(ROW, F.explode(F.filter(cells, lambda x: F.coalesce(x["v"].rlike(odd), F.lit(False)))).alias("x"))
    marks = F.array_join(F.slice(F.regexp_extract_all(F.col("x.v"), F.lit(f"({odd})"), F.lit(1)), 1, 5), "")
    return found.select(*_finding("ocr_corruption", F.col("x.c"), F.col("x.v"), marks))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Detail rows whose folded cells equal those of an earlier one; detail is the first's row index."""
    print_ = F.concat_ws("|", *(F.coalesce(exprs.fold(F.col(f"`{c}`")), F.lit("")) for c in columns))
    marked = rows.filter("_row_role = 'detail'").select(ROW, print_.alias("print")).select(ROW, "print", F.xxhash64("print").alias("h"))
    first = marked.groupBy("h", "print").agg(F.min(ROW).alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = marked.join(first, ["h", "print"]).filter(F.col(ROW) > F.col("first"))
    return found.select(*_finding("duplicate_row", F.lit(None).cast("string"), F.col("print"), F.col("first")))


def mismatches(rows: DataFrame, computed: list[str], addends: list[str], describe: str, tolerance: float = DELTA) -> DataFrame:
    """Detail cells of computed columns that differ from the sum of the addends in their row."""
    total = reduce(Column.__add__, (F.coalesce(exprs.cell_number(_text(c)), F.lit(0.0)) for c in addends))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), exprs.cell_number(_text(c)).alias("source_value")) for c in computed))
    found = rows.filter("_row_role = 'detail'").select(F.col(ROW).alias("row_index"), _text(describe).alias("row_description"), total.alias("recomputed_value"), F.explode(cells).alias("x"))
    found = found.select("row_index", "row_description", "x.column", "x.source_value", "recomputed_value").withColumn("delta", F.col("source_value") - F.col("recomputed_value"))
    return found.filter(F.abs("delta") > tolerance)


_MISMATCH = "row_index long, row_description string, column string, source_value double, recomputed_value double, delta double"


def profile(df: DataFrame, name: str = "table", exact: bool = True, label_columns: list[str] | None = None) -> TableProfile:
    """The whole profile: one aggregation for all columns, one for the roles; findings stay lazy."""
    df = with_row_index(df)
    names = visible(df)
    time = periods.detect(names)
    rows = df.withColumn("_row_role", row_role(names, label_columns))
    first = head(df, 50).select(*(F.col(f"`{c}`") for c in names)).collect()
    columns = []
    for s in signals(df, names, exact):
        c = s["column"]
        kind, sure = decide(s, c in time.columns)
        samples = [r[c] for r in first if r[c] is not None and str(r[c]).strip()][:5]
        stand_out = kind in ("numeric", "currency") and s["numbers"] > 0 and s["positive"] / s["numbers"] >= POSITIVE and s["low"] < 0
        columns.append(ColumnProfile(c, kind, sure, s["rows"] - s["total"], s["unique"], is_computed(c), samples, stand_out))
    counts = {r._row_role: r["count"] for r in rows.groupBy("_row_role").count().collect()}
    found = [blank_runs(rows, names), suspicious(rows, names), duplicates(rows, names)]
    if odd := [c.header for c in columns if c.negatives_stand_out]:
        found.insert(0, negatives(rows, odd))
    computed = [c.header for c in columns if c.is_computed]
    addends = [c.header for c in columns if not c.is_computed and (c.inferred_type == "time_period" if time else c.inferred_type in ("numeric", "currency"))]
    describe = next((c.header for c in columns if c.inferred_type in ("identifier", "category")), names[0] if names else None)
    checks = mismatches(rows, computed, addends, describe) if computed and addends else df.sparkSession.createDataFrame([], _MISMATCH)
    out = TableProfile(name, sum(counts.values()), columns, time, counts, rows, reduce(DataFrame.union, found), checks, "")
    out.grain = grain(out)
    return out


def flagged(p: TableProfile) -> DataFrame:
    """The table's rows with _row_role and _flags: the findings of each row as (column, finding), the column null for whole rows.

    A row has no more findings than columns times kinds, so they are gathered by row."""
    found = p.anomalies.select(F.col("row_index").alias(ROW), F.struct("column", F.col("anomaly_type").alias("finding")).alias("f"))
    found = found.union(p.mismatches.select(F.col("row_index").alias(ROW), F.struct("column", F.lit("mismatch").alias("finding")).alias("f")))
    flags = found.groupBy(ROW).agg(F.sort_array(F.collect_set("f")).alias("_flags"))
    none = F.array().cast("array<struct<column:string,finding:string>>")
    return p.rows.join(flags, ROW, "left").withColumn("_flags", F.coalesce("_flags", none))


def grain(p: TableProfile) -> str:
    """What one row stands for, as far as names and counts tell."""
    detail = p.role_counts.get("detail", 0)
    if not detail:
        return "no detail rows"
    key = next(iter([*p.of_type("identifier"), *p.of_type("category"), *p.columns]))
    if p.time:
        return f"one row for each {key.header!r}, with {len(p.time.columns)} {p.time.kind} columns from {p.time.start} to {p.time.end}"
    if key.unique_count == detail:
        return f"one row for each of {detail} distinct {key.header!r}"
    return f"rows of {key.header!r}: {key.unique_count} distinct values in {detail} rows"


def summary(p: TableProfile, shown: int = 5) -> str:
    """A text for people: size, grain, types, roles and the first mismatches."""
    kinds = ", ".join(f"{c.header} ({c.inferred_type})" for c in p.columns)
    lines = [f"{p.name}: {p.total_rows} rows, {len(p.columns)} columns; {p.grain}.", f"Columns: {kinds}.", "Roles: " + ", ".join(f"{n} {r}" for r, n in sorted(p.role_counts.items())) + "."]
    lines += [f"Row {m.row_index}, {m.column}: {m.source_value:g} stands for {m.recomputed_value:g}." for m in p.mismatches.orderBy("row_index").limit(shown).collect()]
    return "\n".join(lines)
