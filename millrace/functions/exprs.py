"""Scalar expressions: lenient casts, period labels, safe arithmetic, adjusted moments. All stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that numbers may carry and that casts ignore (fixed values).
SYMBOLS = r"[$,€£¥%\s]"
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f")

#: Shapes of dates and the formats that fit them, in the order in which they are tried: ISO, month first, day first, named
#: months; missing parts are the first. Text of no shape costs one test and no parsing.
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}", ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-M-d")),
    (r"^\d{4}/\d{1,2}/\d{1,2}", ("yyyy/M/d", "yyyy/M/d H:mm:ss")),
    (r"^\d{1,2}/\d{1,2}/\d{4}", ("M/d/yyyy", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "d/M/yyyy")),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", ("M/d/yy",)),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("M-d-yyyy", "d-M-yyyy")),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ("M.d.yyyy", "d.M.yyyy")),
    (r"^\d{1,2}[ -][A-Za-z]{3,9}[ -]\d{4}$", ("d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy")),
    (r"^[A-Za-z]{3,9} \d{1,2},? \d{4}$", ("MMM d, yyyy", "MMM d yyyy", "MMMM d, yyyy", "MMMM d yyyy")),
    (r"^[A-Za-z]{3,9}[ -]\d{4}$", ("MMM yyyy", "MMM-yyyy", "MMMM yyyy")),
    (r"^\d{4}-\d{2}$", ("yyyy-MM",)),
    (r"^\d{8}$", ("yyyyMMdd",)),
)

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, name: str) -> bool:
    """Numbers; booleans are not."""
    return isinstance(df.schema[name].dataType, NUMERIC)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.DateType | T.TimestampType | T.TimestampNTZType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def blank(c: Column) -> Column:
    """Null or only white space."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def strip_symbols(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), SYMBOLS, "")


def accounting(c: Column) -> Column:
    """Text of a number with symbols stripped and (500) read as -500."""
    return F.regexp_replace(strip_symbols(c), r"^\((.*)\)$", "-$1")


def to_double(c: Column) -> Column:
    return finite(strip_symbols(c).try_cast("double"))


def to_bigint(c: Column) -> Column:
    """Rounded half to even."""
    return F.bround(to_double(c)).try_cast("bigint")


def cell_number(c: Column) -> Column:
    """A cell's number, accounting negatives included."""
    return finite(accounting(c).try_cast("double"))


def to_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_timestamp(c: Column) -> Column:
    """The first format that fits; to the second."""
    # month names in any case; the T of ISO times stays upper case; fractions of seconds go
    text = F.regexp_replace(F.initcap(F.trim(c.cast("string"))), r"(\d)t(\d)", "$1T$2")
    text = F.regexp_replace(text, r"(:\d{2})\.\d+", "$1")
    found = F.lit(None).cast("timestamp")
    for shape, formats in reversed(DATE_SHAPES):
        parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
        found = F.when(text.rlike(shape), parsed).otherwise(found)
    return F.date_trunc("second", found)


def as_timestamp(df: DataFrame, name: str) -> Column:
    """A temporal column as it is, any other parsed."""
    return F.col(name).cast("timestamp") if is_temporal(df, name) else to_timestamp(F.col(name))


def as_number(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if is_numeric(df, name) else to_double(F.col(name))


def fold(c: Column) -> Column:
    """Text for comparisons without case and outer space."""
    return F.lower(F.trim(c.cast("string")))


def period_label(ts: Column, bucket: str) -> Column:
    """The calendar bucket of a time: D 2026-01-04, W 2025-12-29/2026-01-04, M 2026-01, Q 2026Q1, Y 2026."""
    day = F.to_date(ts)
    if bucket == "D":
        return F.date_format(day, "yyyy-MM-dd")
    if bucket == "W":
        monday = F.date_trunc("week", day).cast("date")
        return F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"))
    if bucket == "Q":
        return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
    return F.date_format(day, "yyyy" if bucket == "Y" else "yyyy-MM")


def safe_divide(a: Column, b: Column) -> Column:
    """Null where b is zero."""
    return F.try_divide(a, b)


def share_pct(part: Column, whole: Column) -> Column:
    """Percent of a whole; 0 unless the whole is positive."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def adjusted_skew(c: Column) -> Column:
    """Bias-adjusted sample skewness; 0 for fewer than three values."""
    n = F.count(c)
    # a constant column has no skew
    return F.when(n > 2, F.coalesce(F.nanvl(F.skewness(c), F.lit(0.0)), F.lit(0.0)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))).otherwise(F.lit(0.0))


def bin_of(c: Column, low: Column, high: Column, bins: Column) -> Column:
    """The equal-width bin, from 0; the last one is closed. If low equals high, bins span half a unit to each side."""
    a = F.when(low == high, low - 0.5).otherwise(low)
    b = F.when(low == high, high + 0.5).otherwise(high)
    return F.least(F.floor((c - a) / ((b - a) / bins)), bins - 1).cast("int")


def json_safe(df: DataFrame, digits: int = 4) -> DataFrame:
    """Rows for previews: NaN and infinities become null, floats are rounded."""
    out = [F.round(finite(F.col(f"`{f.name}`")), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*out)


def words_in(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))


def sanitize_names(names: list[str]) -> list[str]:
    """Trimmed names; blank or unnamed ones become column_N, repeated ones get _1, _2, and no two are equal."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for k, raw in enumerate(names, 1):
        base = str(raw).strip() if raw is not None else ""
        base = f"column_{k}" if not base or base.startswith("Unnamed:") else base
        name = base
        while name in seen:
            seen[base] += 1
            name = f"{base}_{seen[base]}"
        seen.setdefault(base, 0)
        seen.setdefault(name, 0)
        out.append(name)
    return out


def suggest_name(name: str) -> str:
    """A field name: lower case, separators as underscores, anything else dropped."""
    return re.sub(r"[^a-z0-9_]", "", re.sub(r"[\s\-./]+", "_", name.strip().lower()))
