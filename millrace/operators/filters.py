"""Filter rules: declarative predicates that become one filter; rules side by side must all hold, AnyOf and Not nest."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs


@dataclass(frozen=True)
class FilterRule:
    """operator: not_null, equals, not_equals, contains, range or in_list."""

    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class AnyOf:
    """At least one of the rules holds."""

    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class AllOf:
    """All of the rules hold."""

    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class Not:
    """The rule doesn't hold; where it is null, neither does it."""

    rule: Rule


Rule = FilterRule | AnyOf | AllOf | Not


def _number(value: Any) -> float | None:
    try:
        return float(str(value).strip())
    except ValueError:
        return None


def bounds(value: Any) -> tuple[Any, Any]:
    """(low, high) of [low, high], {min, max} or 'low..high'; a missing bound is None."""
    if isinstance(value, dict):
        low, high = value.get("min"), value.get("max")
    elif isinstance(value, str) and ".." in value:
        low, high = (x.strip() for x in value.split("..", 1))
    elif isinstance(value, list | tuple):
        low, high = (*value, None, None)[:2]
    else:
        low, high = value, None
    return (None if low in ("", None) else low), (None if high in ("", None) else high)


def _same(df: DataFrame, name: str, value: Any) -> Column:
    """Equality without case and outer space for text, by number for numbers; null for null."""
    c = F.col(name)
    if exprs.is_numeric(df, name):
        number = _number(value)
        return (c == F.lit(number)) if number is not None else F.when(c.isNotNull(), F.lit(False))
    if exprs.is_temporal(df, name) and isinstance(value, str):
        return c.cast("timestamp") == exprs.to_timestamp(F.lit(value))
    if isinstance(value, str) or exprs.is_text(df, name):
        return exprs.fold(c) == str(value).strip().lower()
    return c == F.lit(value)


def _range(df: DataFrame, name: str, value: Any) -> Column:
    low, high = bounds(value)
    c = F.col(name)
    if exprs.is_numeric(df, name):
        low, high = (None if x is None else F.lit(float(x)) for x in (low, high))
    elif exprs.is_temporal(df, name):
        c = c.cast("timestamp")
        low, high = (None if x is None else exprs.to_timestamp(F.lit(str(x))) for x in (low, high))
    else:
        c = c.cast("string")
        low, high = (None if x is None else F.lit(str(x)) for x in (low, high))
    out = F.lit(True) if low is None and high is None else c.isNotNull()
    out = out if low is None else out & (c >= low)
    return out if high is None else out & (c <= high)


def predicate(df: DataFrame, rule: Rule) -> Column | None:
    """The rule as a column; None for unknown columns and operators, which filter nothing."""
    if isinstance(rule, AnyOf | AllOf):
        parts = [p for r in rule.rules if (p := predicate(df, r)) is not None]
        return reduce(Column.__or__ if isinstance(rule, AnyOf) else Column.__and__, parts) if parts else None
    if isinstance(rule, Not):
        p = predicate(df, rule.rule)
        return None if p is None else ~F.coalesce(p, F.lit(False))
    if rule.column not in df.columns:
        warnings.warn(f"filter on unknown column {rule.column!r} is ignored", stacklevel=2)
        return None
    name, value = rule.column, rule.value
    c = F.col(name)
    kind = rule.operator.strip().lower()
    if kind == "not_null":
        return c.isNotNull() & (c != "") if exprs.is_text(df, name) else c.isNotNull()
    if kind == "equals":
        return _same(df, name, value)
    if kind == "not_equals":
        differs = ~_same(df, name, value)
        return F.coalesce(differs, F.lit(True)) if isinstance(value, str) else differs
    if kind == "contains":
        return c.cast("string").rlike(f"(?iu){value}")
    if kind == "range":
        return _range(df, name, value)
    if kind == "in_list":
        values = value.split(",") if isinstance(value, str) else value if isinstance(value, list | tuple | set) else [value]
        if exprs.is_numeric(df, name):
            numbers = [n for v in values if (n := _number(v)) is not None]
            return c.isin(*numbers) if numbers else F.lit(False)
        return exprs.fold(c).isin(*(str(v).strip().lower() for v in values))
    return None


def _renamed(rule: Rule, columns: list[str], renamed: dict[str, str]) -> Rule:
    if isinstance(rule, AnyOf | AllOf):
        return type(rule)(tuple(_renamed(r, columns, renamed) for r in rule.rules))
    if isinstance(rule, Not):
        return Not(_renamed(rule.rule, columns, renamed))
    known = rule.column in columns or rule.column not in renamed
    return rule if known else FilterRule(renamed[rule.column], rule.operator, rule.value)


def apply(df: DataFrame, rules: list[Rule], renamed: dict[str, str] | None = None) -> DataFrame:
    """All rules in one filter; a rule may name a column by its source name, if renamed (source to target) has it."""
    found = predicate(df, AllOf(tuple(_renamed(r, df.columns, renamed or {}) for r in rules)))
    return df if found is None else df.filter(found)
