"""Columns that hold lists and maps: figures of a list, lists by place, maps from pairs, merged and turned around."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(c: Column) -> Column:
    """The sum of a list of numbers; nulls in it count for nothing, an empty list gives 0, a null one null."""
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def mean(c: Column) -> Column:
    """The mean of a list's numbers; null without any."""
    full = F.filter(c, lambda x: x.isNotNull())
    return F.try_divide(total(full), F.size(full))


def where(c: Column, test: Callable[[Column], Column]) -> Column:
    """The entries that pass a test; null is no pass."""
    return F.filter(c, lambda x: F.coalesce(test(x), F.lit(False)))


def places(c: Column, test: Callable[[Column], Column]) -> Column:
    """Where in a list, from 0, the entries are that pass a test."""
    marked = F.transform(c, lambda x, i: F.struct(i.alias("i"), F.coalesce(test(x), F.lit(False)).alias("ok")))
    return F.transform(F.filter(marked, lambda m: m["ok"]), lambda m: m["i"])


def numbered(c: Column) -> Column:
    """A list as a map from place, from 0, to entry."""
    return F.map_from_entries(F.transform(c, lambda x, i: F.struct(i, x)))


def pairs(text: Column, sep: str = ",", mark: str = "=") -> Column:
    """A map out of text such as "a=1,b=2"; of equal keys the last one counts, pairs without a mark are left out."""
    parts = F.filter(F.transform(F.split(text, sep), lambda p: F.split(F.trim(p), mark, 2)), lambda p: F.size(p) == 2)
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.get(p, F.lit(0))).alias("k"), F.trim(F.get(p, F.lit(1))).alias("v")))
    placed = F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i")))
    last = F.filter(placed, lambda e: ~F.exists(placed, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def merged(a: Column, b: Column, how: Callable[[Column, Column], Column]) -> Column:
    """Two maps as one; how() joins the values of keys that either has, null where one lacks it."""
    return F.map_zip_with(a, b, lambda _, x, y: how(x, y))
