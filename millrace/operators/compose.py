"""Data sets of several tables: completeness, health, union compatibility, shared keys, one catalogue of columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import TableProfile

#: Parts of names that make a shared column a key, the share of columns that unions need, the longest report.
KEY_WORDS = ("id", "key", "code", "uuid", "num", "no", "sku", "email", "account")
UNION_SHARE, MOST_KEYS = 0.7, 10


@dataclass
class Composition:
    health_score: float
    completeness_pct: float
    total_records: int
    unified_columns: list[dict[str, Any]]
    can_unify: bool
    relationships: list[dict[str, str]]
    insights: list[str] = field(default_factory=list)


def completeness(cells: int, nulls: int) -> float:
    """Percent of cells that are filled; 100 without cells."""
    return round((cells - nulls) / cells * 100, 1) if cells else 100.0


def health(cells: int, nulls: int, anomalies: int, mismatches: int, unparsed: int = 0) -> float:
    """100 less penalties: up to 25 each for nulls, anomalies and mismatches, up to 15 for unparsed rows."""
    score = 100 - 25 * (nulls / cells if cells else 0) - min(25, 2.5 * anomalies) - min(25, 4 * mismatches) - min(15, 2 * unparsed)
    return round(max(0.0, min(100.0, score)), 1)


def can_unify(headers: list[set[str]]) -> bool:
    """Whether every later table has enough of the first one's columns, case aside."""
    if len(headers) < 2 or not headers[0]:
        return False
    return all(len(headers[0] & h) / len(headers[0]) >= UNION_SHARE for h in headers[1:])


def shared_keys(headers: dict[str, set[str]], most: int | None = MOST_KEYS) -> list[dict[str, str]]:
    """Columns that two tables share and that look like keys (or are among three or fewer shared ones); the first most of them
    (None: all)."""
    found = []
    for (a, x), (b, y) in combinations(headers.items(), 2):
        both = sorted(x & y)
        found += [{"table_a": a, "table_b": b, "matching_column": c, "type": "shared_key"} for c in both if len(both) <= 3 or any(w in c for w in KEY_WORDS)]
    return found if most is None else found[:most]


def containment(a: DataFrame, b: DataFrame, column: str) -> float:
    """The share of a's distinct values that b has: how far a shared name is a foreign key."""
    left = a.select(F.col(f"`{column}`").cast("string").alias("v")).filter("v is not null").distinct()
    right = b.select(F.col(f"`{column}`").cast("string").alias("v")).distinct()
    n = left.count()
    return left.join(right, "v", "left_semi").count() / n if n else 0.0


def search_catalogue(catalogue: list[dict[str, Any]], query: str) -> list[dict[str, Any]]:
    """The columns whose name or type holds the query, case aside."""
    low = query.lower()
    return [c for c in catalogue if low in c["header"].lower() or low in c["inferred_type"].lower()]


def category_cardinality(profiles: list[TableProfile]) -> int:
    """Distinct trimmed values over the category columns of all tables."""
    parts = [p.rows.select(F.trim(F.col(f"`{c.header}`").cast("string")).alias("v")) for p in profiles for c in p.of_type("category")]
    if not parts:
        return 0
    return reduce(DataFrame.union, parts).filter("v <> ''").agg(F.count_distinct("v")).first()[0]


def compose(profiles: list[TableProfile], unparsed: int = 0) -> Composition:
    """One summary of all profiles; it counts their findings."""
    cells = sum(p.total_rows * len(p.columns) for p in profiles)
    nulls = sum(c.null_count for p in profiles for c in p.columns)
    anomalies = sum(p.anomalies.count() for p in profiles)
    wrong = sum(p.mismatches.count() for p in profiles)
    catalogue: dict[str, dict[str, Any]] = {}
    for p in profiles:
        for c in p.columns:
            row = catalogue.setdefault(c.header.strip(), {"header": c.header.strip(), "inferred_type": c.inferred_type, "confidence": c.confidence, "sample_values": [], "unique_count": c.unique_count, "null_count": 0, "total_count": 0, "tables": []})
            row["null_count"] += c.null_count
            row["total_count"] += p.total_rows
            row["tables"].append(p.name)
            row["sample_values"] = row["sample_values"] or c.sample_values
    headers = {p.name: {c.header.strip().lower() for c in p.columns} for p in profiles}
    score, full = health(cells, nulls, anomalies, wrong, unparsed), completeness(cells, nulls)
    records = sum(p.total_rows for p in profiles)
    keys, union = shared_keys(headers), can_unify(list(headers.values()))
    count = lambda *kinds: sum(c["inferred_type"] in kinds for c in catalogue.values())
    insights = [
        f"{len(profiles)} table(s), {records:,} records, {len(catalogue)} columns.",
        f"Health {score} of 100; {full}% of cells are filled.",
        f"{count('numeric', 'currency', 'percentage')} measures, {count('category', 'identifier')} dimensions, {count('date', 'time_period')} time columns.",
        f"{anomalies} anomalies, {wrong} mismatches.",
    ]
    insights += ["The tables can be unified."] * union + [f"{len(keys)} shared key(s)."] * bool(keys)
    return Composition(score, full, records, sorted(catalogue.values(), key=lambda r: -r["total_count"]), union, keys, insights)
