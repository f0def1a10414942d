"""Periods in column headers: months, quarters, half-years and years, in chronological order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Month names and their abbreviations (English, French), in the order of months, so the place is the number.
MONTHS = (
    "jan january janv janvier", "feb february févr fév février", "mar march mars", "apr april avr avril", "may mai", "jun june juin",
    "jul july juil juillet", "aug august aoû août", "sep sept september septembre", "oct october octobre", "nov november novembre", "dec december déc décembre",
)
_MONTH = {w: k for k, ws in enumerate(MONTHS, 1) for w in ws.split()}


@dataclass(frozen=True)
class Period:
    label: str
    order: tuple[int, int]
    kind: str


@dataclass
class TimeStructure:
    """columns: the period headers in time order, with their periods."""

    kind: str | None = None
    start: str | None = None
    end: str | None = None
    columns: dict[str, Period] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.columns)


def expand_year(text: str) -> int:
    """Two digits up to 49 are 20xx, above 19xx."""
    y = int(text)
    return y if y >= 1900 else y + (2000 if y <= 49 else 1900)


def parse(header: str) -> Period | None:
    h = header.strip()
    if m := re.fullmatch(r"([^\W\d_]+)\.?[\s_-](\d{2}|\d{4})", h):
        if month := _MONTH.get(m[1].lower()):
            return _month(expand_year(m[2]), month)
    if m := re.fullmatch(r"(\d{4})/(\d{1,2})", h):
        return _month(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"(\d{1,2})/(\d{4})", h):
        return _month(int(m[2]), int(m[1]))
    if m := re.fullmatch(r"Q([1-4])[\s_-]*(?:FY)?(\d{2}|\d{4})", h, re.I) or re.fullmatch(r"([1-4])Q[\s_-]?(\d{4})", h, re.I):
        year, q = expand_year(m[2]), int(m[1])
        return Period(f"{year}-Q{q}", (year, 3 * q - 2), "quarterly")
    if m := re.fullmatch(r"H([12])[\s_-]*(?:FY)?(\d{2}|\d{4})", h, re.I):
        year, half = expand_year(m[2]), int(m[1])
        return Period(f"{year}-H{half}", (year, 6 * half - 5), "halfyear")
    if re.fullmatch(r"(?:19|20)\d{2}", h):
        return Period(h, (int(h), 1), "yearly")
    if m := re.fullmatch(r"FY\s?(\d{2}|\d{4})", h, re.I):
        year = expand_year(m[1])
        return Period(f"FY{year}", (year, 1), "yearly")
    return None


def _month(year: int, month: int) -> Period | None:
    return Period(f"{year}-{month:02d}", (year, month), "monthly") if 1 <= month <= 12 else None


def detect(headers: list[str]) -> TimeStructure:
    """The period headers, if there are two or more; the finest kind among them names the whole."""
    found = {h: p for h in headers if (p := parse(h))}
    if len(found) < 2:
        return TimeStructure()
    ordered = dict(sorted(found.items(), key=lambda x: x[1].order))
    kinds = {p.kind for p in ordered.values()}
    kind = next(k for k in ("monthly", "quarterly", "halfyear", "yearly") if k in kinds)
    labels = [p.label for p in ordered.values()]
    return TimeStructure(kind, labels[0], labels[-1], ordered)


def to_long(df: DataFrame, structure: TimeStructure, keys: list[str]) -> DataFrame:
    """(keys, period, value): one row for each period column."""
    cells = F.array(*(F.struct(F.lit(p.label).alias("period"), F.col(f"`{c}`").alias("value")) for c, p in structure.columns.items()))
    return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")
