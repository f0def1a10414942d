"""The analyses' relational parts, as DataFrames that can be used on their own. Null group keys are dropped."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs

BUCKETS = ("D", "W", "M", "Q", "Y")


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("double"))


def totals(df: DataFrame, value: str) -> DataFrame:
    """One row (total, average, records)."""
    return df.agg(_sum(F.col(value)).alias("total"), F.avg(value).alias("average"), F.count("*").alias("records"))


def segments(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total, average, records), largest total first, ties by key; records counts the values."""
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key)
    out = grouped.agg(_sum(F.col(value)).alias("total"), F.avg(value).alias("average"), F.count(value).alias("records"))
    return out.orderBy(F.desc("total"), F.asc(key))


def buckets(df: DataFrame, date: str, value: str, bucket: str = "M") -> DataFrame:
    """(period, total, average, records) by calendar bucket, in order; unreadable dates are dropped, empty buckets absent."""
    ts = exprs.as_timestamp(df, date)
    dated = df.select(exprs.period_label(ts, bucket).alias("period"), F.col(value).alias("v")).filter("period is not null")
    return dated.groupBy("period").agg(_sum(F.col("v")).alias("total"), F.avg("v").alias("average"), F.count("v").alias("records")).orderBy("period")


def slope(periods: DataFrame) -> DataFrame:
    """One row: n, first and last total, least-squares slope per period, slope_pct, growth_pct, peak and trough (earliest).

    Totals are rounded to two places first. periods has one row a calendar bucket, so one task may order it."""
    ordered = periods.select("period", F.round("total", 2).alias("total"), F.row_number().over(Window.orderBy("period")).alias("i"))
    agg = ordered.agg(
        F.count("*").alias("n"), F.min_by("total", "period").alias("first"), F.max_by("total", "period").alias("last"), F.regr_slope("total", F.col("i").cast("double")).alias("slope"), F.avg("total").alias("mean"),
        F.max("total").alias("peak"), F.max_by("period", F.struct("total", -F.col("i"))).alias("peak_period"), F.min("total").alias("trough"), F.min_by("period", F.struct("total", "i")).alias("trough_period"),
    )
    base = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    growth = F.when(F.col("first") > 0, (F.col("last") - F.col("first")) / F.col("first") * 100).otherwise(0.0)
    out = agg.withColumn("slope_pct", F.coalesce(F.round(F.col("slope") / base * 100, 1), F.lit(0.0))).withColumn("growth_pct", growth)
    return out.withColumn("direction", direction(F.col("slope_pct"), F.col("n")))


#: Percent a period beyond which a trend counts as one (fixed value).
STEADY = 3.0


def direction(slope_pct: Column, n: Column, steady: float = STEADY) -> Column:
    return F.when(n < 2, "Neutral / Stable").when(slope_pct > steady, "Upward / Growth").when(slope_pct < -steady, "Downward / Decline").otherwise("Stable")


def changes(periods: DataFrame) -> DataFrame:
    """periods with the previous total and the change in percent (null for the first and after zero)."""
    before = F.lag("total").over(Window.orderBy("period"))
    out = periods.withColumn("previous", before)
    return out.withColumn("change_pct", exprs.safe_divide(F.col("total") - F.col("previous"), F.col("previous")) * 100)


def moving_average(periods: DataFrame, width: int = 3) -> DataFrame:
    """periods with the mean of the last width totals and the running sum."""
    order = Window.orderBy("period")
    return periods.withColumn("moving_average", F.avg("total").over(order.rowsBetween(1 - width, 0))).withColumn("running_total", F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def leader(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the two largest segments, the leader's share in percent and its lead over the second."""
    top = segments(df, key, value).select(F.col(key).alias("k"), F.round("total", 2).alias("t"))
    ranked = top.limit(2).withColumn("r", F.row_number().over(Window.orderBy(F.desc("t"), "k")))
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    two = ranked.agg(pick("k", 1).alias("leader"), pick("t", 1).alias("leader_total"), pick("k", 2).alias("runner_up"), pick("t", 2).alias("runner_up_total"))
    whole = top.agg(F.sum("t").alias("whole"))
    out = two.crossJoin(F.broadcast(whole))  # one row each
    lead = F.col("leader_total") - F.col("runner_up_total")
    pct = F.when(F.col("runner_up_total") > 0, lead / F.col("runner_up_total") * 100).otherwise(0.0)
    known = F.coalesce(F.col("runner_up_total"), F.lit(0.0)) != 0
    return out.select("leader", "leader_total", "runner_up", "runner_up_total", F.coalesce(exprs.safe_divide(F.col("leader_total"), F.col("whole")) * 100, F.lit(0.0)).alias("share_pct"), F.when(known, lead).alias("variance"), F.when(known, pct).alias("variance_pct"))


def before_after(df: DataFrame, date: str, value: str, split: str) -> DataFrame:
    """(phase, total, average, records) before a date and from it on."""
    ts = exprs.as_timestamp(df, date)
    phase = F.when(ts < exprs.to_timestamp(F.lit(split)), "before").otherwise("after")
    rows = df.filter(ts.isNotNull()).select(phase.alias("phase"), F.col(value).alias("v"))
    return rows.groupBy("phase").agg(_sum(F.col("v")).alias("total"), F.avg("v").alias("average"), F.count("v").alias("records"))


#: Accuracy of the sketch that brackets exact quantiles, and how many rows a bracket may hold before it is sorted.
SKETCH, MOST_HELD = 1_000, 1_000_000


def quantiles(df: DataFrame, columns: dict[str, Column], shares: tuple[float, ...], exact: bool = True, most_held: int = MOST_HELD) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each named column of numbers, nulls left out; None for a column without values.

    Exact ones take a few passes: a sketch of fixed size brackets each order statistic, counts make sure of the bracket, and
    only the values inside it are grouped and ranked; a bracket of more than most_held rows is narrowed first. Not exact: the
    sketch alone (error 1e-5 of the rows)."""
    if not columns:
        return {}
    rows = df.select(*(c.cast("double").alias(f"x{k}") for k, c in enumerate(columns.values())))
    if not exact:
        points = F.array(*map(F.lit, shares))
        found = rows.agg(*(F.percentile_approx(f"x{k}", points, 100_000).alias(f"x{k}") for k in range(len(columns)))).first()
        return {name: list(found[k] or [None] * len(shares)) for k, name in enumerate(columns)}
    edges = sorted({min(1.0, max(0.0, p + d)) for p in shares for d in (-4 / SKETCH, 4 / SKETCH)} | {0.0, 1.0})
    first = rows.agg(*(F.struct(F.count(f"x{k}").alias("n"), F.min(f"x{k}").alias("low"), F.max(f"x{k}").alias("high"), F.percentile_approx(f"x{k}", F.array(*map(F.lit, edges)), SKETCH).alias("at")).alias(f"x{k}") for k in range(len(columns)))).first()
    targets = []  # (column, order statistic, low, high)
    for k in range(len(columns)):
        s = first[k]
        for p in shares if s.n else ():
            place = p * (s.n - 1)
            low = s.at[max(i for i, e in enumerate(edges) if e <= max(0.0, p - 4 / SKETCH))]
            high = s.at[min(i for i, e in enumerate(edges) if e >= min(1.0, p + 4 / SKETCH))]
            targets += [(k, r, low, high) for r in sorted({math.floor(place), math.ceil(place)})]
    values = _order_statistics(rows, sorted(set(targets)), [first[k] for k in range(len(columns))], most_held)
    out: dict[str, list[float | None]] = {}
    for k, name in enumerate(columns):
        n, out[name] = first[k].n, []
        for p in shares:
            if not n:
                out[name].append(None)
                continue
            place = p * (n - 1)
            a, z = values[k, math.floor(place)], values[k, math.ceil(place)]
            out[name].append(a if a == z else (math.ceil(place) - place) * a + (place - math.floor(place)) * z)
    return out


def _order_statistics(rows: DataFrame, targets: list[tuple], ends: list, most_held: int) -> dict[tuple[int, int], float]:
    """The r-th smallest value (from 0) of a column for each (column, r, low, high); low and high are a guess of its bracket."""
    found: dict[tuple[int, int], float] = {}
    while targets:
        brackets = sorted({(k, low, high) for k, _, low, high in targets})
        counts = []
        for k, low, high in brackets:
            x = F.col(f"x{k}")
            counts += [F.count_if(x < low), F.count_if((x >= low) & (x <= high))]
        seen = rows.agg(*(c.alias(f"c{j}") for j, c in enumerate(counts))).first()
        known = {b: (seen[2 * j], seen[2 * j + 1]) for j, b in enumerate(brackets)}
        ready, wide, missed = [], [], []
        for k, r, low, high in targets:
            below, inside = known[k, low, high]
            if not below <= r < below + inside:
                missed.append((k, r, ends[k].low, ends[k].high))
            elif low == high:
                found[k, r] = low
            else:
                (ready if inside <= most_held else wide).append((k, r, low, high, below, inside))
        if ready:
            own = sorted({x[:1] + x[2:5] for x in ready})
            cells = [c for j, (k, low, high, _) in enumerate(own) for c in (F.lit(j), F.col(f"x{k}"), F.coalesce(F.col(f"x{k}").between(low, high), F.lit(False)))]
            inner = rows.select(F.stack(F.lit(len(own)), *cells).alias("j", "x", "ok")).filter("ok").groupBy("j", "x").agg(F.count("*").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("j").orderBy("x")).alias("upto")
            wanted = [(j, r, r - below) for k, r, low, high, below, _ in ready for j in [own.index((k, low, high, below))]]
            asked = rows.sparkSession.createDataFrame(wanted, "j int, r long, place long")  # two a quantile
            ranked = inner.select("j", "x", "n", upto).join(F.broadcast(asked), "j").filter("place < upto and place >= upto - n")
            found |= {(own[row.j][0], row.r): row.x for row in ranked.select("j", "r", "x").collect()}
        targets = missed
        for k, r, low, high, below, inside in wide:
            x = F.col(f"x{k}")
            share = (r - below) / max(1, inside - 1)
            points = [max(0.0, share - 4 / SKETCH), min(1.0, share + 4 / SKETCH)]
            a, z = rows.filter(x.between(low, high)).agg(F.percentile_approx(x, F.array(*map(F.lit, points)), SKETCH)).first()[0]
            if (a, z) == (low, high):  # many equal values at both ends: what is left lies between them
                targets.append((k, r, low, low) if r < below + rows.filter(x == low).count() else (k, r, math.nextafter(low, math.inf), high) if r < below + inside - rows.filter(x == high).count() else (k, r, high, high))
            else:
                targets.append((k, r, a, z))
    return found


def statistics(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(column, count, mean, median, std, min, max, q1, q3, iqr, skew) of each column, from one aggregation and quantiles()."""
    numbers = {c: exprs.finite(F.col(f"`{c}`").cast("double")) for c in columns}
    marks = quantiles(df, numbers, (0.25, 0.5, 0.75), exact)
    parts = []
    for c, x in numbers.items():
        q = [F.lit(v).cast("double") for v in marks[c]]
        parts.append(
            F.struct(
                F.lit(c).alias("column"), F.count(x).alias("count"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(q[1], F.lit(0.0)).alias("median"), F.coalesce(F.when(F.count(x) > 1, F.stddev_samp(x)), F.lit(0.0)).alias("std"),
                F.coalesce(F.min(x), F.lit(0.0)).alias("min"), F.coalesce(F.max(x), F.lit(0.0)).alias("max"), q[0].alias("q1"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"), exprs.adjusted_skew(x).alias("skew"),
            )
        )
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def medians(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, float | None]:
    """The median of each column's numbers, text of numbers included."""
    found = quantiles(df, {c: exprs.cell_number(F.col(f"`{c}`").cast("string")) for c in columns}, (0.5,), exact)
    return {c: v[0] for c, v in found.items()}


def histogram(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """(bin, low, high, records) of equal-width bins, min(most, n) of them, the last one closed; empty bins included."""
    x = exprs.finite(F.col(f"`{column}`").cast("double"))
    rows = df.select(x.alias("x")).filter("x is not null")
    span = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.least(F.count("*"), F.lit(most)).alias("bins"))
    placed = rows.crossJoin(F.broadcast(span)).groupBy(exprs.bin_of(F.col("x"), F.col("low"), F.col("high"), F.col("bins")).alias("bin")).agg(F.count("*").alias("n"))
    low = F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low"))
    width = F.when(F.col("low") == F.col("high"), F.lit(1.0)).otherwise(F.col("high") - F.col("low")) / F.col("bins")
    frame = span.filter("bins > 0").select(low.alias("a"), width.alias("w"), F.explode(F.sequence(F.lit(0), (F.col("bins") - 1).cast("int"))).alias("bin"))
    return frame.join(placed, "bin", "left").select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("records")).orderBy("bin")


def fences(df: DataFrame, column: str, method: str = "iqr", multiplier: float = 1.5, z: float = 2.5, exact: bool = True) -> DataFrame:
    """One row (low, high, usable) of bounds beyond which values are outliers; not usable: no spread for z-scores."""
    x = F.col(f"`{column}`").cast("double")
    if method == "zscore":
        stats = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
        ok = F.coalesce(F.col("s") > 0, F.lit(False))
        return stats.select(F.when(ok, F.col("m") - z * F.col("s")).otherwise(0.0).alias("low"), F.when(ok, F.col("m") + z * F.col("s")).otherwise(0.0).alias("high"), ok.alias("usable"))
    a, b = quantiles(df, {"x": exprs.finite(x)}, (0.25, 0.75), exact)["x"]
    reach = None if a is None else multiplier * (b - a)
    ends = (None, None) if a is None else (a - reach, b + reach)
    return df.sparkSession.createDataFrame([(*ends, True)], "low double, high double, usable boolean")


def flag_outliers(df: DataFrame, column: str, method: str = "iqr", multiplier: float = 1.5, z: float = 2.5, exact: bool = True) -> DataFrame:
    """df with low, high and _is_outlier; the bounds come from a one-row aggregate that is broadcast."""
    x = F.col(f"`{column}`").cast("double")
    bounds = fences(df, column, method, multiplier, z, exact).toDF("_low", "_high", "_usable")
    beyond = F.coalesce(F.col("_usable") & ((x < F.col("_low")) | (x > F.col("_high"))), F.lit(False))
    return df.crossJoin(F.broadcast(bounds)).withColumn("_is_outlier", beyond).drop("_usable")


def outlier_summary(df: DataFrame, column: str, method: str = "iqr", multiplier: float = 1.5, z: float = 2.5, exact: bool = True) -> DataFrame:
    """One row (valid, rows, outliers, outlier_pct of all rows, low, high, extreme)."""
    flagged = flag_outliers(df, column, method, multiplier, z, exact)
    x = F.col(f"`{column}`").cast("double")
    hit = F.col("_is_outlier")
    agg = flagged.agg(F.count(x).alias("valid"), F.count("*").alias("rows"), F.count_if(hit).alias("outliers"), F.first("_low").alias("low"), F.first("_high").alias("high"), F.max(F.when(hit, x)).alias("most"), F.min(F.when(hit, x)).alias("least"))
    extreme = F.when(F.col("most") > F.col("high"), F.col("most")).otherwise(F.col("least"))
    return agg.select("valid", "rows", "outliers", F.round(F.col("outliers") / F.col("rows") * 100, 2).alias("outlier_pct"), "low", "high", extreme.alias("extreme"))


FUNCTIONS = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


def group_by(df: DataFrame, key: str, value: str, how: str = "sum") -> DataFrame:
    """(key, value): one function of the numeric values by key; a null key is shown as a dash, an empty group gives 0."""
    x = exprs.as_number(df, value)
    shown = F.coalesce(F.col(key).cast("string"), F.lit("—"))
    return df.groupBy(shown.alias(key)).agg(F.coalesce(FUNCTIONS[how](x).cast("double"), F.lit(0.0)).alias("value"))


def custom(df: DataFrame, keys: list[str], measures: dict[str, list[str]], sets: str | list[list[str]] = "group") -> DataFrame:
    """Several keys and functions; sets: group, rollup, cube, or a list of key lists (grouping sets). Columns are called
    function_column."""
    out = [(F.count_distinct(F.col(c)) if f == "distinct" else FUNCTIONS[f](F.col(c))).alias(f"{f}_{c}") for c, fs in measures.items() for f in fs]
    if not isinstance(sets, str):
        return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in keys)).agg(*out)
    grouped = {"group": df.groupBy, "rollup": df.rollup, "cube": df.cube}[sets](*keys)
    return grouped.agg(*out)


#: Ranking and analytic functions by name; the arguments are a column and a number where they take them.
ANALYTIC = {
    "row_number": lambda *_: F.row_number(), "rank": lambda *_: F.rank(), "dense_rank": lambda *_: F.dense_rank(), "percent_rank": lambda *_: F.percent_rank(), "cume_dist": lambda *_: F.cume_dist(),
    "ntile": lambda n: F.ntile(n), "lag": lambda c, n=1: F.lag(c, n), "lead": lambda c, n=1: F.lead(c, n), "nth_value": lambda c, n: F.nth_value(c, n), "first_value": lambda c: F.first(c), "last_value": lambda c: F.last(c),
    "sum": lambda c: F.sum(c), "avg": lambda c: F.avg(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c), "count": lambda c: F.count(c),
}
_RANKING = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead")


def windowed(df: DataFrame, by: list[str], order: list[Column | str], functions: dict[str, tuple], rows: tuple[int | None, int | None] | None = None) -> DataFrame:
    """df with a column for each of functions (name to (function, arguments ...)) over the rows of the same keys in an order.

    rows: the frame of functions that have one, from and to so many rows away, None for its end; without it the whole
    partition. All functions share one shuffle and sort; a key's rows are one task's, so choose keys that no hot value has."""
    base = Window.partitionBy(*by).orderBy(*order)
    low, high = rows or (None, None)
    frame = base.rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
    return df.withColumns({name: ANALYTIC[f](*args).over(base if f in _RANKING else frame) for name, (f, *args) in functions.items()})
