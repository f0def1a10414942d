"""Operators whose plans must not gather a hot key or a whole column in one task, held against brute force."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import joins, profile
from millrace.operators.align import ROW
from millrace.plans import aggregates as agg


def test_quantiles_are_exact(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1e6), float(rng.randrange(3)), 7.0, rng.random() if rng.random() < 0.5 else None, float(rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9))) for _ in range(4001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    shares = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    want = {c: np.quantile([r[k] for r in rows if r[k] is not None], shares) for k, c in enumerate("abcde")}
    for most in (agg.MOST_HELD, 3):  # the second narrows its brackets many times
        got = agg.quantiles(df, {c: F.col(c) for c in "abcde"}, shares, most_held=most)
        for c in "abcde":
            assert np.allclose(got[c], want[c], rtol=1e-12), (c, most)
    assert agg.quantiles(df.filter("a is null"), {"a": F.col("a")}, (0.5,)) == {"a": [None]}
    assert agg.quantiles(df.limit(1), {"c": F.col("c")}, (0.2, 0.9)) == {"c": [7.0, 7.0]}
    rough = agg.quantiles(df, {"a": F.col("a")}, (0.5,), exact=False)["a"][0]
    assert abs(sum(r[0] < rough for r in rows) - 2000) < 5
    assert agg.medians(spark.createDataFrame([("$5", "x"), ("(3)", "y"), (None, "z")], "m string, t string"), ["m", "t"]) == {"m": 1.0, "t": None}


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "a", None)], "x int, y string, z string")
    assert profile.distinct_counts(df, {c: F.col(c) for c in "xyz"}) == {"x": 2, "y": 2, "z": 0}
    plan = df._jdf.queryExecution().toString()
    assert "Expand" not in plan and profile.distinct_counts(df, {}) == {}


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_blank_runs_over_chunk_edges(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, None if rng.random() < 0.7 else "x", None if k < 50 else "y") for k in range(300)]
    df = spark.createDataFrame(rows, f"{ROW} long, a string, b string").repartition(4).withColumn("_row_role", F.lit("detail"))
    want = set()
    for j, c in ((1, "a"), (2, "b")):
        k = 0
        while k < 300:
            z = k
            while z < 300 and rows[z][j] is None:
                z += 1
            if z - k >= 3:
                want.add((c, k, str(z - k)))
            k = max(z, k + 1)
    got = {(r.column, r.row_index, r.detail) for r in profile.blank_runs(df, ["a", "b"], chunk=chunk).collect()}
    assert got == want


def brute_as_of(left, right):
    out = []
    for i, k, t in left:
        hits = [(x, v) for kk, x, v in right if kk == k and t is not None and x is not None and x <= t]
        out.append((i, k, t, max(hits)[1] if hits else None))
    return out


@pytest.mark.parametrize("slices", [1, 7, 200])
def test_as_of_with_a_hot_key(spark, slices):
    rng = random.Random(slices)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    left = [(i, key(), rng.choice([None, rng.randint(0, 60), rng.randint(0, 1000)])) for i in range(400)]
    right = [(key(), rng.choice([None, rng.randint(-50, 1200)]), rng.randint(0, 99)) for _ in range(120)]
    a = spark.createDataFrame(left, "i long, k int, t long").repartition(3)
    b = spark.createDataFrame(right, "k int, t long, v int").repartition(3)
    got = sorted(map(tuple, joins.as_of(a, b, "t", ["k"], ["v"], slices=slices).select("i", "k", "t", "v").collect()), key=repr)
    assert got == sorted([x if x[1] is not None else (*x[:3], max([(t, v) for k, t, v in right if k is None and t is not None and x[2] is not None and t <= x[2]], default=(0, None))[1]) for x in brute_as_of(left, right)], key=repr)
    alone = joins.as_of(a.drop("k"), b.drop("k"), "t", [], ["v"], slices=slices).select("i", "v").collect()
    want = {i: max([(x, v) for _, x, v in right if t is not None and x is not None and x <= t], default=(0, None))[1] for i, _, t in left}
    assert {r.i: r.v for r in alone} == want
    times = lambda rows, at: [tuple(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=v) if j == at and v is not None else v for j, v in enumerate(r)) for r in rows]
    c = spark.createDataFrame(times(left, 2), "i long, k int, t timestamp")
    d = spark.createDataFrame(times(right, 1), "k int, t timestamp, v int")
    stamped = {r.i: r.v for r in joins.as_of(c, d, "t", ["k"], ["v"], slices=slices).collect()}
    assert stamped == {r[0]: r[3] for r in got}
    assert joins.as_of(a.limit(0), b, "t", ["k"], ["v"]).count() == 0 and joins.as_of(a, b.limit(0), "t", ["k"], ["v"]).filter("v is not null").count() == 0


@pytest.mark.parametrize(("width", "salts"), [(None, 8), (0.5, 1), (100.0, 3)])
def test_ranges_of_very_different_lengths(spark, width, salts):
    rng = random.Random(11)
    points = [(k, rng.choice([None, rng.uniform(-100, 1000), 5.0, 5.0])) for k in range(300)]
    spans = [(k, lo := rng.uniform(-120, 1000), lo + rng.choice([0, 0.1, 1, 40, 5000, -1])) for k in range(80)] + [(80, None, 3.0), (81, 5.0, 5.0), (82, float(-(10**6)), float(10**6))]
    got = joins.in_range(spark.createDataFrame(points, "p int, v double"), spark.createDataFrame(spans, "s int, lo double, hi double"), "v", "lo", "hi", width, salts).select("p", "s").collect()
    want = sorted((p, s) for p, v in points for s, lo, hi in spans if v is not None and lo is not None and lo <= v <= hi)
    assert sorted(map(tuple, got)) == want
    assert joins.in_range(spark.createDataFrame(points, "p int, v double"), spark.createDataFrame([], "s int, lo double, hi double"), "v", "lo", "hi").count() == 0


@pytest.mark.parametrize("most", [joins.MOST_BROADCAST, 0])
def test_theta_and_lateral(spark, most):
    a = spark.createDataFrame([(k, k % 7) for k in range(40)], "x int, y int").repartition(3)
    b = spark.createDataFrame([(k, k % 5) for k in range(25)], "z int, w int").repartition(2)
    got = joins.theta(a, b, "x < z and y <> w", most=most, cells=9)
    assert got.columns == ["x", "y", "z", "w"]
    assert sorted(map(tuple, got.collect())) == sorted((x, x % 7, z, z % 5) for x in range(40) for z in range(25) if x < z and x % 7 != z % 5)
    top = joins.lateral(a, b.withColumnRenamed("w", "y"), ["y"], [F.desc("z")], 2, "left")
    want = {(x, x % 7): sorted((z for z in range(25) if z % 5 == x % 7), reverse=True)[:2] or [None] for x in range(40)}
    assert sorted(((r.x, r.y, r.z) for r in top.collect()), key=repr) == sorted(((*k, z) for k, zs in want.items() for z in zs), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_equi(spark, how):
    a, b = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string"), spark.createDataFrame([(2, 5), (2, 6), (3, 7)], "k int, y int")
    for most in (0, 100):
        assert sorted(map(tuple, joins.equi(a, b, ["k"], how, most).collect()), key=repr) == sorted(map(tuple, a.join(b, ["k"], how).collect()), key=repr)
