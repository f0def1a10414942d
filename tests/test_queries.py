"""Every query with SQL is held against DuckDB on the same tables: columns, row counts and values."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest

from millrace.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted((tuple(norm(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, df.collect())
    if name not in ORACLE_SQL:
        assert got[1]
        return
    found = duck.execute(ORACLE_SQL[name])
    want = table([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
