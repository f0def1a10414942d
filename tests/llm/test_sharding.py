from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import pytest

from millrace.llm import sharding
from millrace.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, limit):
    """The shortest prefix of each key's hash that fits."""
    h = {i: int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16) for i, _ in rows}
    size = [(i, len((t or "").encode())) for i, t in rows]
    out = {}
    for depth in range(61):
        total = defaultdict(int)
        for i, n in size:
            total[h[i] >> (60 - depth)] += n
        for i, _ in size:
            p = h[i] >> (60 - depth)
            if i not in out and total[p] <= limit:
                out[i] = (f"{depth}:{p}", depth, total[p])
    return out


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    longest = max(len((t or "").encode()) for _, t in rows)
    for limit in (longest, longest * 3, 10**9):
        got = {r.id: (r.shard, r.depth, r.shard_bytes) for r in sharding.assign(docs, max_bytes=limit).collect()}
        assert got == brute(rows, limit)


def test_hot_keys_and_odd_rows(spark):
    rows = [(7, "x" * 100) for _ in range(500)] + [(k, "y" * (k % 50)) for k in range(100, 400)]
    rows += [(None, None), (None, "z" * 90), (1, ""), (2, "w" * 5000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int")
    got = sharding.assign(df, max_bytes=1000).collect()
    assert sorted((r.id is None, r.id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    filled = defaultdict(int)
    sized = sharding.assign(df.selectExpr("struct(doc_id, text) as s", "doc_id", "text"), max_bytes=1000, id_col="s").collect()
    for r in sized:
        filled[r.shard] += len((r.id.text or "").encode())
    over = {s: n for s, n in filled.items() if n > 1000}
    assert list(over.values()) == [5000]
    assert all(filled[r.shard] == r.shard_bytes for r in sized)
    assert len({r.shard for r in sized if r.id.doc_id == 7}) >= 50


def test_written_shards(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = sharding.assign(docs, max_bytes=100_000)
    assert sharding.write(docs, f"{tmp_path}/shards", max_bytes=100_000) == "shard"
    back = spark.read.parquet(f"{tmp_path}/shards").cache()
    assert back.count() == docs.count()
    assert len(list((tmp_path / "shards").glob("shard=*"))) == shards.select("shard").distinct().count() > 3
    want = {(r.id, r.shard.replace(":", "-")) for r in shards.collect()}
    assert {(r.doc_id, r.shard) for r in back.collect()} == want


@pytest.mark.parametrize("most", [sharding.MOST_CELLS, 0])
def test_writing_loses_and_repeats_no_row(spark, tmp_path, most):
    rows = [(None, "a", 0), (1, "b", 1), (1, "c", 2), (2, None, 3), (None, None, 4), (1, "b", 5), (3, "long " * 40_000, 6)]
    rows += [(9, "x" * 100, 7 + k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard int")
    column = sharding.write(docs, f"{tmp_path}/out", max_bytes=1000, most_cells=most)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert column == "shard_" and sorted(back.columns) == sorted([*docs.columns, column])
    got = back.collect()
    assert sorted((r.Shard, r.doc_id, r.text) for r in got) == sorted((s, i, t) for i, t, s in rows)
    filled = defaultdict(int)
    for r in got:
        filled[r.shard_] += len((r.text or "").encode())
    assert sorted(n for n in filled.values() if n > 1000) == [200_000]


@pytest.mark.parametrize("most", [0])
def test_large_directories_meet_rows_by_a_shuffle(spark, sf_dir, most):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sorted(map(tuple, sharding.assign(docs, max_bytes=200_000, most_cells=m).collect())) for m in (sharding.MOST_CELLS, most))
    assert a == b


def test_query_matches_sql(spark, sf_dir):
    got = sorted(map(tuple, QUERIES["op5_extendible_sharding"](spark, sf_dir).select("doc_id", "shard", "depth", "shard_bytes").collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["op5_extendible_sharding"]).fetchall())


def test_empty_table(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0
