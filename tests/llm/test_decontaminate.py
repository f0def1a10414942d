from __future__ import annotations

import random
import re
from itertools import combinations

import duckdb
import pytest

from millrace.llm import decontaminate
from millrace.llm.queries import ORACLE_SQL, QUERIES


def test_masks_hit_every_window_with_two_replaced_words():
    for gone in combinations(range(decontaminate.WINDOW), 2):
        assert any(not {o + s for o in mask} & set(gone) for mask in decontaminate.MASKS for s in range(decontaminate.WINDOW - decontaminate.SPAN + 1))


def brute(docs, items):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    best = {}
    for d, text in docs:
        w = split(text)
        for i, item in items:
            v = split(item)
            if len(v) < 8:
                continue
            width = min(13, len(v))
            for diagonal in range(-len(v) + 1, len(w)):
                eq = [int(w[diagonal + j] == v[j]) if 0 <= diagonal + j < len(w) else None for j in range(len(v))]
                eq = [x for x in eq if x is not None]
                need = len(v) if len(v) < 13 else 11
                if any(sum(eq[k : k + width]) >= need for k in range(len(eq) - width + 1)):
                    best[d, i] = max(best.get((d, i), (0, 0)), (sum(eq), len(v)))
    return {(d, i, m, n) for (d, i), (m, n) in best.items()}


@pytest.mark.parametrize("most", [decontaminate.MOST_SEEDS, 40])
def test_matches_brute_force(spark, most):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "été", "the", "of", "x1", "ß", "漢"] + [f"w{k}" for k in range(60)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, make(n)) for k, n in enumerate([3, 8, 10, 12, 13, 14, 20, 33, 56])]
    docs = [(100, None), (101, ""), (102, "the " * 40)]
    for k in range(60):
        body = make(rng.randint(0, 40))
        _, item = rng.choice(items)
        piece = item[rng.randint(0, 3) :] if rng.random() < 0.4 else list(item)
        for _ in range(rng.randint(0, max(1, len(piece) // 5))):
            if piece:
                piece[rng.randrange(len(piece))] = rng.choice(words)
        at = rng.randint(0, len(body))
        docs.append((k, (", " if k % 3 else "\n").join([*body[:at], *piece, *body[at:]]).title()))
    docs.append(docs[-1])
    items = [(k, " ".join(v)) for k, v in items] + [(99, None)]
    left = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id long")
    right = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id long")
    found = decontaminate.overlaps(left, right, most_seeds=most)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and len(got) > 20
    leaks = {d for d, *_ in got}
    assert sorted(r.doc_id for r in decontaminate.clean(left, right).collect()) == sorted(d for d, _ in docs if d not in leaks)


def test_query_matches_sql(spark, sf_dir):
    got = sorted(map(tuple, QUERIES["op6_benchmark_decontamination"](spark, sf_dir).collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["op6_benchmark_decontamination"]).fetchall()) and got


def test_native_and_without_shuffling_documents(spark, sf_dir):
    plan = QUERIES["op6_benchmark_decontamination"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|SortMergeJoin|Cartesian", plan) and "BroadcastHashJoin" in plan


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert decontaminate.overlaps(docs, items).count() == 0
    assert decontaminate.overlaps(items.withColumnRenamed("item_id", "doc_id"), items.filter("item_id = 2")).count() == 0


def test_long_and_repetitive_texts(spark):
    """A hit carries no more of the document than its item has words, however often the document repeats them."""
    docs = [(1, "the " * 150_000), (2, " ".join(f"q{k}" for k in range(150_000))), (3, "the " * 19), (4, "a b " * 50_000)]
    items = [(1, "the " * 20), (2, " ".join(f"q{k}" for k in range(100_500, 100_530))), (3, "b a " * 4)]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in found.collect()} == {(1, 1, 20, 20), (2, 2, 30, 30), (3, 1, 19, 20), (4, 3, 8, 8)}


def test_clean_keeps_other_rows_of_null_and_repeated_ids(spark):
    leak = "one two three four five six seven eight nine ten"
    rows = [(None, leak, 1), (None, "clean", 2), (1, leak, 3), (1, "clean", 4), (2, "clean", 5), (2, "clean", 6), (3, None, 7), (4, leak.upper(), 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, leak), (None, leak)], "item_id long, text string")
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [2, 4, 5, 6, 7, 9]


def test_one_huge_item_is_dealt_to_many_blocks(spark):
    words = [f"w{k}" for k in range(600)]
    docs = spark.createDataFrame([(k, " ".join(words[20 * k : 20 * k + 20])) for k in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = decontaminate.overlaps(docs, items, most_seeds=100).collect()
    assert sorted((r.id, r.matched) for r in got) == [(k, 20) for k in range(30)]
