from __future__ import annotations

import random

import xxhash

from millrace.llm import simhash
from millrace.llm.queries import QUERIES


def plain(text: str | None) -> int:
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints: list[tuple[int, int]]) -> dict[int, int]:
    comp = {i: i for i, _ in prints}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((top(i), top(j)))
                comp[y] = x
    return {i: top(i) for i, _ in prints}


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    prints = [(r.doc_id, plain(r.text)) for r in rows]
    want = brute(prints)
    got = {r.id: r for r in simhash.groups(docs).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].fp for i, _ in prints} == {i: signed(f) for i, f in prints}
    assert {i: r.component_id for i, r in got.items()} == want
    rows = QUERIES["op8_simhash_near_dedup"](spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{f:016x}", want[i]) for i, f in prints} and len(rows) == len(prints)


def test_links_are_exact_even_in_crowded_cells(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre}
    for a in range(64):  # a crowd within a few bits, chains and strangers
        prints.add(centre ^ 1 << a)
        prints.update(centre ^ 1 << a ^ 1 << b for b in rng.sample(range(64), 12))
    prints.update(rng.getrandbits(64) for _ in range(400))
    walk = rng.getrandbits(64)
    for _ in range(30):
        prints.add(walk := walk ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    df = spark.createDataFrame([(signed(x),) for x in sorted(prints)], "fp long")
    comp = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    nodes = [signed(x) for x in sorted(prints)]
    want = brute([(n, n % (1 << 64)) for n in nodes])
    seen: dict[int, int] = {}
    for n in nodes:
        assert seen.setdefault(want[n], comp.get(n, n)) == comp.get(n, n)
    assert len({comp.get(n, n) for n in nodes}) == len(set(want.values()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (4, "one"), (4, "one"), (5, "One"), (None, "alone here"), (6, " x ı y z " * 3000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.id if r.id is not None else -1, r.fp, r.component_id) for r in simhash.groups(df).collect())
    assert len(got) == len(rows)
    assert [(i, c) for i, _, c in got] == [(-1, None), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6)]
    assert all(f == signed(plain(dict((i, t) for i, t in rows).get(None if i == -1 else i))) for i, f, _ in got)
    assert simhash.groups(df.filter("doc_id = 99")).count() == 0


def test_a_hot_component_is_dealt_to_many_tasks(spark, monkeypatch):
    """Beyond the bound of broadcasts the joins of components are salted, with the same rows."""
    rows = [(k, f"common words of one text {'again ' * (k % 3)}") for k in range(200)] + [(500 + k, f"text number {k} has its own words {k * k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain_ = sorted(map(tuple, simhash.groups(docs).collect()))
    monkeypatch.setattr(simhash.common.met, "__defaults__", ("inner", 0, 5))
    assert sorted(map(tuple, simhash.groups(docs).collect())) == plain_
