from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import tiktoken

from millrace.llm import language, near_copies, secret_scan
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_language import brute as fused


def sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows):
    """Brute force: which rows are joined by a similarity of 0.8 or more."""
    shingles = [sets(t) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if of[i] != of[j] and (not a and not b or a and b and len(a & b) / len(a | b) >= 0.8):
                old, new = max(of[i], of[j]), min(of[i], of[j])
                of = [new if x == old else x for x in of]
    return of


def edited(rng, words, share):
    return " ".join(rng.choice(["alpha", "omega", "sigma"]) if rng.random() < share else w for w in words)


def test_near_copies_match_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(3000)]
    rows = [(k, None if k == 1 else "" if k < 3 else " \n") for k in range(4)] + [(None, "short text"), (None, "Short  TEXT"), (4, "short text"), (4, "short text")]
    for base in range(40):
        words = rng.choices(vocab, k=rng.choice((4, 30, 120, 600)))
        rows += [(100 * base + 100 + k, edited(rng, words, rng.choice((0, 0.005, 0.02, 0.05)))) for k in range(rng.choice((1, 2, 8)))]
    rows += [(9000 + k, "Exact copies of one text are many and must not make pairs") for k in range(300)]
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, component string, row long")
    want = groups(rows)
    found = near_copies.dedup(docs).collect()
    kept = Counter(want[r.row] for r in found)
    assert set(kept.values()) == {1} and set(kept) == set(want)
    assert near_copies.dedup(docs.filter("doc_id = -1")).count() == 0
    assert found[0].component == "x" and len(found[0]) == 4
    first = {}
    for (i, _), g in zip(rows, want, strict=True):
        first[g] = min(first.get(g, (True, 0)), (i is None, i or 0))
    assert {(r.doc_id is None, r.doc_id or 0) for r in found} == set(first.values())


def test_large_groups_of_edited_copies(spark):
    """Six bases of 60 edited copies each: the candidate groups are far above FEW, and no link of brute force is lost."""
    rng = random.Random(5)
    vocab, rows = [f"w{k}" for k in range(4000)], []
    for _ in range(6):
        words = rng.choices(vocab, k=rng.choice((120, 200, 300)))
        rows += [(0, edited(rng, words, rng.choice((0.01, 0.015, 0.02, 0.03)))) for _ in range(60)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    want = groups(rows)
    assert 100 < len(set(want)) < 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for exact in (False, True):
        of = {r.id: r.component for r in near_copies.groups(docs, exact=exact).collect()}
        assert len(set(of.values())) == len(set(want)) == len({(of[k], g) for k, g in enumerate(want)})


def test_very_long_texts_and_many_copies(spark):
    rng = random.Random(8)
    long = [f"v{rng.randrange(10**6)}" for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:60_000], "changed", *long[60_001:]])), (3, " ".join(long[::-1]))]
    rows += [(10 + k, "the same few words in every copy of this one") for k in range(2000)] + [(None, "x " * 50_000), (4, "x " * 50_001)]
    found = near_copies.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in found) == [1, 3, 4, 10]


def test_links_meet_between_fingerprints_in_crowded_cells(spark):
    """More than CROWD fingerprints of one cell; pairs that differ in two bits have no fingerprint between them."""
    rng = random.Random(5)
    prints = {tuple(1 << rng.randrange(4) for _ in range(16)) for _ in range(200)}
    packed = [sum(v << 4 * k for k, v in enumerate(p)) for p in sorted(prints)]
    nodes, want = [], set()
    for k, fp in enumerate(packed):
        low = fp & 15
        moved = fp ^ low ^ (low << 1 if low < 8 else 1)
        nodes += [(3 * k, fp), (3 * k + 1, moved), (3 * k + 2, moved)]
        want |= {(3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 2)}
    signed = [(n, fp - (1 << 64) if fp >> 63 else fp, [n]) for n, fp in nodes]
    found = near_copies._candidates(spark.createDataFrame(signed, "node long, fp long, sketch array<long>"))
    assert want <= {(r.a, r.b) for r in found.collect()}


def test_large_families_lose_no_pair(spark):
    """Texts that share most of their shingles, below the similarity, with planted pairs above it."""
    rng = random.Random(12)
    plate, own = [f"b{k}" for k in range(170)], iter(range(10**6))
    fresh = lambda n: [f"u{next(own)}" for _ in range(n)]
    texts = [plate + fresh(26) for _ in range(500)]
    for _ in range(150):
        both = fresh(9)
        texts += [plate + both + fresh(17), plate + both + fresh(17)]
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = groups(rows)
    assert len(set(want)) == 650
    found = near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {r.id: r.component for r in found}
    assert len(set(of.values())) == 650 and len({(of[k], g) for k, g in enumerate(want)}) == 650


def test_pipeline_matches_brute_force(spark, sf_dir, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in source.limit(120).collect()]
    rows += [(5000, None, "en", "s", None), (5001, "", "fr", None, 0), (5002, rows[3][1], "en", "s", 1), (5003, f"Well then {items[0][1]} and so on", "en", "s", 1), (5004, "my token = 0123456789abcdef here and there it is", "en", "s", 1)]
    rows += [(5005, edited(rng, rows[4][1].split(), 0.01), rows[4][2], "s", 1), rows[5], (5006, "123 456", "en", "s", 7)]
    spark.createDataFrame(rows, source.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = language.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    good = Counter(x[0] for x in fused([(i, t, None, None, s and s.lower()) for i, t, _, s, _ in rows], model, language.PSEUDO) if x[3])
    left = [r for r in rows if r[0] in good]
    assert {r[0] for r in rows} - {r[0] for r in left} >= {5000, 5001, 5006}
    of = groups([(r[0], r[1]) for r in left])
    best = {}
    for r, g in zip(left, of, strict=True):
        best[g] = min(best.get(g, r), r, key=lambda x: x[0])
    left = list(best.values())
    bad = {d for d, *_ in leaks([(r[0], r[1]) for r in left], items)}
    assert 5003 in bad
    left = [r for r in left if r[0] not in bad]
    scanner = secret_scan.train()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, text, *_ in left:
        out, last = "", 0
        for s, e, _ in sorted(sum(scanner.scan(text), [])):
            if s >= last:
                out += text[last:s] + "[SECRET]"
            last = max(last, e)
        out += text[last:]
        ids = library.encode_ordinary(out)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == source.columns and [t for _, t in docs.dtypes] == [t for _, t in source.dtypes], name
    assert "[SECRET]" in docs.filter("doc_id = 5004").first().text
    empty = spark.createDataFrame([], source.schema)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0
