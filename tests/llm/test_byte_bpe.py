from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from millrace.llm import byte_bpe, pretokens
from millrace.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library() -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts() -> list[str]:
    rng = random.Random(5)
    bits = ["a", "Zoë", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "''", "’", "1", "²", "½", "३", "漢字", "😀", "\x1c", "\x85", "\xa0", " ", "　", "<|endoftext|>", "-", "...", "É", "ǅ", "ʰ", "́", "_", "\x00", "​"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_pieces_encode_as_the_whole_text(library):
    for text in odd_texts():
        pieces = pretokens.split(text)
        assert "".join(pieces) == text
        assert [i for p in pieces for i in library._encode_single_piece(p.encode())] == library.encode_ordinary(text), repr(text)


def test_both_patterns_agree():
    for text in odd_texts():
        if pretokens._usual(text):
            assert pretokens._latin(text) == pretokens._any(text)


def test_query(spark, sf_dir, tmp_path, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(k + 10_000, t) for k, t in enumerate(odd_texts()[:200])]
    rows += [(20_000, None), (20_001, ""), (20_002, "same"), (20_002, "same"), (None, "x" * 30_000 + " yes" * 30_000)]
    spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op2_byte_bpe"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    small = byte_bpe.encode(spark.read.parquet(f"{tmp_path}/documents.parquet"), byte_bpe.read_ranks(PATH), block=20_000, chunk=2_000)
    assert {r.id: (len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()) for r in small.collect()} == {i: w[:2] for i, w in want.items()}
    ranks = byte_bpe.read_ranks(PATH)
    back = byte_bpe.decode(byte_bpe.encode(spark.read.parquet(f"{tmp_path}/documents.parquet"), ranks), ranks)
    assert {tuple(r)[1:] for r in byte_bpe.digests(back).collect()} == set(want.values())
    lone = spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(lone, ranks).collect()] == [b"", b""]


def test_packs_of_packs(spark, sf_dir, library):
    """More tasks than a block has packs: distinct words of several blocks meet before they are dealt on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    ranks = byte_bpe.read_ranks(PATH)
    want = {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = byte_bpe.encode(docs, ranks, block=5_000, chunk=500, fan=3)
        assert {r.id: list(r.ids) for r in got.collect()} == want
        back = byte_bpe.round_trip(docs, ranks, block=5_000, chunk=500, fan=3).collect()
        assert {r.id: bytes(r.decoded).decode() for r in back} == {r.doc_id: r.text or "" for r in docs.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_decoding_refuses_unknown_ids(spark):
    ranks = byte_bpe.read_ranks(PATH)
    for bad in (10**6, -1):
        with pytest.raises(Exception, match="no such token"):
            byte_bpe.decode(spark.createDataFrame([(1, [5, bad])], "id long, ids array<int>"), ranks).collect()


def test_empty_table_and_vocabulary(spark, tmp_path):
    ranks = byte_bpe.read_ranks(PATH)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(docs, ranks).count() == 0
    assert byte_bpe.vocabulary(spark, ranks).count() == len(byte_bpe.token_bytes(ranks))
