from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import wavelet
from millrace.llm.queries import QUERIES

from .test_byte_bpe import odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (7, 2), (3000, 50_257), (1025, 5), (500, 200_000), (100_003, 300), (65_536, 3)])
def test_matrix_against_arrays(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    m = wavelet.WaveletMatrix.of(ids)
    assert (m.all() == ids).all()
    for i in range(0, n, max(1, n // 40)):
        assert m[i] == ids[i]
        assert m.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    for token in {int(x) for x in ids[:5]} | {0, top + 5}:
        assert m.occurrences(token) == np.flatnonzero(ids == token).tolist()


def test_files_and_damage():
    ids = np.arange(1000, dtype=np.uint32) % 77
    data = wavelet.dump(ids, [5, None, 7], [400, 0, 600])
    matrix, docs, sizes = wavelet.load(data)
    assert docs == [5, None, 7] and sizes.tolist() == [400, 0, 600] and (matrix.all() == ids).all()
    for at in range(0, len(data), 7):
        with pytest.raises(Exception):  # noqa: B017
            wavelet.load(data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :])


def test_access_reads_a_few_blocks_only(monkeypatch):
    """What one access decompresses: a block a plane for a token and a place, two for a count, of some hundred in the file."""
    ids = np.random.default_rng(3).integers(0, 50_000, 400_000).astype(np.uint32)
    ids[::1000] = 77
    data = wavelet.dump(ids, [1], [len(ids)])
    read = []

    class Counting:
        def __init__(self):
            self.real = wavelet.zstandard.ZstdDecompressor

        def __call__(self):
            plain = self.real().decompress
            return type("D", (), {"decompress": staticmethod(lambda x, **more: read.append(out := plain(x, **more)) or out)})()

    monkeypatch.setattr(wavelet.zstandard, "ZstdDecompressor", Counting())
    blocks = 16 * -(-len(ids) // (8 * wavelet.BLOCK))
    for ask, most in ((lambda m: m[123_456] == ids[123_456], 16), (lambda m: m.rank(77, 200_500) == int((ids[:200_500] == 77).sum()), 32), (lambda m: m.select(77, 3) == np.flatnonzero(ids == 77)[3], 48), (lambda m: m.occurrences(77, 5) == np.flatnonzero(ids == 77)[:5].tolist(), 80)):
        read.clear()
        assert ask(wavelet.open_shard(data)[0])
        read[:] = [x for x in read if len(x) > 100]  # without the table of documents
        assert len(read) <= most < blocks and sum(map(len, read)) <= most * wavelet.BLOCK
    matrix = wavelet.open_shard(data)[0]
    assert matrix.occurrences(77) == np.flatnonzero(ids == 77).tolist() and (matrix.all() == ids).all()


def test_query(spark, sf_dir, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(k + 10_000, t) for k, t in enumerate(odd_texts()[:300])]
    rows += [(-5, None), (20_001, ""), (20_002, "same"), (20_002, "same"), (None, "x" * 3_000 + " yes" * 30_000), (20_003, "a <|endoftext|>b<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, part string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_wavelet_tokens"](spark, str(tmp_path)).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    with open(PATH, "rb") as f:
        wavelet.write(docs, f"{tmp_path}/small", f.read(), 2, shard=500)
    files = spark.read.parquet(f"{tmp_path}/small")
    assert files.count() > 20
    assert sorted((r.id if r.id is not None else -99, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in wavelet.read(files).collect()) == sorted((-99 if w[0] is None else w[0], *w[1:]) for w in want)
    assert sum(r.n for r in wavelet.find(files, 2, limit=1).collect()) >= len(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op4_wavelet_tokens"](spark, str(tmp_path)).count() == 0
