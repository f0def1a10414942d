from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from millrace.llm import media
from millrace.llm.queries import QUERIES


def test_every_filter_is_undone():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (11, 17), dtype=np.uint8)

    def paeth(a, b, c):
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        return a if pa <= pb and pa <= pc else b if pb <= pc else c

    raw = bytearray()
    for r in range(11):
        kind = r % 5
        raw.append(kind)
        for i in range(17):
            x, a = int(image[r, i]), int(image[r, i - 1]) if i else 0
            b, c = (int(image[r - 1, i]) if r else 0), (int(image[r - 1, i - 1]) if r and i else 0)
            raw.append((x - [0, a, b, (a + b) // 2, paeth(a, b, c)][kind]) & 255)
    head = struct.pack(">IIBBBBB", 17, 11, 8, 0, 0, 0, 0)
    data = zlib.compress(bytes(raw))
    png = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", data[:20]) + media._chunk(b"IDAT", data[20:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png)[0] == image).all()


@pytest.mark.parametrize("payload", [b"", b"a", bytes(range(256)) * 3, b"x" * 64, b"\0" * 65, "é漢😀".encode() * 5000])
def test_round_trip_and_damage(payload):
    png = media.to_media(payload)
    samples, text = media.decode_png(png)
    assert samples.tobytes()[: len(payload)] == payload and samples.size % 64 == 0 and samples.size >= 64
    assert not any(samples.tobytes()[len(payload) :]) and text["Length"] == str(len(payload))
    for at in (9, 20, len(png) // 2, len(png) - 6):
        with pytest.raises((ValueError, struct.error)):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises((ValueError, struct.error)):
        media.decode_png(png[:-5])


def test_hash_keeps_what_is_alike():
    ramp = np.random.default_rng(2).integers(0, 256, (64, 64), dtype=np.uint8)
    near = ramp.copy()
    near[5, 5] ^= 3
    other = np.random.default_rng(1).integers(0, 256, (64, 64), dtype=np.uint8)
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(media.cosine_hash(a), media.cosine_hash(b), strict=True))
    assert bits(ramp, near) <= 4 < bits(ramp, other)


def plain_hash(image):
    """The cosine hash by its definition, sum by sum."""
    h, w = image.shape
    part = lambda n, k: range(k * n // 32, (k + 1) * n // 32) if n >= 32 else [k * n // 32]
    small = [[float(np.mean([image[i, j] for i in part(h, r) for j in part(w, c)])) for c in range(32)] for r in range(32)]
    cos = [[np.cos(np.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)]
    low = [round(sum(cos[u][r] * cos[v][c] * small[r][c] for r in range(32) for c in range(32)), 6) for u in range(8) for v in range(8)]
    rest = sorted(low[1:])
    bits = "".join("1" if x > rest[31] else "0" for x in low)
    return int(bits, 2).to_bytes(8, "big")


@pytest.mark.parametrize("shape", [(1, 64), (7, 64), (32, 64), (45, 64), (200, 64), (64, 33)])
def test_cosine_hash_by_definition(shape):
    image = np.random.default_rng(shape[0]).integers(0, 256, shape, dtype=np.uint8)
    assert media.cosine_hash(image) == plain_hash(image)


def test_stored_form_by_definition():
    """What is stored is a PNG that any reader takes: signature, head, zlib rows of filter types, checksums."""
    payload = "some text é".encode() * 30
    png = media.to_media(payload)
    at, body = 8, b""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        chunk = png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + chunk)
        if kind == b"IHDR":
            w, h = struct.unpack(">II", chunk[:8])
            assert chunk[8:] == b"\x08\0\0\0\0"
        body += chunk if kind == b"IDAT" else b""
        at += 12 + n
    rows = zlib.decompress(body)
    assert len(rows) == h * (w + 1) and w == 64 and h == -(-len(payload) // 64) and media.decode_png(png)[0].tobytes().rstrip(b"\0") == payload


def test_query(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [tuple(r) for r in rows] + [(900, None), (901, ""), (902, "dup"), (902, "dup"), (None, "y" * 200_000)]
    spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_media_columns"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[i] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media.to_media(raw)), hashlib.sha256(media.to_media(raw)).hexdigest())
    assert {r.doc_id: tuple(r)[1:7] for r in got} == want
    assert len({r.feature for r in got if r.doc_id in (900, 901)}) == 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op10_media_columns"](spark, str(tmp_path)).count() == 0
