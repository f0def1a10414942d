from __future__ import annotations

import gzip
import hashlib
import random

import duckdb
import pytest

from millrace.llm import warc
from millrace.llm.queries import ORACLE_SQL, QUERIES


def test_chunked_framing():
    rng = random.Random(1)
    for n in (0, 1, 8192, 8193, 100_000):
        body = rng.randbytes(n)
        assert warc.dechunked(warc.chunked(body)) == body
    assert warc.dechunked(b"4;name=x\r\nWiki\r\n5\r\npedia\r\n0\r\nTrailer: 1\r\n\r\n") == b"Wikipedia"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc\r\n", warc.chunked(b"abc")[:-6]):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def expected(rows):
    first = {}
    for i, _, h in rows:
        d = (h or "").encode()
        if i is not None and len(d) >= 100:
            first[d] = min(i, first.get(d, i))
    out = []
    for i, _, h in rows:
        d = (h or "").encode()
        again = d in first and i != first[d]
        out.append((i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if again else "response", first[d] if again else None))
    return sorted(out, key=str)


def test_round_trip_with_segments(spark, tmp_path):
    nasty = "x" * 90 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n0\r\n\r\n"
    rows = [(1, "http://a/", nasty), (2, "http://b/\r\nEvil: 1", "é漢😀" * 9_000), (3, None, "é漢😀" * 9_000), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short")]
    rows += [(8, "u", "same " * 30), (8, "u", "same " * 30), (9, "u", "same " * 30), (10, "v", "long " * 40_000), (10, "v", "long " * 40_000), (None, "w", "same " * 30), (None, "w", "only " * 30)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    warc.write(df, f"{tmp_path}/w", archive=20_000, segment=1_000)
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert sorted(((r.row, r.length, r.digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    texts = {(i, (h or "").encode()) for i, _, h in rows}
    assert all((r.row, bytes(r.payload)) in texts for r in got if r.record_type == "response")
    assert len(list((tmp_path / "w").glob("archive=*"))) > 3
    assert spark.read.format("binaryFile").load(f"{tmp_path}/w").count() > 3


def test_damage_and_foreign_archives(spark, tmp_path):
    body = b"hello world" * 50
    good = warc.records(1, "u", body, hashlib.sha256(body).hexdigest(), None, None, False, segment=200)
    assert len(good) > 3
    whole = b"".join(gzip.compress(r + b"\r\n\r\n") for r in [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n", *good])
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "a.warc.gz").write_bytes(whole)
    assert [bytes(r.payload) for r in warc.read(spark, f"{tmp_path}/ok").collect()] == [body]
    for name, data in {"gap": good[:1] + good[2:], "end": good[:-1], "digest": [x.replace(b"hello", b"jello") for x in good]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in data))
        with pytest.raises(Exception, match="WARC"):
            warc.read(spark, f"{tmp_path}/{name}").collect()
    with pytest.raises(ValueError):
        list(warc.parse(good[0][:-5]))


def test_a_record_is_a_member_and_has_its_own_identifier(spark, tmp_path):
    """Every record is a gzip member; copies of a row, null ids among them, don't share identifiers."""
    text = "the same long page " * 400
    rows = [(None, "u", text + "of no id")] * 40 + [(7, "http://first/", text)] * 40 + [(8, "http://other/", text), (9, None, text)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    warc.write(spark.read.parquet(f"{tmp_path}/pages.parquet"), f"{tmp_path}/w", segment=2_000)
    ids, targets = [], set()
    for f in (tmp_path / "w").rglob("part-*"):
        data = f.read_bytes()
        while data:
            d = warc.zlib.decompressobj(31)
            found = list(warc.parse(d.decompress(data)))
            assert d.eof and len(found) <= 1  # the empty member between records has none
            ids += [x["warc-record-id"] for x, _ in found]
            targets |= {(x["millrace-row"], x.get("warc-refers-to-target-uri")) for x, _ in found if x["warc-type"] == "revisit"}
            data = d.unused_data
    assert len(ids) == len(set(ids)) > 80 * 3 and {("8", "http://first/"), ("9", "http://first/")} == targets
    got = warc.read(spark, f"{tmp_path}/w").collect()
    assert sorted(((r.row, r.record_type, r.refers_to) for r in got), key=str) == sorted([(None, "response", None)] * 40 + [(7, "response", None)] * 40 + [(8, "revisit", 7), (9, "revisit", 7)], key=str)


def test_large_foreign_members_are_read_by_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 100)
    body = random.Random(2).randbytes(5000)
    parts = warc.records(1, "u", body, hashlib.sha256(body).hexdigest(), None, None, False)
    whole = b"".join(r + b"\r\n\r\n" for r in parts * 3)
    for data in (whole, gzip.compress(whole), gzip.compress(whole[:700]) + gzip.compress(whole[700:])):
        assert [warc.payload_of(b) for _, b in warc.parse(data)] == [body] * 3
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(whole)[:-200]))


def test_query_matches_sql(spark, sf_dir):
    got = sorted(map(tuple, QUERIES["op9_warc"](spark, sf_dir).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["op9_warc"]).fetchall(), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op9_warc"](spark, str(tmp_path)).count() == 0
