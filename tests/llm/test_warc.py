import base64
import gzip
import hashlib
import random

import pytest

from trajectra.llm.warc import chunked, parse_archive, read_archives, reassemble, round_trip, unchunked, write_archives

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "").encode() == p and j is not None), default=None)
        revisit = len(p) >= least and first is not None and i != first
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def made():
    rnd = random.Random(1)
    rows = [(i, f"http://x.example/{i}?a b", "".join(rnd.choice("abcé中\r\n<>") for _ in range(rnd.choice([0, 5, 900, 9000, 200_000]))))
            for i in range(40)]
    rows += [(100 + i, "http://y.example/", rows[i % 3][2]) for i in range(20)]
    return rows + [(200, None, None), (201, "u\r\nWARC-Type: x", ""), (None, "u", "null id"), (None, "u", rows[0][2])]


def test_round_trip_matches_brute_force(spark):
    rows = made()
    got = sorted((tuple(r) for r in round_trip(pages(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    got = sorted((tuple(r) for r in round_trip(pages(spark, rows), min_payload=100, segment_bytes=1000).collect()), key=repr)
    assert got == brute(rows, 100)


def test_payloads_come_back(spark):
    rows = made()
    texts = {i: (h or "").encode() for i, _, h in rows if i is not None}
    read = read_archives(write_archives(pages(spark, rows), segment_bytes=700, archive_bytes=5000)).collect()
    for r in read:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload) == texts[r.page_id]


def test_files_made_elsewhere(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n6;x=y\r\npedia \r\n0\r\n\r\n"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9#0>\r\nContent-Length: %d\r\n\r\n" % len(body)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + head + body + b"\r\n\r\n")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info + head.replace(b"page:9", b"page:8") + body + b"\r\n\r\n"))
    got = read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {(r.page_id, bytes(r.payload)) for r in got} == {(9, b"Wikipedia "), (8, b"Wikipedia ")}


def test_framing_errors():
    assert unchunked(chunked(b"x" * 20_001)) == b"x" * 20_001 and unchunked(chunked(b"")) == b""
    for bad in (b"5\r\nab\r\n0\r\n\r\n", b"zz", b"2\r\nab0\r\n\r\n"):
        with pytest.raises(ValueError):
            unchunked(bad)
    assert reassemble([(2, 5, b"de"), (1, None, b"abc")]) == b"abcde"
    for bad in ([(1, None, b"a")], [(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 9, b"b")], [(1, None, b"a"), (1, 2, b"b")]):
        with pytest.raises(ValueError):
            reassemble(bad)
    with pytest.raises(ValueError):
        list(parse_archive(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def test_odd_rows(spark):
    from pyspark.sql import functions as F
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a")]
    df = pages(spark, rows).withColumn("archive", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("copies", F.lit(3))
    got = sorted(tuple(r)[:1] + tuple(r)[3:] for r in round_trip(df).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert round_trip(pages(spark, [])).collect() == []
    nobody = round_trip(pages(spark, [(None, None, "z"), (None, None, "z")])).collect()
    assert [(r.page_id, r.record_type) for r in nobody] == [(None, "response")] * 2
