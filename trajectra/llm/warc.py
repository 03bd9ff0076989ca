"""WARC archives: writing records with revisits and segments, and reassembling them.

Archives are rows of (archive, content): the bytes of WARC files whose records
are gzip members, as the format recommends.  They are written as a table to the
shared folder, so any file system that Spark reaches will do; files made elsewhere
are read with ``spark.read.format("binaryFile")`` (path and content columns).

A record longer than a segment is split into the record itself, segment 1, and
continuation records that name it as their origin.  Those may lie in any archive.
The reader groups them by origin, orders them by segment number, verifies that
none is missing and that the total length is as the last one states, and only then
decodes the HTTP framing (chunked transfer or plain).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.llm.common import attach, prepare, staged

ARCHIVE_BYTES = 4 << 20        # an archive is closed when its records have more compressed bytes
SEGMENT_BYTES = 32 << 10       # block bytes of one record
CHUNK_BYTES = 8 << 10          # bytes of one chunk of a chunked payload
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[at:at + size])
        at += size + 2


def _clean(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "%%%02X" % ord(m.group()), url or "")


def records(row: str, page: str, url: str | None, payload: bytes, refers_to: str | None,
            segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The compressed records of one page: a response, in segments where it is long, or a revisit.

    ``row`` makes the record's id its own; ``page`` names the page.  Payloads of
    more than one chunk are sent chunked, others with their length.
    """
    own = f"<urn:page:{page}#{row}>"
    base = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record([("WARC-Type", "revisit"), *base, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                       ("Content-Type", "application/http; msgtype=response")], block)
        return
    if len(payload) > CHUNK_BYTES:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), *base, kind], block)
        return
    yield _record([("WARC-Type", "response"), *base, ("WARC-Segment-Number", "1"), kind], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page}#{row}.{i}>"), ("WARC-Date", DATE),
                       ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(i)), *last], part)


def _write(archive_bytes: int, segment_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = n = row = 0

        def full() -> pd.DataFrame:
            nonlocal held, size, n
            out = pd.DataFrame({"archive": [f"{task:06d}-{n:06d}.warc.gz"], "content": [b"".join(held)]})
            held, size, n = [], 0, n + 1
            return out

        for pdf in batches:
            for page, url, html, refers in zip(pdf["page"], pdf["url"], pdf["html"], pdf["refers"]):
                payload = (html or "").encode("utf-8", "surrogatepass")
                for r in records(f"{task}-{row}", page, url, payload, refers, segment_bytes):
                    held.append(r)
                    size += len(r)
                    if size >= archive_bytes:
                        yield full()
                row += 1
        if held:
            yield full()
    return run


def write_archives(pages: DataFrame, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES,
                   segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html) in archives (archive, content).

    Of rows with equal payloads of at least ``min_payload`` bytes, the one with the
    smallest page_id is the response and others revisit it.
    """
    prepare(pages.sparkSession)
    key = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= min_payload
    keys = staged(pages.filter(long_enough).select("page_id", key.alias("_key")), "payloads")
    shared = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("response")).filter("copies > 1")
    rows = pages.select("page_id", "url", "html", F.when(long_enough, key).alias("_key"))
    rows = rows.withColumn("_key", F.coalesce("_key", F.concat(F.lit("-"), F.xxhash64("page_id", "html").cast("string"))))
    rows = attach(rows, shared, "_key", "copies", keys.count(), F.xxhash64("page_id", F.monotonically_increasing_id()))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("response")), F.col("response"))
    rows = rows.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "url", "html",
                       refers.cast("string").alias("refers"))
    return rows.mapInPandas(_write(archive_bytes, segment_bytes), "archive string, content binary")


def _members(content: bytes) -> Iterator[bytes]:
    """Decompressed gzip members of a file, or the whole of a plain one."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a record")
            piece = view[at:at + 65_536]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def _headers(lines: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.split("\r\n")[1:])}


def parse_archive(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(header lines, block) of each record."""
    for plain in _members(content):
        at = 0
        while at < len(plain):
            if plain[at:at + 2] == b"\r\n":
                at += 2
                continue
            end = plain.find(b"\r\n\r\n", at)
            if end < 0:
                raise ValueError("record without an end of headers")
            lines = plain[at:end].decode("utf-8", "surrogatepass")
            size = int(_headers(lines)["content-length"])
            block = plain[end + 4:end + 4 + size]
            if len(block) != size:
                raise ValueError("record shorter than its length")
            yield lines, block
            at = end + 4 + size


_RESULT = "page string, payload_bytes long, payload_digest string, record_type string, refers string, payload binary"
_SEGMENT = "origin string, number int, total long, lines string, block binary"
_RESULT_COLUMNS = [x.split()[0] for x in _RESULT.split(", ")]
_SEGMENT_COLUMNS = [x.split()[0] for x in _SEGMENT.split(", ")]


def _result(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    head, _, body = block.partition(b"\r\n\r\n")
    http = _headers(head.decode("latin-1"))
    page = re.match(r"<urn:page:([^#>]*)", headers["warc-record-id"]).group(1)
    stated = headers.get("warc-payload-digest", "").partition(":")[2]
    if headers["warc-type"] == "revisit":
        refers = re.match(r"<urn:page:([^#>]*)", headers["warc-refers-to"]).group(1)
        return page, int(http["content-length"]), stated, "revisit", refers, None
    payload = unchunked(body) if http.get("transfer-encoding", "").lower() == "chunked" else body
    found = digest(payload)
    if stated and stated != found:
        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    return page, len(payload), found, headers["warc-type"], None, payload if payloads else None


def _read(payloads: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for lines, block in parse_archive(content):
                    headers = _headers(lines)
                    kind = headers.get("warc-type")
                    if kind == "continuation" or "warc-segment-number" in headers:
                        total = headers.get("warc-segment-total-length")
                        rows.append((None,) * 6 + (headers.get("warc-segment-origin-id", headers["warc-record-id"]),
                                                   int(headers["warc-segment-number"]), int(total) if total else None, lines, block))
                    elif kind in ("response", "revisit"):
                        rows.append(_result(headers, block, payloads) + (None,) * 5)
                out = pd.DataFrame(rows, columns=_RESULT_COLUMNS + _SEGMENT_COLUMNS, dtype="object")
                for c, kind in (("payload_bytes", "Int64"), ("number", "Int32"), ("total", "Int64")):
                    out[c] = out[c].astype(kind)
                yield out
    return run


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a segmented record from (number, total length or None, bytes) in any order."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing or repeated")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] is None or parts[-1][1] != len(block):
        raise ValueError("the segments' length is not the stated total")
    return block


def _join(payloads: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        totals = [None if pd.isna(t) else int(t) for t in pdf["total"]]
        block = reassemble(list(zip(pdf["number"].tolist(), totals, pdf["block"].tolist())))
        first = _headers(next(h for h, n in zip(pdf["lines"], pdf["number"]) if n == 1))
        return pd.DataFrame([_result(first, block, payloads)], columns=_RESULT_COLUMNS)
    return run


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of ``archives`` (a ``content`` column of WARC bytes), segments reassembled.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, and
    the payload (null for revisits, and everywhere without ``payloads``).  A
    missing, repeated or short segment, a broken chunk and a wrong digest are
    errors, as the page's text would be wrong.  A segmented record is put together
    by one task, which holds that one record.
    """
    prepare(archives.sparkSession)
    read = staged(archives.select("content").mapInPandas(_read(payloads), f"{_RESULT}, {_SEGMENT}"), "records")
    whole = read.filter("origin IS NULL").select(*_RESULT_COLUMNS)
    parts = read.filter("origin IS NOT NULL").select(*_SEGMENT_COLUMNS)
    out = whole.unionByName(parts.groupBy("origin").applyInPandas(_join(payloads), _RESULT))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return out.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      number("refers").alias("refers_to"), "payload")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null and empty pages have an empty payload and are one group.  Rows that repeat
    the smallest page_id of their group are all responses.  Null page_ids are
    kept and revisit the group's smallest page_id; if no row of a group has an id,
    all are responses.  An empty table gives an empty result.  Other columns are
    not read.
    """
    archives = staged(write_archives(pages, **options), "archives")
    return read_archives(archives, payloads=False).drop("payload")
