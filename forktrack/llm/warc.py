"""WARC records in ZIP packages: written by partition, read by ranges without extraction.

A package holds ``archive/data.warc.gz``, one gzip member a record, and ``indexes/index.cdxj``, both stored, so
that a record is a byte range of the package. The reader parses the end record, the ZIP64 end record and the
central directory, finds the stored members, reads the index, and fetches records by offset and length.

Null html counts as empty; a null url is written as empty; control characters in urls are escaped. Of payloads
of ``least`` bytes or more that are equal, the one with the smallest page id is a response and the others revisit
it (rows that share the smallest id are all responses); shorter ones are all responses. Other columns are not
read. No pages give no packages and no rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near, runtime

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A package ends after so many payload bytes; records are fetched in stretches of so many package bytes.
PACKAGE_BYTES, STRETCH = 64 << 20, 4 << 20


# Writing


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """A WARC record: HTTP head and payload, or for a revisit the head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def package(out, records: Iterator[tuple[str, bytes]]) -> int:
    """Write (key, record) pairs as one package; ZIP64 sizes throughout. Gives the number of records."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        index, at = [], 0
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
            for key, data in records:
                packed = _gzip(data)
                member.write(packed)
                index.append(json.dumps({"key": key, "offset": at, "length": len(packed)}))
                at += len(packed)
        with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            member.write("".join(f"{line}\n" for line in index).encode())
    return len(index)


def write(pages: DataFrame, path: str, least: int = 100) -> DataFrame:
    """Write all pages as packages under ``path``; gives a written table (uri, records) of them."""
    spark = pages.sparkSession
    runtime.prepare(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).alias("size"), F.sha2(html, 256).alias("digest"))
    again = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = runtime.stored(again.select(F.col("digest").alias("_digest"), "first"), "repeated-payloads")
    known = near.few(again, again.count())
    marked = rows.join(known, (F.col("digest") == F.col("_digest")) & (F.col("size") >= least), "left")
    marked = marked.select("page_id", "url", "html", "digest", "first", (F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches):
        store, part, number = runtime.FileStore(path), TaskContext.get().partitionId(), 0
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        ahead = next(rows, None)
        while ahead is not None:

            def some():
                nonlocal ahead
                size = 0
                while ahead is not None and size < PACKAGE_BYTES:
                    page_id, url, text, digest, first, revisit = ahead
                    payload = text.encode()
                    size += len(payload)
                    yield str(page_id), record(page_id, url, payload, digest, first, revisit)
                    ahead = next(rows, None)

            name, n = f"pages-{part:06d}-{number:04d}.zip", [0]
            store.write(name, lambda f: n.__setitem__(0, package(f, some())))
            yield pa.RecordBatch.from_pydict({"uri": [f"{path}/{name}"], "records": [n[0]]})
            number += 1

    return runtime.stored(marked.mapInArrow(run, "uri string, records long"), "packages")


# Reading


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    offset: int


def _range(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def members(f) -> list[Member]:
    """The central directory of a ZIP file, ZIP64 fields included; offsets are of local headers."""
    end = f.seek(0, io.SEEK_END)
    tail_at = max(0, end - (1 << 16) - 22)
    tail = _range(f, tail_at, end - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    locator = tail_at + at - 20
    if locator >= 0 and (mark := _range(f, locator, 20))[:4] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", mark, 8)
        count, size, start = struct.unpack_from("<QQQ", _range(f, end64, 56), 32)
    directory, out, at = _range(f, start, size), [], 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, name_n, extra_n, note_n, offset = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46:at + 46 + name_n].decode()
        extra, k = directory[at + 46 + name_n:at + 46 + name_n + extra_n], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:
                fields = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = fields.pop(0) if full == 0xFFFFFFFF else full
                packed = fields.pop(0) if packed == 0xFFFFFFFF else packed
                offset = fields.pop(0) if offset == 0xFFFFFFFF else offset
            k += 4 + n
        out.append(Member(name, method, packed, offset))
        at += 46 + name_n + extra_n + note_n
    return out


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = _range(f, member.offset, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return member.offset + 30 + name_n + extra_n


def locate(f) -> list[tuple[str, int, int]]:
    """(key, offset in the package, length) of every record, from the stored index."""
    found = {m.name: m for m in members(f)}
    base, at = data_start(f, found[DATA]), data_start(f, found[INDEX])
    lines = _range(f, at, found[INDEX].size).decode().splitlines()
    return [(e["key"], base + e["offset"], e["length"]) for e in map(json.loads, lines)]


def parse(data: bytes) -> dict:
    """Headers of a record by lower-case name, its HTTP head's length of payload, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)content-length: *(\d+)", http)
    return {"headers": headers, "length": int(length[1]) if length else len(payload), "payload": payload}


def read(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record of packages.

    Bytes and digest of a response are those of the payload that was read; a revisit has them in its headers.
    """
    runtime.prepare(spark)

    def places(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                with runtime.FileStore(uri).open() as f:
                    found = locate(f)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(found)), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], ["uri", "at", "length"])

    def fetch(batches):
        f, at_uri = None, None
        for b in batches:
            out = []
            for uri, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if uri != at_uri:
                    if f:
                        f.close()
                    f, at_uri = runtime.FileStore(uri).open(), uri
                r = parse(zlib.decompress(_range(f, at, n), 31))
                h, revisit = r["headers"], r["headers"]["warc-type"] == "revisit"
                digest = h["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha256(r["payload"]).hexdigest()
                out.append((_id(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], _id(h["warc-refers-to"]) if revisit else None, r["length"] if revisit else len(r["payload"]), digest, None if revisit else r["payload"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        if f:
            f.close()

    spots = packages.select("uri").mapInArrow(places, "uri string, at long, length long")
    dealt = spots.repartition(runtime.partitions(spark), "uri", (F.col("at") / STRETCH).cast("long")).sortWithinPartitions("uri", "at")
    return dealt.mapInArrow(fetch, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _id(urn: str) -> int | None:
    text = urn.strip("<>").rpartition(":")[2]
    return int(text) if text else None
