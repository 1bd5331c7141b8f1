"""BAM as a Python data source: a partition for each stretch of compressed blocks, nothing but zlib needed.

``spark.dataSource.register(BamSource)``, then ``spark.read.format("bam").option("path", ...).load()``. Files
are local or mounted paths. Blocks carry their own sizes, so a stretch starts at a found block header; records
are taken up at the first offset from which a run of headers is plausible, and a record belongs to the stretch in
whose blocks it starts. With the option ``pushdown``, and Spark's setting for it, filters on mapq are tested first.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = (
    "read_id string, contig string, pos int, ref_end int, mapq int, flag int, is_reverse boolean, cigar string, "
    "ops array<struct<len:int,op:string>>, seq string, ns int, ts int, pi string, sp int, mm string, ml array<int>"
)
#: Letters of packed bases and of operations.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def block_size(data: bytes, at: int) -> int:
    """Compressed size of the block at a place, 0 if no block starts there."""
    if data[at:at + 4] != b"\x1f\x8b\x08\x04" or at + 18 > len(data):
        return 0
    (extra,) = struct.unpack_from("<H", data, at + 10)
    k, end = at + 12, at + 12 + extra
    while k + 4 <= min(end, len(data)):
        tag, n = data[k:k + 2], struct.unpack_from("<H", data, k + 2)[0]
        if tag == b"BC" and n == 2:
            return struct.unpack_from("<H", data, k + 4)[0] + 1
        k += 4 + n
    return 0


def blocks(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the blocks that start in a stretch of a file, then of those after it."""
    with open(path, "rb") as f:
        f.seek(start)
        head = f.read(1 << 17) if start else b""
        at = start
        if start:
            at = next((start + i for i in range(len(head)) if (n := block_size(head, i)) and (i + n + 18 > len(head) or block_size(head, i + n))), stop)
        while True:
            f.seek(at)
            head = f.read(18)
            n = block_size(head, 0)
            if not n:
                return
            f.seek(at)
            yield at, zlib.decompress(f.read(n), 31)
            at += n


def read_header(path: str) -> tuple[list[tuple[str, int]], int]:
    """(contigs and their lengths, bytes before the first record)."""
    data = b""
    for _, block in blocks(path, 0, 1):
        data += block
        if len(data) >= 12:
            if data[:4] != b"BAM\1":
                raise ValueError(f"{path} is not a BAM file")
            k = 8 + struct.unpack_from("<i", data, 4)[0]
            try:
                (n,), k, contigs = struct.unpack_from("<i", data, k), k + 4, []
                for _ in range(n):
                    (size,) = struct.unpack_from("<i", data, k)
                    name = data[k + 4:k + 3 + size].decode()
                    contigs.append((name, struct.unpack_from("<i", data, k + 4 + size)[0]))
                    k += 8 + size
            except struct.error:
                continue
            if k <= len(data):
                return contigs, k
    raise ValueError(f"{path} ends within its header")


def plausible(data: bytes, at: int, contigs: int) -> bool:
    """Whether a record could start at a place: sizes that fit, a known contig, a printable, ended name."""
    if at + 36 > len(data):
        return False
    size, ref, pos, name_n, _, _, ops, _, bases, mate = struct.unpack_from("<iiiBBHHHii", data, at)
    if not (32 + name_n + 4 * ops + (bases + 1) // 2 + bases <= size < 1 << 28 and -1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and name_n > 1 and bases >= 0):
        return False
    name = data[at + 36:at + 36 + name_n]
    return len(name) < name_n or name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1])


def tags(data: bytes) -> dict:
    """Optional fields of a record."""
    out, k = {}, 0
    while k + 3 <= len(data):
        name, kind = data[k:k + 2].decode(), chr(data[k + 2])
        k += 3
        if kind in "ZH":
            end = data.index(b"\0", k)
            out[name], k = data[k:end].decode(), end + 1
        elif kind == "B":
            item, n = chr(data[k]), struct.unpack_from("<I", data, k + 1)[0]
            out[name] = list(struct.unpack_from(f"<{n}{_CODES[item]}", data, k + 5))
            k += 5 + n * _SIZES[item]
        else:
            (out[name],) = struct.unpack_from(f"<{_CODES[kind]}", data, k)
            k += _SIZES[kind]
    return out


def parse(data: bytes, contigs: list[tuple[str, int]]) -> tuple:
    """A row of ``SCHEMA`` from a record's bytes, without its size field."""
    ref, pos, name_n, mapq, _, n_ops, flag, n_bases = struct.unpack_from("<iiBBHHHi", data, 0)
    k = 32 + name_n
    ops = [(v >> 4, OPS[v & 15]) for v in struct.unpack_from(f"<{n_ops}I", data, k)]
    k += 4 * n_ops
    packed = data[k:k + (n_bases + 1) // 2]
    bases = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_bases]
    t = tags(data[k + len(packed) + n_bases:])
    end = pos + sum(n for n, op in ops if op in "MDN=X")
    mm, ml = t.get("MM", t.get("Mm")), t.get("ML", t.get("Ml"))
    return (data[32:k - 4 * n_ops - 1].decode(), contigs[ref][0] if ref >= 0 else None, pos, end, mapq, flag, bool(flag & 16), "".join(f"{n}{op}" for n, op in ops), [{"len": n, "op": op} for n, op in ops], bases, t.get("ns"), t.get("ts"), t.get("pi"), t.get("sp"), mm, ml)


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("stretch", 64 << 20))
        self.least: dict[str, int] = {}

    def partitions(self):
        files = sorted(glob.glob(f"{self.path}/**/*.bam", recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [Stretch(p, at, at + self.size) for p in files for at in range(0, max(1, os.path.getsize(p)), self.size)]

    def read(self, partition):
        contigs, skip = read_header(partition.path)
        data, own, k, found = b"", None, 0, partition.start == 0
        stream = blocks(partition.path, partition.start, partition.stop)
        if found:
            k = skip
        ended = False
        while True:
            # ``own`` is where, in ``data``, the first byte lies that belongs to the next stretch.
            while not ended and len(data) < k + (1 << 18):
                got = next(stream, None)
                if got is None:
                    ended = True
                    break
                if got[0] >= partition.stop and own is None:
                    own = len(data)
                data += got[1]
            if not found:
                while k < len(data) and not self._starts(data, k, len(contigs), ended):
                    k += 1
                found = True
            if k + 4 > len(data) or own is not None and k >= own:
                return
            (size,) = struct.unpack_from("<i", data, k)
            while not ended and len(data) < k + 4 + size:
                got = next(stream, None)
                if got is None:
                    ended = True
                    break
                if got[0] >= partition.stop and own is None:
                    own = len(data)
                data += got[1]
            if len(data) < k + 4 + size:
                raise ValueError(f"{partition.path} ends within a record")
            if data[k + 4 + 9] >= self.least.get("mapq", 0):
                yield parse(data[k + 4:k + 4 + size], contigs)
            k += 4 + size
            if k > 1 << 20:
                data, own, k = data[k:], None if own is None else own - k, 0

    @staticmethod
    def _starts(data: bytes, at: int, contigs: int, ended: bool) -> bool:
        for _ in range(4):
            if at + 4 > len(data):
                return ended and at == len(data)
            if not plausible(data, at, contigs):
                return False
            at += 4 + struct.unpack_from("<i", data, at)[0]
            if at >= len(data):
                return True
        return True


class PushingBamReader(BamReader):
    """A reader that is told of filters; Spark allows it where ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters):
        """Least mapping quality is tested before a record is taken apart; all filters are still applied after."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and f.attribute == ("mapq",):
                self.least["mapq"] = max(self.least.get("mapq", 0), int(f.value) + isinstance(f, GreaterThan))
            yield f


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (PushingBamReader if pushing else BamReader)(self.options)


def record(row: dict, contigs: dict[str, int]) -> bytes:
    """A record's bytes, its size field included, from the columns that the reader gives."""
    name = row["read_id"].encode() + b"\0"
    ops = b"".join(struct.pack("<I", o["len"] << 4 | OPS.index(o["op"])) for o in row["ops"])
    bases = row["seq"]
    even = bases + "=" * (len(bases) % 2)
    packed = bytes(BASES.index(even[i]) << 4 | BASES.index(even[i + 1]) for i in range(0, len(even), 2))
    optional = b""
    for tag, column in (("ns", "ns"), ("ts", "ts"), ("sp", "sp")):
        if row.get(column) is not None:
            optional += tag.encode() + b"i" + struct.pack("<i", row[column])
    for tag, column in (("pi", "pi"), ("MM", "mm")):
        if row.get(column) is not None:
            optional += tag.encode() + b"Z" + row[column].encode() + b"\0"
    if row.get("ml") is not None:
        optional += b"MLBC" + struct.pack("<I", len(row["ml"])) + bytes(row["ml"])
    ref = contigs.get(row["contig"], -1)
    body = struct.pack("<iiBBHHHiiii", ref, row["pos"], len(name), row["mapq"], 0, len(row["ops"]), row["flag"], len(bases), -1, -1, 0)
    body += name + ops + packed + b"\xff" * len(bases) + optional
    return struct.pack("<i", len(body)) + body


def compress(data: bytes) -> bytes:
    """One BGZF block of at most 64 KiB of data."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path: str, contigs: list[tuple[str, int]], rows: Iterator[dict]) -> None:
    """A BAM file of the rows of one task."""
    names = {name: i for i, (name, _) in enumerate(contigs)}
    text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in contigs).encode()
    held = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for n, size in contigs:
        held += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    with open(path, "wb") as f:
        for row in rows:
            held += record(row, names)
            while len(held) >= 60_000:
                f.write(compress(held[:60_000]))
                held = held[60_000:]
        f.write(compress(held) + compress(b""))
