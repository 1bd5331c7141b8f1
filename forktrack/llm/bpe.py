"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into batches. Each batch is dictionary-coded: a row of word codes by position for its documents,
and its distinct pre-tokens, exploded into one block for each word bucket. Blocks of a bucket meet in one task,
which encodes each distinct word once; the ids go back to the batch and are put at their words' positions.
A frequent word is one entry of a batch's block however often it occurs, so no key is hot.

Null texts count as empty and encode to no ids. Rows are kept apart, so repeated or null ids are fine. A batch is
named by its task and place; give documents that can be read again alike, as from files.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textops

#: Distinct words after which a batch ends, and words that a task remembers.
BATCH_WORDS = 300_000
MEMO_WORDS = 300_000
_ONE, _TWO = 200, 40  # codes of one byte; first bytes of two-byte codes, the rest start three-byte codes
_FEW = _ONE + _TWO * 256
_MANY = _FEW + (256 - _ONE - _TWO) * 65536


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(n) for t, n in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one word, lowest rank first, leftmost among equals."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 62:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@functools.cache
def _encoder(path: str):
    """Function from a word's bytes to its ids."""
    ranks = load_ranks(path)
    import tiktoken

    core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    if hasattr(core, "encode_single_piece"):
        return core.encode_single_piece
    return lambda word: merge_word(word, ranks)


@functools.cache
def token_table(path: str) -> pa.Array:
    """Token bytes by id; unused ids are empty."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, n in ranks.items():
        table[n] = token
    return pa.array(table, pa.large_binary())


@functools.cache
def _decimal(size: int) -> pa.Array:
    return pa.array([b"%d " % n for n in range(size)], pa.large_binary())


def take_bytes(table: pa.Array, ids: np.ndarray) -> memoryview:
    """Concatenated bytes of table entries: the join of ids with the token table, in order."""
    got = table.take(pa.array(ids))
    if not len(got):
        return memoryview(b"")
    offsets = np.frombuffer(got.buffers()[1], np.int64)[got.offset:got.offset + len(got) + 1]
    return memoryview(got.buffers()[2])[offsets[0]:offsets[-1]]


def _new_words(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """UTF-8 of spans, by one decoding of all."""
    n = ends - starts
    text = cp[_spread(starts, n)].tobytes().decode("utf-32-le", "surrogatepass")
    at = np.cumsum(n)
    return [text[a:b].encode("utf-8", "surrogatepass") for a, b in zip((at - n).tolist(), at.tolist())]


class Batch:
    """Documents dictionary-coded as they come: word codes by position, distinct words in order of appearance."""

    def __init__(self):
        self.keys: list[str | None] = []
        self.lengths: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.known: dict[bytes, int] = {}
        self.hashes = array("Q")
        self.chars = 0

    def add(self, keys: list, texts: list[str | None]) -> None:
        self.keys += keys
        self.chars += sum(len(t or "") for t in texts)
        lengths = np.zeros(len(texts), np.int64)
        for cp, seg, of in textops.chunks(texts):
            s, e = textops.pretokens(cp)
            if not len(s):
                continue
            lengths += np.bincount(textops.owners(s, seg, of), minlength=len(texts))
            self.codes.append(self._coded(cp, s, e))
        self.lengths.append(lengths)

    def _coded(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Codes of words, told apart by their bytes: a hash only finds the likely equals, which are then compared."""
        names, place, inverse = np.unique(textops.span_hashes(cp, s, e), return_index=True, return_inverse=True)
        shown, size = place[inverse], e - s
        unlike = size != size[shown]
        n = np.where(unlike, 0, size)
        differ = cp[_spread(s, n)] != cp[_spread(s[shown], n)]
        unlike[np.repeat(np.arange(len(n)), n)[differ]] = True
        code = self._codes(_new_words(cp, s[place], e[place]), names)[inverse]
        odd = np.flatnonzero(unlike)
        if len(odd):
            code[odd] = self._codes(_new_words(cp, s[odd], e[odd]), names[inverse[odd]])
        return code

    def _codes(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        known, before = self.known, len(self.known)
        code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words))
        new = np.flatnonzero(code >= before)
        _, first = np.unique(code[new], return_index=True)
        self.hashes.extend(hashes[new[first]].tolist())
        return code

    def rows(self, number: int, buckets: int):
        """A row of all codes, then a block of words for each bucket that has some.

        The commonest words have the lowest codes, told in their blocks; others are numbered block by block.
        """
        codes = np.concatenate([np.zeros(0, np.uint32), *self.codes])
        words = list(self.known)
        n = len(words)
        spread = (np.array(self.hashes, np.uint64) % np.uint64(buckets)).astype(np.int64)
        common = np.argsort(-np.bincount(codes, minlength=n), kind="stable")[:_FEW]
        rank = np.full(n, -1, np.int64)
        rank[common] = np.arange(len(common))
        order = np.lexsort((rank < 0, spread))
        rest = order[rank[order] < 0]
        rank[rest] = len(common) + np.arange(len(rest))
        cut = np.searchsorted(spread[order], np.arange(buckets + 1))
        head = np.concatenate([[n], *self.lengths]).astype("<i8").tobytes()
        yield number % buckets, number, -1, head, _zip(pack_codes(rank.astype(np.uint32)[codes], n)), b"", self.keys
        for k in range(buckets):
            own = order[cut[k]:cut[k + 1]]
            if len(own):
                told = rank[own[rank[own] < len(common)]]
                base = rank[own[len(told)]] if len(told) < len(own) else 0
                block = [words[i] for i in own.tolist()]
                yield k, number, k, _pack_sizes(np.fromiter(map(len, block), np.int64, len(block))), _zip(b"".join(block)), np.array([len(told), base], "<u4").tobytes() + told.astype("<u2").tobytes(), None


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_sizes(n: np.ndarray) -> bytes:
    return b"\1" + n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else b"\4" + n.astype("<u4").tobytes()


def _unpack_sizes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if data[0] == 1 else "<u4", offset=1)


def pack_codes(codes: np.ndarray, words: int) -> bytes:
    """One to three bytes for each code; plain 32-bit numbers if there are more words than three bytes can name."""
    if words > _MANY:
        return codes.astype("<u4").tobytes()
    two, three = (codes >= _ONE) & (codes < _FEW), codes >= _FEW
    lead = codes.astype(np.uint8)
    short, long = codes[two] - _ONE, codes[three] - _FEW
    lead[two] = _ONE + (short >> 8)
    lead[three] = _ONE + _TWO + (long >> 16)
    return lead.tobytes() + short.astype(np.uint8).tobytes() + long.astype("<u2").tobytes()


def unpack_codes(data: bytes, n: int, words: int) -> np.ndarray:
    """The codes again: leading bytes of all, then the second bytes of some, then the other two of the rest."""
    if words > _MANY:
        return np.frombuffer(data, "<u4")
    lead = np.frombuffer(data, np.uint8, n)
    two, three = (lead >= _ONE) & (lead < _ONE + _TWO), lead >= _ONE + _TWO
    out = lead.astype(np.uint32)
    out[two] = _ONE + ((out[two] - _ONE) << 8) + np.frombuffer(data, np.uint8, int(two.sum()), n)
    out[three] = _FEW + ((out[three] - _ONE - _TWO) << 16) + np.frombuffer(data, "<u2", int(three.sum()), n + int(two.sum()))
    return out


_NAMES = ["bucket", "batch", "part", "sizes", "body", "rows", "ids"]
_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()))
_PACKED = "bucket int, batch long, part int, sizes binary, body binary, rows binary, ids array<string>"


def _explode(buckets: int, batch_chars: int):
    """Batches of (id, text) rows to dictionary-coded rows: part -1 has a batch's documents, others its words."""

    def table(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, Batch()
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(keys), 64):
                held.add(keys[at:at + 64], texts[at:at + 64])
                if held.chars >= batch_chars or len(held.known) >= BATCH_WORDS:
                    yield table(held.rows(number, buckets))
                    number, held = number + 1, Batch()
        if held.keys:
            yield table(held.rows(number, buckets))

    return run


def _encode_words(path: str):
    """Word blocks become blocks of ids; each distinct word of a task's buckets is encoded once."""

    def run(batches):
        encode, memo = _encoder(path), {}
        for b in batches:
            part, sizes, body = b.column("part").to_pylist(), b.column("sizes").to_pylist(), b.column("body").to_pylist()
            for i, p in enumerate(part):
                if p < 0:
                    continue
                at, counts, ids, words = 0, [], array("I"), _unzip(body[i])
                if len(memo) > MEMO_WORDS:
                    memo = {}
                for n in _unpack_sizes(sizes[i]).tolist():
                    word = words[at:at + n]
                    at += n
                    got = memo.get(word)
                    if got is None:
                        got = memo[word] = array("I", encode(word))
                    counts.append(len(got))
                    ids.extend(got)
                flat = np.frombuffer(ids, np.uint32)
                wide = 2 if flat.max() < 65536 else 4
                sizes[i] = _pack_sizes(np.array(counts))
                body[i] = _zip(flat.astype(f"<u{wide}").tobytes()) + bytes([wide])
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("batch"), b.column("part"), pa.array(sizes, pa.binary()), pa.array(body, pa.binary()), b.column("rows"), b.column("ids")], b.schema.names)

    return run


def _assemble(table: pa.Table) -> pa.Table:
    """All rows of one batch to its documents' ids, as little-endian 32-bit numbers."""
    part = table.column("part").to_pylist()
    sizes, body, rows = (table.column(c).to_pylist() for c in ("sizes", "body", "rows"))
    head = part.index(-1)
    lengths = np.frombuffer(sizes[head], "<i8")
    words, lengths = int(lengths[0]), lengths[1:]
    count = np.zeros(words, np.int64)
    blocks = []
    for i, p in enumerate(part):
        if p >= 0:
            n = _unpack_sizes(sizes[i]).astype(np.int64)
            told, base = np.frombuffer(rows[i], "<u4", 2).tolist()
            own = np.concatenate([np.frombuffer(rows[i], "<u2", told, 8).astype(np.int64), base + np.arange(len(n) - told)])
            blocks.append((own, n, np.frombuffer(_unzip(body[i][:-1]), f"<u{body[i][-1]}")))
            count[own] = n
    first = np.cumsum(count) - count
    flat = np.zeros(int(count.sum()), "<u4")
    for own, n, ids in blocks:
        flat[_spread(first[own], n)] = ids
    codes = unpack_codes(_unzip(body[head]), int(lengths.sum()), words)
    n = count[codes]
    ids = flat[_spread(first[codes], n)]
    ends = np.cumsum(np.concatenate([[0], n]))[np.cumsum(lengths)]
    starts = np.concatenate([[0], ends[:-1]])
    keys = table.column("ids").to_pylist()[head]
    return pa.table({"id": pa.array(keys, pa.string()), "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())})


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + n[0] - 1, first[1], ..."""
    out = np.repeat(first - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 9_000_000, digest: bool = False) -> DataFrame:
    """(id, ids) of every row: ``ids`` are little-endian unsigned 32-bit token ids. Other columns are not read.

    With ``digest``, (id, n_tokens, ids_sha256, decoded_sha256) instead, made where the ids are put together; the
    decoded bytes come from the ids alone.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    buckets = runtime.buckets(docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    packed = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(runtime.lean(_explode(buckets, batch_chars)), _PACKED)
    words = packed.repartition(buckets, "bucket").mapInArrow(runtime.lean(_encode_words(ranks_path)), _PACKED)
    by_batch = words.drop("bucket").groupBy("batch")
    if digest:
        done = by_batch.applyInArrow(_digested(ranks_path), "id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    else:
        done = by_batch.applyInArrow(_assemble, "id string, ids binary")
    return done.select(F.col("id").cast(id_type).alias(id_col), *done.columns[1:])


def _digested(ranks_path: str):
    def run(rows: pa.Table) -> pa.Table:
        out = _digest(_assemble(rows), ranks_path)
        runtime.release()
        return out

    return run


def decode_ids(ids: bytes, ranks_path: str) -> bytes:
    return bytes(take_bytes(token_table(ranks_path), np.frombuffer(ids, "<u4")))


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, data): the bytes of each row's ids, joined from the token-byte table, which has the vocabulary's size."""

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        return pa.array([decode_ids(v.as_py() or b"", ranks_path) for v in ids], pa.binary())

    return encoded.select(id_col, run("ids").alias("data"))


def _digest(rows: pa.Table, ranks_path: str) -> pa.Table:
    table = token_table(ranks_path)
    decimal, out = _decimal(len(table)), []
    for value in rows.column("ids"):
        ids = np.frombuffer(value.as_py(), "<u4")
        out.append((len(ids), hashlib.sha256(take_bytes(decimal, ids)[:-1]).hexdigest(), hashlib.sha256(take_bytes(table, ids)).hexdigest()))
    n, shown, decoded = zip(*out)
    return pa.table({"id": rows.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(shown), "decoded_sha256": pa.array(decoded)})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")

