"""Token-id files in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are ordered by id over all files, and rows say how many ids stand before theirs in their file; the
offset of a file is the sum of the files before it. Null texts count as empty and hold the end id alone; rows
that repeat an id stand side by side, by text; a null id comes first. Columns beside id and text are not read.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, runtime, textops

#: Words whose ids a worker remembers.
MEMO_WORDS = 300_000
END_ID = 0


@functools.cache
def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = np.zeros(256, "<u4")
    letters[printable] = printable
    rest = np.setdiff1d(np.arange(256), printable)
    letters[rest] = 256 + np.arange(len(rest))
    return letters


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.n = np.zeros(1024, dtype), 0

    def add(self, values) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(2 * n - self.n, self.held.dtype)])
        self.held[self.n:n] = values
        self.n = n

    def all(self) -> np.ndarray:
        return self.held[: self.n]


class WordIds:
    """Ids of words by a tokenizer file's own model, each word asked for once while it is remembered.

    Words are found by hash, in sorted order, and then compared letter by letter, all of a chunk at once; one that
    shares the hash of another is asked for wherever it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.forget()

    def forget(self) -> None:
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.letters, self.start, self.size = _Grown("<u4"), _Grown(np.int64), _Grown(np.int64)
        self.first, self.count, self.flat = _Grown(np.int64), _Grown(np.int64), _Grown(np.uint32)

    def _learn(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Numbers of new words, in order."""
        n = e - s
        letters = cp[bpe._spread(s, n)]
        data = letters.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        width = 1 + (letters > 0x7F).astype(np.int64) + (letters > 0x7FF) + (letters > 0xFFFF)
        ends = np.append(0, np.cumsum(width))[np.cumsum(n)].tolist()
        text = _byte_letters()[np.frombuffer(data, np.uint8)].tobytes().decode("utf-32-le")
        ids, count, at, ask = [], [], 0, self.model.tokenize
        for end in ends:
            found = ask(text[at:end])
            ids += [t.id for t in found]
            count.append(len(found))
            at = end
        number = self.first.n + np.arange(len(n))
        self.start.add(self.letters.n + np.cumsum(n) - n)
        self.size.add(n)
        self.letters.add(letters)
        self.first.add(self.flat.n + np.cumsum([0, *count])[:-1])
        self.count.add(count)
        self.flat.add(ids)
        return number

    def places(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Number of each span's word in ``first`` and ``count``, which say where in ``flat`` its ids are and how many."""
        names, shown, inverse = np.unique(textops.span_hashes(cp, s, e), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, names)
        new = np.flatnonzero((at == len(self.hashes)) | (names != np.append(self.hashes, np.uint64(0))[at]))
        if len(new):
            number = self._learn(cp, s[shown[new]], e[shown[new]])
            self.hashes, self.number = np.insert(self.hashes, at[new], names[new]), np.insert(self.number, at[new], number)
            at = np.searchsorted(self.hashes, names)
        out, size = self.number[at][inverse], e - s
        unlike = size != self.size.all()[out]
        n = np.where(unlike, 0, size)
        differ = cp[bpe._spread(s, n)] != self.letters.all()[bpe._spread(self.start.all()[out], n)]
        unlike[np.repeat(np.arange(len(n)), n)[differ]] = True
        odd = np.flatnonzero(unlike)
        if len(odd):
            out[odd] = self._learn(cp, s[odd], e[odd])
        return out


@functools.cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode_batch(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, the end id after each, where each text's ids end)."""
    memo, lengths, places = _word_ids(path), np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
    if memo.first.n > MEMO_WORDS:
        memo.forget()
    for cp, seg, of in textops.chunks(texts):
        s, e = textops.pretokens(cp)
        if len(s):
            lengths += np.bincount(textops.owners(s, seg, of), minlength=len(texts))
            places.append(memo.places(cp, s, e))
    word = np.concatenate(places)
    n = memo.count.all()[word]
    ends = np.append(0, np.cumsum(n))[np.cumsum(lengths)] + np.arange(1, len(texts) + 1)
    out = np.full(int(n.sum()) + len(texts), END_ID, np.uint32)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = memo.flat.all()[bpe._spread(memo.first.all()[word], n)]
    return out, ends


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts, the end id last."""
    ids, ends = encode_batch(texts, path)
    return np.split(ids, ends[:-1]) if len(texts) else []


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20, index_stride: int = 1000) -> None:
    """Encode every document and write ORC files in ascending order of id."""
    spark = docs.sparkSession
    runtime.prepare(spark)

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                flat, ends = encode_batch(texts[lo:lo + 256], tokenizer_path)
                n = np.diff(ends, prepend=0)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, 256), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n), ids], ["doc_id", "part", "local_start", "n_tokens", "ids"])
                at += int(ends[-1])

    id_type = docs.schema[id_col].dataType.simpleString()
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(runtime.buckets(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(runtime.lean(run), f"doc_id {id_type}, part int, local_start long, n_tokens long, ids array<int>").write
        .option("compression", "zstd").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_stride)
        .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; stripes are read in parallel."""
    rows = spark.read.orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))  # a row for each file
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents: file and stripe statistics, row indexes and Bloom filters skip the rest."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the crc covers ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        out = []
        for v in ids:
            got = v.values
            out.append(zlib.crc32(b"" if got is None else np.asarray(got, "<i4").tobytes()))
        return pa.array(out, pa.int64())

    return rows.select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
