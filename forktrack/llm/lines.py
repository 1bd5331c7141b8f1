"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard verification and union-find.

A document's lines are split at line feeds, trimmed and lower-cased for comparison. Lines that are equal then are
one node; others are linked if the Jaccard similarity of their five-character shingles is 0.8 or more. Of each
component the first line stays, by document id, then line number (null ids first); the others are dropped from
their documents. Blank lines are never dropped. A line of fewer than five characters is one shingle. A null text
stays null and has no lines. Rows that repeat an id count as one place: they keep and lose the same lines. An
emptied document stays, with empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near, runtime, textops

U64 = np.uint64
WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 6
BINS = BANDS * ROWS
#: Bits of a line's odd sketch.
ODD = 512
#: Odd 32-bit multipliers, one for each character of a shingle.
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
_EMPTY = np.uint32(0xFFFFFFFF)
#: Where an empty bin looks, attempt by attempt.
_WALK = np.random.default_rng(6).integers(0, BINS, (48, BINS))


def _shingle_hashes(cp: np.ndarray) -> np.ndarray:
    """32-bit hash of the five characters from each place on."""
    c = cp.astype(np.uint32)
    n = max(0, len(c) - WIDTH + 1)
    h = np.zeros(n, np.uint32)
    for k, f in enumerate(_FACTORS):
        h += c[k:k + n] * np.uint32(f)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(16))


def _line_shingles(lines: list[str]):
    """(line index, 32-bit hash) of each shingle, chunk by chunk."""
    for cp, seg, owner in textops.chunks(lines):
        ends = np.append(seg[1:], len(cp)) - 1
        h = _shingle_hashes(cp)
        room = np.repeat(ends, np.diff(np.append(seg, len(cp))))[: len(h)] - np.arange(len(h))
        full = np.flatnonzero(room >= WIDTH)
        yield np.repeat(owner, np.diff(np.append(seg, len(cp))))[full], h[full]
        short = np.flatnonzero((ends - seg > 0) & (ends - seg < WIDTH))
        if len(short):
            yield owner[short], (textops.span_hashes(cp, seg[short], ends[short]) >> U64(32)).astype(np.uint32)


def sign(lines: list[str]) -> np.ndarray:
    """A 64-bit value for each band of one-permutation MinHash signatures.

    An empty bin takes the value of another bin, by a walk that is the same for all lines: first by hashed steps, so
    that the bins of a band borrow from different ones, at last from the next full bin.
    """
    best = np.full(len(lines) * BINS, _EMPTY)
    for owner, h in _line_shingles(lines):
        slot = owner * BINS + ((h.astype(U64) * U64(BINS)) >> U64(32)).astype(np.int64)
        np.minimum.at(best, slot, h * np.uint32(0x9E3779B1) >> np.uint32(1))
    grid = best.reshape(-1, BINS)
    gaps = grid == _EMPTY
    some = np.flatnonzero(gaps.any(1) & ~gaps.all(1))
    filled, full = grid[some], grid[some]
    row, bin_ = np.nonzero(gaps[some])
    for step in _WALK:
        if not len(row):
            break
        found = full[row, step[bin_]]
        filled[row, bin_] = found
        left = found == _EMPTY
        row, bin_ = row[left], bin_[left]
    for _ in range(2 if len(row) else 0):
        for k in range(BINS - 1, -1, -1):
            gap = filled[:, k] == _EMPTY
            filled[gap, k] = filled[gap, (k + 1) % BINS]
    grid[some] = filled
    cut = grid.reshape(-1, BANDS, ROWS).astype(U64)
    return textops.combine([np.broadcast_to(np.arange(BANDS, dtype=U64), (len(cut), BANDS)).ravel(), *(cut[:, :, r].ravel() for r in range(ROWS))]).reshape(-1, BANDS)


def similarity(left: list[str], right: list[str]) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of pairs of lines."""

    def every(lines):
        owner, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for cp, seg, of in textops.chunks(lines):
            ends = np.append(seg[1:], len(cp)) - 1
            size = ends - seg
            n = np.where(size >= WIDTH, size - WIDTH + 1, (size > 0).astype(np.int64))
            start = _runs(seg, n)
            width = np.repeat(np.minimum(size, WIDTH), n)
            owner.append(np.repeat(of, n))
            hashes.append(textops.span_hashes(cp, start, start + width))
        return np.concatenate(owner), np.concatenate(hashes)

    return near.jaccard(len(left), every(left), every(right), False)


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def elements(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line index, shingle) of all lines, by line, each shingle once."""
    owner, item = (np.concatenate(x) for x in zip(*([(np.zeros(0, np.int64), np.zeros(0, np.uint32))] + list(_line_shingles(lines)))))
    key = textops.distinct(owner.astype(U64) << U64(32) | item.astype(U64))
    return (key >> U64(32)).astype(np.int64), key & U64(0xFFFFFFFF)


def split(text: str | None) -> list[str]:
    """A text's lines as they are compared."""
    return [] if text is None else [line.strip().lower() for line in text.split("\n")]


def node_ids(lines: list[str]) -> np.ndarray:
    """64-bit hash of each line; the caller leaves out blank ones."""
    return np.fromiter((xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines), U64, len(lines))


def _blocks(buckets: int, batch_chars: int):
    def run(batches):
        seen: dict[str, None] = {}
        size = 0

        def flush():
            lines = list(seen)
            values = np.concatenate([sign(lines[at:at + 256]) for at in range(0, len(lines), 256)])
            return near.pack(values, node_ids(lines), buckets)

        for b in batches:
            for text in b.column(0):
                for line in split(text.as_py()):
                    if line and line not in seen:
                        seen[line] = None
                        size += len(line)
                if size >= batch_chars:
                    yield flush()
                    seen, size = {}, 0
        if seen:
            yield flush()

    return run


def _places(batches):
    """(id, line, node) of each non-blank line of (id, text) rows."""
    for b in batches:
        keys, texts = b.column(0), b.column(1).to_pylist()
        for at in range(0, len(texts), 128):
            lines = [split(t) for t in texts[at:at + 128]]
            flat = [(i, k, line) for i, own in enumerate(lines) for k, line in enumerate(own) if line]
            node = pa.array(node_ids([f[2] for f in flat]).view(np.int64))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array([at + f[0] for f in flat], pa.int64())), pa.array([f[1] for f in flat], pa.int32()), node], ["id", "line", "node"])


def _nodes(batches):
    """(node, text) of the non-blank lines of texts, each once a batch."""
    for b in batches:
        lines = list(dict.fromkeys(line for t in b.column(0).to_pylist() for line in split(t) if line))
        yield pa.RecordBatch.from_arrays([pa.array(node_ids(lines).view(np.int64)), pa.array(lines, pa.string())], ["node", "text"])


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 9_000_000) -> DataFrame:
    """(id, lines): for each document that loses some, the numbers from 0 of the lines it loses."""
    spark = docs.sparkSession
    runtime.prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = rows.select("text").mapInArrow(runtime.lean(_blocks(runtime.buckets(rows), batch_chars)), near.BLOCKS)

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = near.few(nodes, nodes.count())
        return rows.select("text").mapInArrow(runtime.lean(_nodes), "node long, text string").join(wanted, "node", "left_semi").dropDuplicates(["node"])

    roots = near.groups(blocks, texts_of, sign, similarity, THRESHOLD, elements, ODD)
    places = runtime.stored(rows.mapInArrow(runtime.lean(_places), f"id {id_type}, line int, node long"), "places")
    known = near.few(roots, roots.count())
    rooted = places.join(known, "node", "left").select("id", "line", F.coalesce("root", "node").alias("root"))
    none = F.max(F.col("id").isNull())
    first = rooted.groupBy("root").agg(F.min("id").alias("least"), none.alias("none"), F.count("*").alias("n")).where("n > 1").select("root", "least", "none")
    stays = F.when(F.col("none"), F.col("id").isNull()).otherwise(F.col("id") == F.col("least"))
    shared = rooted.join(runtime.stored(first, "first-ids"), "root").select("id", F.struct("line", "root", stays.alias("stays")).alias("own"))
    lost = shared.groupBy("id").agg(F.collect_set("own").alias("own")).mapInArrow(runtime.lean(_lost), f"id {id_type}, lines array<int>")
    return lost.where(F.size("lines") > 0)


def _lost(batches):
    """(id, lines that go) of (id, its lines that share a component): of the document where a component's first line
    is, the least line of each such component stays."""
    for b in batches:
        own = b.column("own")
        size = own.value_lengths().to_numpy()
        line, root, stays = (np.asarray(c) for c in own.flatten().flatten())
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((line, root, row))
        head = np.ones(len(order), bool)
        head[1:] = (row[order][1:] != row[order][:-1]) | (root[order][1:] != root[order][:-1])
        goes = ~stays
        goes[order[~head]] = True
        order = np.lexsort((line, row))
        order = order[goes[order]]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[order], minlength=len(size)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(line[order].astype(np.int32)))], ["id", "lines"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that duplicate an earlier one removed from their texts; all rows and columns stay."""
    whose, gone = runtime.spare(docs, "lost_id"), runtime.spare(docs, "lost_lines")
    lost = runtime.stored(duplicates(docs, id_col, text_col).select(F.col("id").alias(whose), F.col("lines").alias(gone)), "lost-lines")

    @F.arrow_udf("string")
    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, lines in zip(texts, gone):
            value, drop = text.as_py(), set(lines.as_py() or ())
            out.append("\n".join(t for k, t in enumerate(value.split("\n")) if k not in drop) if drop and value is not None else value)
        return pa.array(out, pa.string())

    joined = docs.join(near.few(lost, lost.count()), docs[id_col].eqNullSafe(F.col(whose)), "left")
    kept = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col(gone)))
    return joined.select(*[kept.alias(text_col) if c == text_col else F.col(c) for c in docs.columns])


def report(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, text_sha256) of cleaned documents; blank lines don't count."""
    text = F.col(text_col)
    n = F.size(F.filter(F.split(text, "\n"), lambda line: F.trim(line) != ""))
    return cleaned.select(id_col, F.when(text.isNull(), 0).otherwise(n).alias("n_lines"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"))
