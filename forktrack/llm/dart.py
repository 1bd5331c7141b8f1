"""Near-duplicate documents by DartMinHash over five-word shingles weighted by their counts.

Every unit of weight of a shingle is a column of the plane (weight, rank); darts fall on it as a Poisson process
that hashes decide, and those in a document's region under a rank limit are its own. The earliest dart at each
coordinate signs the document: two documents agree there with the probability of their weighted Jaccard
similarity. The limit is set to give about k ln k + 2k darts and doubled while a coordinate has none.

Documents with the same words are one node. Documents without words, empty and null texts among them, are in no
group and stand for themselves. A text of fewer than five words is one shingle. A group's class is its least
document id (nulls count as largest); rows that repeat an id count like any others.
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
BANDS, ROWS = 24, 6
#: Bits of a document's odd sketch.
ODD = 1024
_BATCH = 256


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes to (0, 1)."""
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signature(n: int, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, coordinates: int) -> np.ndarray:
    """(n, coordinates) signatures of weighted sets given as parallel arrays sorted by owner; no elements: zeros.

    An element may have any positive weight: its last column holds darts at weights below its own alone.
    """
    columns = np.ceil(weight).astype(np.int64)
    column = np.arange(int(columns.sum())) - np.repeat(np.cumsum(columns) - columns, columns)
    base = textops.combine([np.repeat(element, columns), column.astype(U64)])
    reach = np.repeat(weight, columns) - column
    of = np.repeat(owner, columns)
    total = np.bincount(owner, weight, n)
    expected = coordinates * np.log(coordinates) + 2 * coordinates
    limit = expected / np.maximum(total, 1e-300)
    out = np.zeros((n, coordinates), U64)
    todo = total > 0
    while todo.any():
        alive = np.flatnonzero(todo[of])
        best, mark = np.full(n * coordinates, np.inf), out.reshape(-1)
        rank, step, hits = np.zeros(len(alive)), 0, []
        while len(alive):
            step += 1
            h = textops.mix64(base[alive] + U64((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            rank = rank - np.log(_unit(h))
            under = rank < limit[of[alive]]
            alive, rank, h = alive[under], rank[under], h[under]
            where = textops.mix64(h ^ U64(0xA5A5A5A5A5A5A5A5))
            inside = reach[alive] >= 1
            if not inside.all():
                inside |= _unit(textops.mix64(where)) < reach[alive]
            slot = of[alive[inside]] * coordinates + (where[inside] % U64(coordinates)).astype(np.int64)
            np.minimum.at(best, slot, rank[inside])
            hits.append((slot, rank[inside], h[inside]))
        for slot, at, h in hits:
            won = best[slot] == at
            mark[slot[won]] = h[won]
        short = todo & np.isinf(best.reshape(n, coordinates)).any(1)
        limit[short] *= 2
        todo = short
    return out


def weighted_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, count) of all texts, by text."""
    owner, h = textops.shingles(*textops.hashed_words(texts), WIDTH)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    return owner[start], h[start], np.diff(np.append(start, len(h))).astype(np.float64)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band of signature rows."""
    cut = signature.reshape(len(signature), BANDS, ROWS)
    return textops.combine([np.broadcast_to(np.arange(BANDS, dtype=U64), (len(cut), BANDS)).ravel(), *(cut[:, :, r].ravel() for r in range(ROWS))]).reshape(-1, BANDS)


def sign(texts: list[str | None]) -> np.ndarray:
    return bands(dart_signature(len(texts), *weighted_shingles(texts), BANDS * ROWS))


def elements(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, element) of all texts, by text; the nth occurrence of a shingle is an element of its own."""
    owner, element, count = weighted_shingles(texts)
    times = count.astype(np.int64)
    turn = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(owner, times), np.repeat(element, times) + turn.astype(U64) * U64(textops.BASE_B)


def node_ids(texts: list[str | None]) -> list[int | None]:
    """64-bit hash of each text's lower-cased words in order; None for a text without words."""
    digest, some = [xxhash.xxh3_64() for _ in texts], [False] * len(texts)
    for cp, seg, owner in textops.chunks(texts, lower=True):
        s, e = textops.words(cp)
        # The characters of words, and a space after each.
        step = np.zeros(len(cp) + 2, np.int8)
        step[s] = 1
        step[e + 1] -= 1
        keep = np.cumsum(step[:len(cp)]).astype(bool)
        shown = cp.copy()
        shown[e] = 0x20
        kept = np.concatenate([[0], np.cumsum(keep)])
        data = shown[keep].astype("<u4").tobytes()
        for a, b, of in zip(kept[seg].tolist(), kept[np.append(seg[1:], len(cp))].tolist(), owner.tolist()):
            if a < b:
                digest[of].update(data[4 * a:4 * b])
                some[of] = True
    return [int(np.uint64(d.intdigest()).astype(np.int64)) if k else None for d, k in zip(digest, some)]


def similarity(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """Exact weighted Jaccard similarity of pairs of texts."""
    a, b = (textops.shingles(*textops.hashed_words(t), WIDTH) for t in (left, right))
    return near.jaccard(len(left), a, b, True)


def nodes_of(docs: DataFrame, text_col: str):
    """Column with a text's node id."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        every = texts.to_pylist()
        return pa.array([i for at in range(0, len(every), 64) for i in node_ids(every[at:at + 64])], pa.int64())

    return run(F.col(text_col))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, root, class_id) of every row; rows of one class are near-duplicates, linked at 0.8 or more.

    ``root`` tells classes apart even where rows of several classes share an id; it is null for rows without words.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    buckets = runtime.buckets(docs)
    known = runtime.stored(docs.select(F.col(id_col).alias("id"), nodes_of(docs, text_col).alias("node")), "doc-nodes")

    def run(batches):
        held, values, size = [], [], 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), _BATCH):
                part = texts[at:at + _BATCH]
                ids = node_ids(part)
                use = [i for i, k in enumerate(ids) if k is not None]
                if use:
                    held.append(np.array([ids[i] for i in use], np.int64).view(U64))
                    values.append(sign([part[i] for i in use]))
                    size += len(use)
                if size >= 20_000:
                    yield near.pack(np.concatenate(values), np.concatenate(held), buckets)
                    held, values, size = [], [], 0
        if held:
            yield near.pack(np.concatenate(values), np.concatenate(held), buckets)

    def texts_of(nodes: DataFrame) -> DataFrame:
        first = known.where("node is not null").groupBy("node").agg(F.min("id").alias("id"))
        wanted = runtime.stored(first.join(nodes, "node", "left_semi"), "wanted")
        ids = near.few(wanted.select(F.col("id").alias("want")).distinct(), wanted.count())
        some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id").eqNullSafe(F.col("want")), "left_semi")
        marked = some.withColumn("node", nodes_of(some, "text")).where("node is not null")
        return marked.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "text")

    blocks = docs.select(F.col(text_col).alias("text")).mapInArrow(runtime.lean(run), near.BLOCKS)
    roots = near.groups(blocks, texts_of, sign, similarity, THRESHOLD, elements, ODD)
    place = known.groupBy("node").agg(F.min("id").alias("id")).where("node is not null")
    rooted = runtime.stored(place.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "rooted")
    least = runtime.stored(rooted.groupBy("root").agg(F.min("id").alias("class_id")), "class-ids")
    named = runtime.stored(rooted.join(least, "root").select("node", "root", "class_id"), "named")
    return known.join(named, "node", "left").select(F.col("id").alias(id_col), "node", "root", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the least id, and of rows that share it the first by text."""
    found = classes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    stands = F.min(F.when(F.col("id").eqNullSafe(F.col("class_id")), F.col("node")))
    node = runtime.spare(docs, "node")
    stay = runtime.stored(found.where("node is not null").groupBy("root", "class_id").agg(stands.alias(node)).select(F.col("class_id").alias("stays"), node), "stay")
    marked = docs.withColumn(node, nodes_of(docs, text_col))
    ours, right = marked.where(F.col(node).isNotNull()).alias("d"), stay.alias("s")
    ours = ours.join(right, (F.col(f"d.{node}") == F.col(f"s.{node}")) & F.col(f"d.{id_col}").eqNullSafe(F.col("s.stays")), "left_semi")
    ours = ours.dropDuplicates([id_col, node])
    return ours.unionByName(marked.where(F.col(node).isNull())).drop(node)
