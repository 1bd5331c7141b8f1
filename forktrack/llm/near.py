"""Near-duplicate groups from banded signatures: candidates, exact verification and distributed union-find.

Nodes are 64-bit hashes of what is compared, so equal items are one node before anything is joined. Band values
are combined within a task before they move, so a value that a third of all rows have is one entry a batch.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime, textops

U64 = np.uint64
BLOCKS = "bucket int, entries binary, links binary"
#: Nodes up to which a set of ids (8 bytes each) may be broadcast; beyond it the join is shuffled.
BROADCAST_IDS = 500_000
#: Edges that one task reduces at a time, about 100 MB of its memory.
CHUNK_EDGES = 500_000
#: Hubs of crowded band values that a node is compared with before components are known.
HUBS = 3


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def _stars(values: np.ndarray, nodes: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries: the place of each value's hub, and links (node, hub, hub's degree, whether over two nodes share it).

    A node may have several entries of a value and counts once. The hub is the node that shares most values with
    others: the text that copies were made from, if it is there, is nearer to each than they are to one another.
    """
    order = np.argsort(values)
    v = values[order]
    same = v[1:] == v[:-1]
    shared = np.append(False, same) | np.append(same, False) if len(v) else np.zeros(0, bool)
    alone, order = order[~shared], order[shared]
    order = order[np.lexsort((nodes[order], -degree[order].astype(np.int64), values[order]))]
    if not len(order):
        return alone, np.zeros((0, 4), U64)
    v, n, d = values[order], nodes[order], degree[order].astype(U64)
    first = np.append(True, v[1:] != v[:-1])
    at = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    hub = at[group]
    other = n != n[hub]
    crowd = (np.minimum.reduceat(np.where(other, n, ~U64(0)), at) < np.maximum.reduceat(np.where(other, n, U64(0)), at)).astype(U64)
    rest = np.flatnonzero(other)
    return np.append(alone, order[first]), np.stack([n[rest], n[hub[rest]], d[hub[rest]], crowd[group[rest]]], 1)


def _different(links: np.ndarray) -> np.ndarray:
    """The different rows of an array of links."""
    links = links[np.lexsort(links.T)]
    return links[np.append(True, (links[1:] != links[:-1]).any(1))] if len(links) else links


def pack(values: np.ndarray, nodes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blocks of band entries by bucket of the value; of a value's nodes only the hub moves, the others are linked.

    ``values`` has a row of band values for each node.
    """
    width = values.shape[1]
    nodes, values = np.repeat(nodes, width), values.ravel()
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    degree = np.repeat(np.add.reduceat(count[inverse], np.arange(0, len(values), width)) if len(values) else count, width).astype(np.uint32)
    keep, found = _stars(values, nodes, degree)
    values, nodes, degree = values[keep], nodes[keep], degree[keep]
    found = _different(found)
    spread = (values % U64(buckets)).astype(np.int64)
    order = np.argsort(spread, kind="stable")
    cut = np.searchsorted(spread[order], np.arange(buckets + 1))
    rows = [(k, order[cut[k]:cut[k + 1]]) for k in range(buckets) if cut[k] < cut[k + 1]]
    entries = [values[i].tobytes() + nodes[i].tobytes() + degree[i].astype("<u4").tobytes() for _, i in rows]
    links = [b""] * len(rows)
    if rows:
        links[0] = found.tobytes()
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array(entries, pa.binary()), pa.array(links, pa.binary())], ["bucket", "entries", "links"])


def _link(table: pa.Table) -> pa.Table:
    values, nodes, degree, found = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.uint32)], [np.zeros((0, 4), U64)]
    for entries, links in zip(table.column("entries").to_pylist(), table.column("links").to_pylist()):
        n = len(entries) // 20
        values.append(np.frombuffer(entries, U64, n))
        nodes.append(np.frombuffer(entries, U64, n, 8 * n))
        degree.append(np.frombuffer(entries, "<u4", n, 16 * n))
        found.append(np.frombuffer(links, U64).reshape(-1, 4))
    found.append(_stars(np.concatenate(values), np.concatenate(nodes), np.concatenate(degree))[1])
    every = _different(np.concatenate(found)).view(np.int64)
    return pa.table({"a": pa.array(every[:, 0]), "b": pa.array(every[:, 1]), "degree": pa.array(every[:, 2]), "crowd": pa.array(every[:, 3])})


def candidates(blocks: DataFrame) -> DataFrame:
    """Distinct (a, b, degree, crowd): nodes that share a band value, each with the hub of those that share it.

    ``crowd`` is 0 if the two were alone with the value, wherever they met over it.
    """
    found = blocks.groupBy("bucket").applyInArrow(_link, "a long, b long, degree long, crowd long")
    return found.groupBy("a", "b").agg(F.max("degree").alias("degree"), F.min("crowd").alias("crowd"))


def first_compared(found: DataFrame) -> DataFrame:
    """(a, b) that are compared at once: pairs that were alone, and of crowds each node with its ``HUBS`` greatest hubs."""
    rank = F.row_number().over(Window.partitionBy("a", "crowd").orderBy(F.desc("degree"), "b"))
    return found.withColumn("rank", rank).where((F.col("crowd") == 0) | (F.col("rank") <= HUBS)).select("a", "b")


def jaccard(n: int, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], weighted: bool) -> np.ndarray:
    """Similarity of ``n`` pairs of (pair index, element) collections: of their counts if weighted, else of their sets."""
    room = U64(max(1, (max(n, 1) - 1).bit_length()))
    away = U64(64) - room
    keys = [owner.astype(U64) << away | item >> room for owner, item in (left, right)]
    if weighted:
        (a, na), (b, nb) = (np.unique(k, return_counts=True) for k in keys)
    else:
        a, b = map(textops.distinct, keys)
        na, nb = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    merged = np.sort(np.concatenate([a, b]))
    hit = merged[:-1][merged[1:] == merged[:-1]]
    least = np.minimum(na[np.searchsorted(a, hit)], nb[np.searchsorted(b, hit)]) if weighted else None
    both = np.bincount((hit >> away).astype(np.int64), least, n)
    total = np.bincount((a >> away).astype(np.int64), na, n) + np.bincount((b >> away).astype(np.int64), nb, n)
    return both / np.maximum(total - both, 1)


def verified(pairs: DataFrame, texts: DataFrame, similarity: Callable[[list[str], list[str]], np.ndarray], threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, by the exact similarity."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ok = similarity(part.column("ta").to_pylist(), part.column("tb").to_pylist()) >= threshold
                yield part.select(["a", "b"]).filter(pa.array(ok))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(runtime.lean(run), "a long, b long")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))).alias("e")).select("e.*")
    seen = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return seen.where("child > 1 or (child > 0 and parent > 0)").isEmpty()


def _contracted(edges: DataFrame, n: int) -> DataFrame:
    """Edges of the same components, a star for each component of each chunk of at most ``CHUNK_EDGES`` edges."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, c = root(u), root(v)
                if a != c:
                    parent[max(a, c)] = min(a, c)
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["u", "v"])

    return edges.repartition(-(-max(n, 1) // CHUNK_EDGES)).mapInArrow(runtime.lean(run), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge: union-find within chunks, then stars across them.

    Each task first reduces a bounded chunk of edges to stars, which ends the work where one chunk holds all. What
    spans chunks is settled by alternating large and small stars. The least node of each component becomes its
    root. Every round is a written table; minima are combined before they move, and the joins with them are
    between written tables, so that hot nodes can be split.
    """
    every = runtime.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), "edges")
    now = runtime.stored(_contracted(every, every.count()).distinct(), "edges")
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = runtime.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = runtime.stored(large, "large")
        low = runtime.stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = runtime.stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Bits of the odd sketch that larger sets have beside the small one, and the least sizes of sets that have it,
#: over all their elements or over one in ``RATE``.
WIDE, LARGE, HUGE, RATE = 4096, 400, 4000, 16
SKETCH = "node long, size long, odd array<long>, wide array<long>, rate int"


def odd_sketch(n: int, owner: np.ndarray, element: np.ndarray, size: int) -> np.ndarray:
    """(n, size / 64): a bit for each slot, whether an odd number of a set's distinct elements hash to it.

    Two sketches differ in no more bits than the sets in elements, so a pair of sets whose sketches differ in more
    bits than the threshold lets the sets differ in elements is surely below it.
    """
    slot = (textops.mix64(element ^ U64(0x5851F42D4C957F2D)) % U64(size)).astype(np.int64)
    out = np.zeros((n, size // 64), np.int64)
    for at in range(0, n, 32):
        lo, hi = np.searchsorted(owner, [at, at + 32])
        count = np.bincount((owner[lo:hi] - at) * size + slot[lo:hi], minlength=32 * size)
        out[at:at + 32] = np.packbits((count & 1).astype(np.uint8).reshape(32, size), axis=1).view(np.int64)[: n - at]
    return out


def sketches(nodes: pa.Array, owner: np.ndarray, element: np.ndarray, odd_bits: int) -> pa.RecordBatch:
    """Rows of ``SKETCH`` for sets given by parallel arrays, sorted by owner, of distinct elements."""
    n = len(nodes)
    sizes = np.bincount(owner, minlength=n)
    rate = np.where(sizes > HUGE, RATE, np.where(sizes > LARGE, 1, 0))
    use = (rate[owner] == 1) | (rate[owner] == RATE) & (textops.mix64(element) % U64(RATE) == 0)
    wide = odd_sketch(n, owner[use], element[use], WIDE)[rate > 0]
    has = pa.array(rate == 0)
    ends = pa.array(np.concatenate([[0], np.cumsum(rate > 0)]).astype(np.int32) * (WIDE // 64))
    odd = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (odd_bits // 64)), pa.array(odd_sketch(n, owner, element, odd_bits).ravel()))
    return pa.RecordBatch.from_arrays(
        [nodes, pa.array(sizes), odd, pa.ListArray.from_arrays(ends, pa.array(wide.ravel()), mask=has), pa.array(rate.astype(np.int32), mask=rate == 0)], ["node", "size", "odd", "wide", "rate"]
    )


def _differing(words: int, left: str, right: str) -> Column:
    return reduce(operator.add, [F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(words)])


def _differing_folded(left: str, right: str) -> Column:
    """The same over whole arrays: a sum of 64 terms makes a method too long for the JVM to compile."""
    bits = F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def could_be_similar(threshold: float, odd_bits: int) -> Column:
    """Whether a pair (columns of ``SKETCH``, and those of the other with ``other_``) may reach the threshold.

    By sizes and odd sketches no such pair is refused (two elements are granted for hash collisions); by sampled
    sketches of huge sets, one at the threshold in a million (five standard deviations).
    """
    most = (F.col("size") + F.col("other_size")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(2.0)
    drawn = most / RATE
    limit = F.when(F.col("rate") == 1, most).otherwise(drawn + F.sqrt(drawn) * 5 + 2)
    by_wide = (F.col("rate") != F.col("other_rate")) | (_differing_folded("wide", "other_wide") <= limit)
    return (F.abs(F.col("size") - F.col("other_size")) <= most) & (_differing(odd_bits // 64, "odd", "other_odd") <= most) & F.coalesce(by_wide, F.lit(True))


def groups(blocks: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sign: Callable[[list[str]], np.ndarray], similarity: Callable[[list[str], list[str]], np.ndarray], threshold: float, elements: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], odd_bits: int) -> DataFrame:
    """(node, root) of the nodes that are linked to others.

    First each node is compared with the hubs of its band values, the greatest few where many share one. Then, where
    nodes of one band value are still in different components, all such pairs across components meet in a join whose
    condition bounds their similarity by sizes and sketches; those that could reach the threshold are compared by
    their texts, so that a pair that no hub connects isn't lost. ``texts_of(nodes)`` gives (node, text), once for
    each node; ``elements(texts)`` gives (text index, element), sorted by text and distinct; small sets are told apart
    by ``odd_bits``.
    """
    found = runtime.stored(candidates(blocks), "candidates")
    pairs = runtime.stored(first_compared(found), "pairs")
    nodes = runtime.stored(found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    texts = runtime.stored(texts_of(nodes), "texts")
    edges = runtime.stored(verified(pairs, texts, similarity, threshold), "links")
    roots = runtime.stored(components(edges), "roots")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                values = sign(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column("node")), values.shape[1])), pa.array(values.ravel().view(np.int64))], ["node", "value"])

    def draw(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                yield sketches(part.column("node"), *elements(part.column("text").to_pylist()), odd_bits)

    entries = texts.select("node", "text").mapInArrow(runtime.lean(run), "node long, value long")
    entries = runtime.stored(entries.join(roots, "node", "left").select("node", "value", F.coalesce("root", "node").alias("root")), "entries")
    # The only two nodes of a value have been compared, wherever they met; a third may not have been compared with both.
    mixed = entries.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("value")
    open_entries = runtime.stored(entries.join(runtime.stored(mixed, "mixed"), "value"), "open-entries")
    if open_entries.isEmpty():
        return roots
    drawn = texts.join(open_entries.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(runtime.lean(draw), SKETCH)
    held = open_entries.groupBy("node").agg(F.collect_set("value").alias("values"))
    left = runtime.stored(open_entries.join(runtime.stored(drawn.join(held, "node"), "sketches"), "node"), "sketched")
    right = left.select("value", *[F.col(c).alias(f"other_{c}") for c in ("node", "root", "size", "odd", "wide", "rate", "values")])
    # A pair that shares several values comes from the least of them alone.
    once = F.array_min(F.array_intersect("values", "other_values")) == F.col("l.value")
    ours = left.alias("l").join(right.alias("r"), (F.col("l.value") == F.col("r.value")) & (F.col("root") < F.col("other_root")) & could_be_similar(threshold, odd_bits) & once)
    across = ours.select(F.least("node", "other_node").alias("b"), F.greatest("node", "other_node").alias("a")).distinct()
    known = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = runtime.stored(verified(across.join(known, ["a", "b"], "left_anti"), texts, similarity, threshold), "more-links")
    if more.isEmpty():
        return roots
    return runtime.stored(components(edges.unionByName(more)), "roots")
