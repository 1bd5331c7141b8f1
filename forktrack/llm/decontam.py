"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping windows of words. A distributed randomised SVD of TF-IDF windows gives a latent
space; window and benchmark vectors whose cosine there is high enough are candidates, and a candidate counts if
the longest common subsequence of its words covers enough of the item, by weight, or covers less but the passage
has the item's answer too, as paraphrases do. A passage grows with the item, and the windows of a long item are searched
for one by one. Document frequencies are those of all documents; the SVD is fitted on all windows of all documents
and the items, from a start that a few thousand windows give; every window of every document is searched with every
item, in blocks.

The answer of an item is its ``answer`` column where there is one, else its last sentence. Null and empty texts
have no windows; items without words match nothing; a null id stays null; repeated rows give repeated results. Of
windows that cover an item alike the first is given.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import near, runtime, textops

U64 = np.uint64
BUCKETS = 1 << 14
BLOCK = 32
#: Parts of a matrix that tasks add up apart.
PARTS = 16
#: Blocks of items that a worker holds in one scan of the documents, some MB each.
SCAN_BLOCKS = 8
#: Blocks of words whose products are added up together, in some 60 MB: the more, the more words share a sum.
SUMMED_BLOCKS = 1 << 15
#: A vocabulary is looked up by so many leading bits of a hash.
BIN_BITS = 18
_SENTENCE = re.compile(r"[.!?]+\s+")


@dataclass(frozen=True)
class Space:
    """Term weights (0 for terms that most documents have) and the latent basis (terms x rank), weights applied."""

    idf: np.ndarray
    basis: np.ndarray


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: ids, word hashes, answer word hashes, unit latent vectors, each item's first vector
    (one of the whole item, for a long item one of each of its windows too), the words that its passage has on each
    side beyond a short item's, the block's distinct words in order and where those of each bin start; for each item where
    its distinct words start, and for these the place among the block's and the share of the item's weight."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vectors: np.ndarray
    first: np.ndarray
    slack: np.ndarray
    vocabulary: np.ndarray
    bins: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    shares: np.ndarray


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h & U64(BUCKETS - 1)).astype(np.int64)


def _split(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return np.split(h, bounds[1:-1])


def frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int, int]:
    """(documents with each term bucket, documents, windows), counted over all documents."""

    def run(batches):
        seen, n, windows = np.zeros(BUCKETS, np.int64), 0, 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), 64):
                h, bounds = textops.hashed_words(texts[at:at + 64])
                size = np.diff(bounds)
                owner = np.repeat(np.arange(len(size)), size)
                seen += np.bincount(textops.distinct((owner * BUCKETS + _buckets(h)).astype(np.uint32)) % BUCKETS, minlength=BUCKETS)
                n += len(size)
                windows += int(_windows(size).sum())
        yield pa.RecordBatch.from_pydict({"bucket": np.r_[np.flatnonzero(seen), -1, -2].astype(np.int32), "n": np.r_[seen[seen > 0], n, windows]})

    seen, totals = np.zeros(BUCKETS, np.int64), {-1: 0, -2: 0}
    for row in docs.select(text_col).mapInArrow(runtime.lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if row.bucket < 0:
            totals[row.bucket] = row.n
        else:
            seen[row.bucket] = row.n
    return seen, totals[-1], totals[-2]


def _windows(size: np.ndarray) -> np.ndarray:
    """Windows of texts of so many words: two blocks each, one for a text of one block."""
    blocks = -(-size // BLOCK)
    return np.where(blocks > 1, blocks - 1, blocks)


def _sums(h: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of weight rows over each block of words; blocks before each text.

    So few blocks at a time that their rows stay in the processor's cache.
    """
    blocks = -(-np.diff(bounds) // BLOCK)
    before = np.concatenate([[0], np.cumsum(blocks)])
    slots = _padded(h, bounds, before, 1)
    inside = (slots < BUCKETS).astype(np.float32)[:, None]
    slots[slots == BUCKETS] = 0
    out = np.zeros((before[-1], weights.shape[1]), np.float32)
    rows = np.empty((32 * BLOCK, weights.shape[1]), np.float32)
    for at in range(0, len(slots), 32):
        some = slots[at:at + 32]
        held = rows[: some.size]
        np.take(weights, some.ravel(), axis=0, out=held, mode="clip")
        out[at:at + 32] = np.matmul(inside[at:at + 32], held.reshape(len(some), BLOCK, -1))[:, 0]
    return out, before


def _padded(h: np.ndarray, bounds: np.ndarray, before: np.ndarray, blocks: int) -> np.ndarray:
    """A row for each block: the buckets of its words and of the next block's of its text for two ``blocks``, then
    ``BUCKETS``."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(before))
    start = bounds[owner] + (np.arange(before[-1]) - before[owner]) * BLOCK
    place = start[:, None] + np.arange(blocks * BLOCK)
    slots = np.append(_buckets(h), BUCKETS).astype(np.uint16)
    return slots[np.where(place < bounds[owner + 1][:, None], place, len(h))]


def _places(bounds: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, place in the text, first block, whether it has a second) of every window."""
    n = _windows(np.diff(bounds))
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = before[owner] + place
    return owner, place, at, at + 1 < before[owner + 1]


def window_vectors(h: np.ndarray, bounds: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first word within the text, unit latent vector) of every window."""
    sums, before = _sums(h, bounds, space.basis)
    owner, place, at, two = _places(bounds, before)
    vectors = sums[at]
    vectors[two] += sums[at[two] + 1]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return owner, place * BLOCK, vectors / np.where(norm > 0, norm, 1)


def _sparse_window(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot, count = np.unique(_buckets(words), return_counts=True)
    value = count * idf[slot]
    return slot, (value / max(float(np.linalg.norm(value)), 1e-12)).astype(np.float32)


class Products:
    """Adds the product of all windows' TF-IDF matrix, transposed, itself, and a probe to ``image``, for texts' hashed
    words. ``weights``: the probe times ``idf``; the caller multiplies ``image`` by ``idf`` once, after ``end``.

    A word adds what its block's windows have, so windows are never written out. What the blocks of some texts have is
    kept, texts a few at a time, until there are ``SUMMED_BLOCKS``; then their words are gone through by bucket, those of
    a bucket with many by matrix products.
    """

    def __init__(self, image: np.ndarray, idf: np.ndarray, weights: np.ndarray):
        self.image, self.idf, self.weights = image, np.append(idf, 0.0), weights
        self.own, self.slot, self.of, self.blocks = [], [], [], 0

    def add(self, h: np.ndarray, bounds: np.ndarray) -> None:
        sums, before = _sums(h, bounds, self.weights)
        _, _, at, two = _places(bounds, before)
        slots = np.sort(_padded(h, bounds, before, 2)[at], axis=1)
        place = np.arange(2 * BLOCK, dtype=np.int16)
        opens = np.ones(slots.shape, bool)
        opens[:, 1:] = slots[:, 1:] != slots[:, :-1]
        rank = place - np.maximum.accumulate(np.where(opens, place, np.int16(0)), axis=1)
        norm = np.einsum("ij,ij->i", self.idf[slots] ** 2, 2.0 * rank + 1)  # a word's n-th occurrence adds n^2 - (n - 1)^2
        sent = sums[at]
        sent[two] += sums[at[two] + 1]
        sent /= np.maximum(norm, 1e-24)[:, None].astype(np.float32)
        own = np.zeros_like(sums)
        own[at] = sent
        own[at[two] + 1] += sent[two]
        self.own.append(own)
        self.slot.append(_buckets(h).astype(np.uint16))
        self.of.append((np.repeat(before[:-1], np.diff(bounds)) + (np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))) // BLOCK + self.blocks).astype(np.int32))
        self.blocks += len(own)
        if self.blocks >= SUMMED_BLOCKS:
            self.end()

    def end(self) -> None:
        if not self.blocks:
            return
        own, slot, of = (np.concatenate(x) for x in (self.own, self.slot, self.of))
        self.own, self.slot, self.of, self.blocks = [], [], [], 0
        order = np.argsort(slot, kind="stable")
        slot, of = slot[order], of[order]
        rows, ones = np.empty((1024, own.shape[1]), np.float32), np.ones(1024, np.float32)

        def held(lo: int, end: int) -> np.ndarray:
            some = of[lo:min(lo + 1024, end)]
            return np.take(own, some, axis=0, out=rows[: len(some)], mode="clip")

        opens = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        size = np.diff(np.append(opens, len(slot)))
        many = size >= 64
        for at, n in zip(opens[many].tolist(), size[many].tolist()):
            for lo in range(at, at + n, 1024):
                part = held(lo, at + n)
                self.image[slot[at]] += ones[: len(part)] @ part
        rest = np.repeat(~many, size)
        of, slot = of[rest], slot[rest]
        for lo in range(0, len(of), 1024):
            part = held(lo, len(of))
            first = np.flatnonzero(np.append(True, slot[lo + 1:lo + len(part)] != slot[lo:lo + len(part) - 1]))
            self.image[slot[lo + first]] += np.add.reduceat(part, first, axis=0)


def add_products(image: np.ndarray, h: np.ndarray, bounds: np.ndarray, idf: np.ndarray, weights: np.ndarray) -> None:
    """``Products`` of one lot of texts."""
    products = Products(image, idf, weights)
    products.add(h, bounds)
    products.end()


def nystrom(sent: np.ndarray, image: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors, noughts beyond them, of a positive matrix of which ``image`` is the product with the
    orthonormal ``sent``."""
    gram = sent.T.astype(np.float64) @ image
    value, turned = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > 1e-7 * max(float(value.max(initial=0)), 1e-30)
    out = np.zeros((len(image), rank), np.float32)
    if keep.any():
        found = np.linalg.svd(image @ (turned[:, keep] / np.sqrt(value[keep])), full_matrices=False)[0][:, :rank]
        out[:, : found.shape[1]] = found
    return out


def _put(path: str, matrix: np.ndarray) -> None:
    runtime.FileStore(path).write("matrix", lambda f: f.write(np.ascontiguousarray(matrix, np.float32).tobytes()))


@functools.lru_cache(maxsize=1)
def _get(path: str) -> np.ndarray:
    """A matrix that a task wrote to the shared folder; a worker keeps the last one."""
    with runtime.FileStore(f"{path}/matrix").open() as f:
        return np.frombuffer(f.read(), np.float32).reshape(BUCKETS, -1)


def fit(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, rank: int, sample_windows: int, passes: int, seed: int = 3) -> tuple[np.ndarray, str]:
    """Randomised SVD of the TF-IDF windows of all documents and the texts of ``items``, which have equal say. Gives
    term weights and the path of the latent basis, weights applied.

    Subspace iteration starts on windows of documents drawn by hash, about ``sample_windows``, and the items, for the
    price of a look; what comes of it is multiplied by all windows, and the basis is made of that product. Each pass
    multiplies in the tasks that hold the rows; the fixed-size matrices of at most eight tasks, over all windows of
    four for each core, are added up and orthogonalised, which leaves the result in the shared folder for
    the next, so that none of them passes through the driver.
    """
    seen, n, windows = frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + seen))
    share = min(1.0, sample_windows / max(1, windows))

    def draw(whole: bool):
        def run(batches):
            for b in batches:
                texts = b.column(0).to_pylist()
                for at in range(0, len(texts), 64):
                    words = _split(*textops.hashed_words(texts[at:at + 64]))
                    rows = [w.tobytes() for w in words if len(w)] if whole else [w[s:s + 2 * BLOCK].tobytes() for w in words for s in range(0, max(1, len(w) - BLOCK), BLOCK) if len(w)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([whole] * len(rows), pa.bool_())], ["words", "item"])

        return runtime.lean(run)

    chosen = docs.where(F.pmod(F.xxhash64(*[F.col(c) for c in (id_col, text_col)]), F.lit(1 << 30)) < int(share * (1 << 30)))
    both = chosen.select(text_col).mapInArrow(draw(False), "words binary, item boolean").unionByName(items.mapInArrow(draw(True), "words binary, item boolean"))
    drawn = runtime.stored(both.repartition(8), "windows")
    count = {r.item: r.n for r in drawn.groupBy("item").agg(F.count("*").alias("n")).collect()}
    wide = rank + 8
    paths = [runtime.fresh_path(docs.sparkSession, "probe") for _ in range(passes + 3)]

    def probe(turn: int) -> np.ndarray:
        return _get(paths[turn]) if turn else np.random.default_rng(seed).standard_normal((BUCKETS, wide)).astype(np.float32)

    def say(windows: int) -> float:
        return max(1, windows) / max(1, count.get(True, 0))

    def parts(image: np.ndarray) -> pa.RecordBatch:
        image = image.astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(image, PARTS)], pa.binary())], ["part", "image"])

    def times(turn: int, for_item: float):
        def run(batches):
            sent = probe(turn)
            image = np.zeros(sent.shape)
            for b in batches:
                for row, item in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    slot, value = _sparse_window(np.frombuffer(row, U64), idf)
                    image[slot] += (for_item if item else 1.0) * value[:, None] * (value @ sent[slot])
            yield parts(image)

        return runtime.lean(run)

    def times_all(turn: int):
        def run(batches):
            weights = probe(turn) * idf[:, None].astype(np.float32)
            image = np.zeros(weights.shape)
            products = Products(image, idf, weights)
            for b in batches:
                texts = b.column(0).to_pylist()
                for at in range(0, len(texts), 128):
                    products.add(*textops.hashed_words(texts[at:at + 128]))
            products.end()
            yield parts(image * idf[:, None])

        return runtime.lean(run)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, image in zip(b.column(0).to_pylist(), b.column(1)):
                sums[part] = sums.get(part, 0.0) + np.frombuffer(image.as_py(), np.float32).astype(np.float64)
        for part, image in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([image.astype(np.float32).tobytes()], pa.binary())], ["part", "image"])

    def end(turn: int):
        def run(batches):
            image = np.zeros((BUCKETS, wide))
            for b in batches:
                for part, row in zip(b.column(0).to_pylist(), b.column(1)):
                    image[part * BUCKETS // PARTS:(part + 1) * BUCKETS // PARTS] += np.frombuffer(row.as_py(), np.float32).reshape(-1, wide)
            if turn < passes:
                made = np.linalg.qr(image)[0]
            elif turn == passes:  # directions that the sample lacks start at random, on terms that there are
                found, size, _ = np.linalg.svd(image, full_matrices=False)
                noise = np.random.default_rng(seed + 1).standard_normal(image.shape) * (seen > 0)[:, None]
                known = size > 1e-6 * max(size[0], 1e-30)
                made = np.linalg.qr(np.hstack([found[:, known], noise[:, known.sum():]]))[0]
            else:
                made = nystrom(probe(turn), image, rank) * idf[:, None]
            _put(paths[turn + 1], made)
            yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32())], ["turn"])

        return runtime.lean(run)

    schema = "part int, image binary"
    for turn in range(passes + 1):
        drawn.mapInArrow(times(turn, say(count.get(False, 0))), schema).repartition(1).mapInArrow(end(turn), "turn int").collect()
    last = passes + 1
    whole = docs.select(text_col).coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(times_all(last), schema)
    products = whole.unionByName(drawn.where("item").mapInArrow(times(last, say(windows)), schema))
    products.repartition(PARTS, "part").mapInArrow(runtime.lean(add), schema).repartition(1).mapInArrow(end(last), "turn int").collect()
    return idf, paths[-1]


def answer_text(text: str) -> str:
    """The last sentence, all of a text of one sentence."""
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    return parts[-1] if parts else ""


def covered(item: np.ndarray, passage: np.ndarray, weight: np.ndarray) -> float:
    """Share of an item's weight that its heaviest common subsequence with a passage has."""
    total = float(weight.sum())
    if not total:
        return 0.0
    best = np.zeros(len(passage) + 1)
    for lo in range(0, len(item), 64):
        word, hits = np.nonzero(item[lo:lo + 64, None] == passage)
        opens = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
        for k, hit in zip(word[opens].tolist(), np.split(hits, opens[1:])):
            v = weight[lo + k]
            if len(hit) > 8:
                step = best.copy()
                step[hit + 1] = np.maximum(step[hit + 1], best[hit] + v)
                best = np.maximum.accumulate(step)
                continue
            for at in hit[::-1].tolist():  # ``best`` ascends, and what stands before a place is still as it was
                np.maximum(best[at + 1:], best[at] + v, out=best[at + 1:])
    return float(best[-1]) / total


def contains(passage: np.ndarray, run: np.ndarray) -> bool:
    """Whether a run of words stands in a passage, unbroken."""
    n = len(run)
    if not 0 < n <= len(passage):
        return False
    at = np.flatnonzero(passage[: len(passage) - n + 1] == run[0])
    return bool(len(at)) and any(np.array_equal(passage[a:a + n], run) for a in at.tolist())


def _item_blocks(rows: Iterable[tuple], most: int) -> Iterator[list[tuple]]:
    """Blocks of at most ``most`` items, and of at most as many words as that many windows have, one item at least."""
    held, words = [], 0
    for row in rows:
        n = len(textops.hashed_words([row[1]])[0])
        if held and (len(held) == most or words + n > most * 2 * BLOCK):
            yield held
            held, words = [], 0
        held.append(row)
        words += n
    if held:
        yield held


def _item_block(rows: list, space: Space) -> Items:
    texts = [r[1] for r in rows]
    h, bounds = textops.hashed_words(texts)
    words = _split(h, bounds)
    answers = _split(*textops.hashed_words([r[2] if r[2] is not None else answer_text(r[1] or "") for r in rows]))
    pieces = [[w, *(w[at:at + 2 * BLOCK] for at in range(0, len(w) - BLOCK, BLOCK) if len(w) > 2 * BLOCK)] for w in words]
    first = np.cumsum([0, *map(len, pieces)])[:-1]
    over = np.maximum(0, np.array([len(w) for w in words]) - 2 * BLOCK)
    slack = -(-over * 5 // (4 * BLOCK)) * BLOCK
    vectors = np.zeros((sum(map(len, pieces)), space.basis.shape[1]), np.float32)
    for i, w in enumerate(w for own in pieces for w in own):
        if len(w):
            vectors[i] = space.basis[_buckets(w)].sum(0)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vocabulary = np.unique(np.concatenate([np.zeros(0, U64), *words]))
    bins = np.append(np.searchsorted(vocabulary, np.arange(1 << BIN_BITS, dtype=U64) << U64(64 - BIN_BITS)), len(vocabulary))
    terms, shares = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for w in words:
        weight = space.idf[_buckets(w)]
        place, at = np.unique(np.searchsorted(vocabulary, w), return_inverse=True)
        total = weight.sum()
        terms.append(place)
        shares.append((np.bincount(at, weight, len(place)) / (total if total > 0 else 1)).astype(np.float32))
    starts = np.cumsum([0, *map(len, terms[1:])])
    return Items([r[0] for r in rows], words, answers, vectors / np.where(norm > 0, norm, 1), first, slack, vocabulary, bins.astype(np.int32), starts, np.concatenate(terms), np.concatenate(shares))


def _known(h: np.ndarray, items: Items) -> np.ndarray:
    """Each word's place in the vocabulary, -1 for others: it is compared with those of its bin."""
    out = np.full(len(h), -1, np.int32)
    if len(items.vocabulary):
        start = np.take(items.bins, (h >> U64(64 - BIN_BITS)).astype(np.int64))
        for k in range(int(np.diff(items.bins).max())):
            place = np.minimum(start + np.int32(k), len(items.vocabulary) - 1, dtype=np.int32)
            hit = np.flatnonzero(np.take(items.vocabulary, place) == h)
            out[hit] = place[hit]
    return out


def _reach(item: np.ndarray, first: np.ndarray, last: np.ndarray, known: np.ndarray, items: Items) -> np.ndarray:
    """For candidate (passage, item) pairs, the share of the item's weight whose words stand anywhere in the passage.

    No subsequence covers more. ``known`` has each word's place in the vocabulary, -1 for others. Neighbouring pairs of a
    passage share its set of words.
    """
    opens = np.append(True, (first[1:] != first[:-1]) | (last[1:] != last[:-1]))
    passage, first, last = np.cumsum(opens) - 1, first[opens], last[opens]
    n = last - first
    wide = len(items.vocabulary) + 1  # the last column takes words that no item has
    stands = np.zeros(len(first) * wide, bool)
    stands[np.repeat(np.arange(len(first)) * wide, n) + known[_spans(first, n)] % wide] = True
    size = items.starts[item + 1] - items.starts[item]
    term = _spans(items.starts[item], size)
    there = stands[np.repeat(passage * wide, size) + items.terms[term]]
    return np.bincount(np.repeat(np.arange(len(item)), size)[there], items.shares[term[there]], len(item))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of several spans, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def search(hashed: tuple, windows: tuple, space: Space, items: Items, cosine: float, cover: float, paraphrase: float) -> list[tuple]:
    """(text index, item index, first word, cosine, cover) of the best window for each text and item that match, of
    equally good ones the first; from the texts' hashed words and window vectors."""
    (h, bounds), (owner, place, vectors) = hashed, windows
    known = _known(h, items)
    step = min(2048, max(64, (1 << 20) // max(1, len(items.vectors))))
    best: dict[tuple[int, int], tuple] = {}
    for lo in range(0, len(vectors), step):
        score = vectors[lo:lo + step] @ items.vectors.T
        if len(items.vectors) > len(items.ids):
            score = np.maximum.reduceat(score, items.first, axis=1)
        w, i = np.nonzero(score >= cosine)
        if not len(w):
            continue
        w += lo
        first = bounds[owner[w]] + np.maximum(0, place[w] - BLOCK - items.slack[i])
        last = np.minimum(bounds[owner[w] + 1], bounds[owner[w]] + place[w] + 3 * BLOCK + items.slack[i])
        weighs = last - first + items.starts[i + 1] - items.starts[i] + len(items.vocabulary) // 8
        cuts = np.flatnonzero(np.diff(np.cumsum(weighs) >> 20)) + 1  # sets of words that stay in the cache
        near_by = [_reach(*part, known, items) for part in zip(*(np.split(x, cuts) for x in (i, first, last)))]
        likely = np.concatenate(near_by) >= min(cover, paraphrase) - 1e-6
        for w, i, start, end in zip(w[likely].tolist(), i[likely].tolist(), first[likely].tolist(), last[likely].tolist()):
            passage, item = h[start:end], items.words[i]
            part = covered(item, passage, space.idf[_buckets(item)])
            if part >= cover or part >= paraphrase and contains(passage, items.answers[i]):
                key = (int(owner[w]), i)
                if key not in best or part > best[key][4]:
                    best[key] = (*key, int(place[w]), float(score[w - lo, i]), part)
    return sorted(best.values())


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", rank: int = 128, sample_windows: int = 8_000, passes: int = 2, cosine: float = 0.45, cover: float = 0.6, paraphrase: float = 0.4, item_block: int = 512) -> DataFrame:
    """(id, item id, first_word, cosine, cover): which documents have a passage of which benchmark item.

    Items are a query set. The driver reads them one by one into blocks of ``item_block``, of long items fewer, and
    broadcasts their texts; tasks project them, and one scan of the documents searches ``SCAN_BLOCKS`` blocks.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col), F.col(text_col).cast("string").alias("text"), answer.alias("answer"))
    idf, path = fit(docs, items.select("text"), id_col, text_col, rank, sample_windows, passes)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType
    schema = f"{id_col} {id_type}, {item_col} {item_type}, first_word long, cosine double, cover double"

    def scan(blocks: list) -> DataFrame:
        def run(batches):
            space = Space(idf, _get(path))
            own = [_item_block(block.value, space) for block in blocks]
            for b in batches:
                keys, texts = b.column(0), b.column(1).to_pylist()
                for lo in range(0, len(texts), 64):
                    hashed = textops.hashed_words(texts[lo:lo + 64])
                    vectors = window_vectors(*hashed, space)
                    for items in own:
                        found = search(hashed, vectors, space, items, cosine, cover, paraphrase)
                        if found:
                            t, i, first, score, part = (list(x) for x in zip(*found))
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array([lo + x for x in t])), pa.array([items.ids[k] for k in i], to_arrow_type(item_kind)), pa.array(first, pa.int64()), pa.array(score), pa.array(part)], [id_col, item_col, "first_word", "cosine", "cover"])

        return docs.select(id_col, text_col).mapInArrow(runtime.lean(run), schema)

    scans, held = [], []
    for rows in _item_blocks((tuple(r) for r in items.orderBy(item_col, "text").toLocalIterator()), item_block):
        held.append(spark.sparkContext.broadcast(rows))
        if len(held) == SCAN_BLOCKS:
            scans.append(scan(held))
            held = []
    scans += [scan(held)] if held else []
    return reduce(DataFrame.unionByName, scans, spark.createDataFrame([], schema)) if len(scans) != 1 else scans[0]


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that have a passage of a benchmark item; rows with a null id go by nulls."""
    name = runtime.spare(docs, "leaking")
    own, items = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark.withColumnRenamed(text_col, "text")
    bad = runtime.stored(leaks(own, items, "id", "text").select(F.col("id").alias(name)).distinct(), "leaks")
    return docs.join(near.few(bad, bad.count()), docs[id_col].eqNullSafe(F.col(name)), "left_anti")
