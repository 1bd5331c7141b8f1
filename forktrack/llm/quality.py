"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed words, word shapes, punctuation runs and adjacent repeats. Document frequencies count every
document. The latent space is the randomised SVD of a bounded labelled sample's TF-IDF rows; every document is
projected, its cosine with every labelled vector is computed in blocks, and the nearest vote by similarity; labelled
vectors as near as the last of them vote too. Empty and null texts have the zero vector and take the sample's mean
label, 0.5 when nothing is labelled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled, runtime, textops

U64 = np.uint64
BUCKETS = 1 << 14
#: An adjacent repeat counts as so many terms, so that it outweighs the word that is repeated.
REPEAT_TERMS = 8
_BLOCK = 64


@dataclass(frozen=True)
class Model:
    """Term weights, projection (terms x rank), labelled unit vectors and their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket, count) of each text's terms, by text, then bucket."""
    owner, bucket = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kinds = textops.classes()

    def add(of, h):
        owner.append(of)
        bucket.append((textops.mix64(h) % U64(BUCKETS)).astype(np.int64))

    for cp, seg, seg_owner in textops.chunks(texts):
        s, e = textops.pretokens(cp)
        s = s + ((cp[s] == 0x20) & (e - s > 1))
        of, kind, size = textops.owners(s, seg, seg_owner), kinds[cp[s]], e - s
        h = textops.span_hashes(cp, s, e)
        marks = kind == textops.OTHER
        add(of[marks], h[marks])
        letters = np.flatnonzero(kind == textops.LETTER)
        upper = np.concatenate([[0], np.cumsum((cp >= 0x41) & (cp <= 0x5A))])
        capitals = upper[e[letters]] - upper[s[letters]]
        shape = np.where(capitals == 0, 0, np.where(capitals == size[letters], 2, 1)) + 3 * (size[letters] == 1)
        add(of[letters], shape.astype(U64) + U64(11))
        add(of[letters], h[letters] + U64(1))
        if len(letters) > 1:
            same = np.flatnonzero((h[letters][1:] == h[letters][:-1]) & (of[letters][1:] == of[letters][:-1]))
            for mark in range(REPEAT_TERMS):
                add(of[letters][same], np.full(len(same), 101 + mark, U64))
    key = np.concatenate(owner) * BUCKETS + np.concatenate(bucket)
    key, count = np.unique(key, return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def _project(texts: list[str | None], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), basis.shape[1]), np.float32)
    owner, bucket, count = terms(texts)
    if len(owner):
        value = ((1 + np.log(count)) * idf[bucket]).astype(np.float32)
        for at in range(0, len(owner), 1 << 16):
            o, part = owner[at:at + (1 << 16)], slice(at, at + (1 << 16))
            first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            out[o[first]] += np.add.reduceat(basis[bucket[part]] * value[part, None], first, axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _dense(texts: list[str | None], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    owner, bucket, count = terms(texts)
    value = (1 + np.log(count)) * idf[bucket]
    cut = np.searchsorted(owner, np.arange(1, len(texts)))
    return [(b, (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)) for b, v in zip(np.split(bucket, cut), np.split(value, cut))]


def latent_basis(rows: list[tuple[np.ndarray, np.ndarray]], rank: int, passes: int = 2, seed: int = 5) -> np.ndarray:
    """Right singular vectors of the sparse rows, by a randomised range finder with power iterations."""
    wide = min(rank + 8, max(1, len(rows)))
    probe = np.random.default_rng(seed).standard_normal((BUCKETS, wide)).astype(np.float32)
    for turn in range(passes + 1):
        image = np.zeros_like(probe)
        for b, v in rows:
            image[b] += v[:, None] * (v @ probe[b])
        probe, _ = np.linalg.qr(image)
    small = np.stack([v @ probe[b] for b, v in rows]) if rows else np.zeros((1, wide), np.float32)
    _, _, turn = np.linalg.svd(small, full_matrices=False)
    return np.ascontiguousarray((probe @ turn.T)[:, :rank], dtype=np.float32)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """(documents that have each term bucket, documents), over all rows: one vector of fixed size from each task."""

    def run(batches):
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), _BLOCK):
                part = texts[at:at + _BLOCK]
                seen += np.bincount(terms(part)[1], minlength=BUCKETS)
                n += len(part)
        yield pa.RecordBatch.from_pydict({"bucket": np.r_[np.flatnonzero(seen), -1].astype(np.int32), "n": np.r_[seen[seen > 0], n]})

    out, n = np.zeros(BUCKETS, np.int64), 0
    for row in docs.select(text_col).mapInArrow(runtime.lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if row.bucket < 0:
            n = row.n
        else:
            out[row.bucket] = row.n
    return out, n


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, max_train_rows: int = 3000, rank: int = 32, neighbours: int = 7, power: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model whose labelled vectors, at most about ``max_train_rows`` of them, are small enough to broadcast."""
    runtime.prepare(docs.sparkSession)
    seen, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + seen)) + 0.1
    drawn = labelled.sample(docs, labels, label, folds, held_out, max_train_rows, id_col, text_col)

    def run(batches):
        texts, marks = [], []
        for b in batches:
            texts += b.column(1).to_pylist()
            marks += b.column(2).to_pylist()
        rows = [r for at in range(0, len(texts), _BLOCK) for r in _dense(texts[at:at + _BLOCK], idf)]
        basis = latent_basis(rows, rank)
        vectors = np.concatenate([np.zeros((0, basis.shape[1]), np.float32)] + [_project(texts[at:at + _BLOCK], idf, basis) for at in range(0, len(texts), _BLOCK)])
        yield pa.RecordBatch.from_pydict({"basis": [basis.tobytes()], "vectors": [vectors.tobytes()], "labels": [np.array(marks, np.float32).tobytes()], "rank": pa.array([basis.shape[1]], pa.int32())})

    got = drawn.repartition(1).sortWithinPartitions("draw", "text").mapInArrow(runtime.lean(run), "basis binary, vectors binary, labels binary, rank int").collect()
    if not got:
        return Model(idf, np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), neighbours, power)
    g = got[0]
    return Model(idf, np.frombuffer(g.basis, np.float32).reshape(BUCKETS, g.rank), np.frombuffer(g.vectors, np.float32).reshape(-1, g.rank), np.frombuffer(g.labels, np.float32), neighbours, power)


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    prior = float(model.labels.mean()) if len(model.labels) else 0.5
    out = np.full(len(texts), prior)
    k = min(model.neighbours, len(model.labels))
    for at in range(0, len(texts), _BLOCK) if k else ():
        unit = _project(texts[at:at + _BLOCK], model.idf, model.basis)
        cosine = unit @ model.vectors.T
        least = np.maximum(np.partition(cosine, -k, axis=1)[:, -k], 1e-9)
        row, near = np.nonzero(cosine >= least[:, None])
        weight = cosine[row, near].astype(np.float64) ** model.power
        total = np.bincount(row, weight, len(cosine))
        vote = np.bincount(row, weight * model.labels[near], len(cosine)) / np.where(total > 0, total, 1)
        out[at:at + _BLOCK] = np.where(total > 0, vote, prior)
    return np.clip(out, 0.0, 1.0)


def score(text: Column, model: Model) -> Column:
    """Weighted share of good neighbours of a text."""
    shared = text_model(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(shared.value, texts.to_pylist()))

    return run(text)


def text_model(model: Model):
    """The model as a broadcast variable: a few MB, by its sample bound, rank and number of buckets."""
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)
