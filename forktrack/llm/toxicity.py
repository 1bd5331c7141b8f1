"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 64-bit hashes of words, word stems, word pairs and pairs that skip one word; a feature is present in
a text or not. Training reads all labelled rows, dealt by hash into shards of some thousand; each shard's model
admits features that enough of its rows have and keeps the few that L1 leaves non-zero, and the model is the mean of
them by rows. Scoring works row by row on whole texts. An empty or null text
scores by the intercept alone; without any training rows every score is 0.5. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled, runtime, textops

U64 = np.uint64
STEMS = (4, 6)
_ADMIT_BITS = 24


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature hash) of all features of all texts, repeats included."""
    owner, out = [], []
    hashes, counts = [np.zeros(0, U64)], np.zeros(len(texts) + 1, np.int64)
    for cp, seg, of in textops.chunks(texts, lower=True):
        s, e = textops.words(cp)
        o = textops.owners(s, seg, of)
        hashes.append(textops.span_hashes(cp, s, e))
        counts[1:] += np.bincount(o, minlength=len(texts))
        for n in STEMS:
            long = e - s > n
            owner.append(o[long])
            out.append(textops.span_hashes(cp, s[long], s[long] + n) ^ U64(n))
    h, bounds = np.concatenate(hashes), np.cumsum(counts)
    o = np.repeat(np.arange(len(texts)), np.diff(bounds))
    owner.append(o)
    out.append(h)
    for gap in (1, 2):
        same = np.flatnonzero(o[gap:] == o[:-gap]) if len(o) > gap else np.zeros(0, np.int64)
        owner.append(o[same])
        out.append(textops.combine([h[same], h[same + gap]]) + U64(gap))
    return np.concatenate(owner), np.concatenate(out)


def _rows(texts: list[str | None]) -> list[np.ndarray]:
    owner, h = features(texts)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[keep], h[keep]
    return np.split(h, np.searchsorted(owner, np.arange(1, len(texts))))


def fit(texts: list[str | None], labels: list[int], alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.5, epochs: int = 3, least_rows: int = 3) -> Model:
    """FTRL-proximal with a learning rate for each coordinate."""
    seen = np.zeros(1 << _ADMIT_BITS, np.uint8)
    mask = U64((1 << _ADMIT_BITS) - 1)
    for at in range(0, len(texts), 64):
        for row in _rows(texts[at:at + 64]):
            slot = np.unique(row & mask)
            seen[slot] += seen[slot] < 255
    rows = []
    for at in range(0, len(texts), 64):
        rows += [row[seen[row & mask] >= least_rows] for row in _rows(texts[at:at + 64])]
    del seen
    names = np.unique(np.concatenate(rows)) if rows else np.zeros(0, U64)
    rows = [np.append(np.searchsorted(names, row), len(names)).astype(np.int32) for row in rows]
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    free = len(names)

    def weight(i, zi, ni):
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(i == free, 0.0, l1), 0.0)
        return -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for i, y in zip(rows, labels):
            zi, ni = z[i], n[i]
            w = weight(i, zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    w = weight(np.arange(len(z)), z, n)
    live = np.flatnonzero(w[:-1])
    return Model(names[live], w[live], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, shard_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of all labelled rows outside the held-out fold: the mean, by rows, of one for each ``shard_rows`` or so.

    Weights are added up by feature; the driver gets a row for each that some shard keeps.
    """
    runtime.prepare(docs.sparkSession)
    rows, n = labelled.every(docs, labels, label, folds, held_out, id_col, text_col)
    shards = max(1, -(-n // shard_rows))

    def run(batches):
        texts, marks = [], []
        for b in batches:
            texts += b.column(1).to_pylist()
            marks += b.column(2).to_pylist()
        if texts:
            m = fit(texts, marks)
            weight = np.append(m.weights, m.bias) * len(texts)
            yield pa.RecordBatch.from_pydict({"feature": pa.array([*m.features.view(np.int64).tolist(), None], pa.int64()), "weight": weight, "n": np.full(len(weight), len(texts))})

    dealt = rows.withColumn("shard", F.pmod("draw", F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("draw", "text")
    parts = dealt.select("draw", "text", "label").mapInArrow(runtime.lean(run), "feature long, weight double, n long")
    got = parts.groupBy("feature").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).toArrow()
    free = got.filter(pc.is_null(got["feature"]))
    if not len(free):
        return Model(np.zeros(0, U64), np.zeros(0), 0.0)
    total, own = free["n"][0].as_py(), got.filter(pc.is_valid(got["feature"]))
    names, weights = own["feature"].to_numpy().view(U64), own["weight"].to_numpy() / total
    order = np.argsort(names)
    return Model(names[order], weights[order], free["weight"][0].as_py() / total)


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    total = np.full(len(texts), model.bias)
    if len(model.features):
        bits = np.zeros(1 << 20, bool)
        bits[model.features & U64((1 << 20) - 1)] = True
        for at in range(0, len(texts), 64):
            owner, h = features(texts[at:at + 64])
            maybe = np.flatnonzero(bits[h & U64((1 << 20) - 1)])
            owner, h = owner[maybe], h[maybe]
            place = np.minimum(np.searchsorted(model.features, h), len(model.features) - 1)
            hit = np.flatnonzero(model.features[place] == h)
            pair = np.unique(owner[hit] * len(model.features) + place[hit])
            np.add.at(total, at + pair // len(model.features), model.weights[pair % len(model.features)])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic; the model, a few thousand weights, goes with the function."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(score_texts(model, texts.to_pylist()))

    return run(text)
