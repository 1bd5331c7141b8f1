"""Per-base call models: features of aligned positions, and any model that maps them to three probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq

DEPTH = 20


class CallModel(Protocol):
    """Probabilities (thymidine, BrdU, EdU) of positions: core and residual indexes, (positions, 20) signal."""

    def predict(self, core: np.ndarray, residual: np.ndarray, signal: np.ndarray) -> np.ndarray: ...


class LogisticStub:
    """A fixed model for tests: softmax of the signal's mean and spread; no claim about real calls."""

    def predict(self, core, residual, signal):
        used = np.maximum((signal != 0).sum(1), 1)
        mean = signal.sum(1) / used
        z = np.stack([np.zeros(len(mean)), 0.5 * mean, -0.5 * mean], 1)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def features(positions: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``positions`` (kmer, signal array) with core and residual indexes and a signal of fixed depth."""
    k = F.col("kmer")
    return positions.withColumn("core", seq.core_index(k)).withColumn("residual", seq.residual_index(k)).withColumn("padded", seq.padded_signal(F.col("signal"), depth))


def call(rows: DataFrame, load: Callable[[], CallModel], depth: int = DEPTH) -> DataFrame:
    """``rows`` of ``features`` with p_brdu and p_edu; each worker task loads its model once and works by batches."""

    @F.arrow_udf("p_brdu double, p_edu double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = load()
        for core, residual, padded in batches:
            signal = np.asarray(padded.flatten(), float).reshape(-1, depth)
            out = model.predict(np.asarray(core), np.asarray(residual), signal)
            yield pa.StructArray.from_arrays([pa.array(out[:, 1]), pa.array(out[:, 2])], ["p_brdu", "p_edu"])

    return rows.withColumn("_p", run("core", "residual", "padded")).select("*", "_p.p_brdu", "_p.p_edu").drop("_p")


def thymidine_calls(rows: DataFrame, skip_deleted: bool = False) -> DataFrame:
    """Calls at thymidines only; positions inside deletions are left out where tags are written."""
    out = rows.where(seq.is_thymidine(F.col("kmer")))
    return out.where(~F.col("is_del")) if skip_deleted else out
