"""Two-component mixtures of each k-mer's levels, the first component held at the published level."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GmmConfig
from ..operators.lookup import noise, top_per_key

COLUMNS = "kmer string, ont_mean double, ont_stdv double, pi_1 double, mean_1 double, stdv_1 double, pi_2 double, mean_2 double, stdv_2 double, imported_events long, filtered_events long"


def density(x: np.ndarray, mean: float, sd: float) -> np.ndarray:
    return np.exp(-0.5 * ((x - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))


def fit(x: np.ndarray, fixed: tuple[float, float], start: tuple[float, float], config: GmmConfig = GmmConfig(), both: bool = False) -> tuple[float, float, float, float, float, float]:
    """(weight, mean, sd) of both components by expectation maximisation; the first keeps its mean and sd unless ``both``.

    Ends when the log likelihood gains no more than the tolerance, or after the given number of rounds.
    """
    w = np.array([1 - config.weight, config.weight])
    mean, sd = np.array([fixed[0], start[0]], float), np.array([fixed[1], start[1]], float)

    def joint():
        return np.stack([w[c] * density(x, mean[c], sd[c]) for c in (0, 1)])

    def likelihood(p):
        total = p.sum(0)
        return float(np.log(total[total > 0]).sum())

    before = likelihood(joint())
    for _ in range(config.iterations + 1):
        p = joint()
        share = p / np.where(p.sum(0) > 0, p.sum(0), 1)
        size = share.sum(1)
        w = size / len(x)
        for c in (0, 1) if both else (1,):
            if size[c] > 0:
                mean[c] = float((share[c] * x).sum() / size[c])
                sd[c] = max(math.sqrt(float((share[c] * (x - mean[c]) ** 2).sum() / size[c])), 1e-9)
        now = likelihood(joint())
        if now - before <= config.tolerance:
            break
        before = now
    return float(w[0]), float(mean[0]), float(sd[0]), float(w[1]), float(mean[1]), float(sd[1])


def levels(aligned: DataFrame, config: GmmConfig = GmmConfig(), order: str = "idx") -> DataFrame:
    """(kmer, level) of k-mers with enough events, the first ``max_events`` of each; insertions are no k-mer."""
    rows = aligned.where(F.col("kmer_strand").rlike("^[ATGC]+$")).select(F.col("kmer_strand").alias("kmer"), F.col("signal").alias("level"), "read_id", F.col(order).alias("_order"))
    return top_per_key(rows, ["kmer"], ["read_id", "_order"], config.max_events).select("kmer", "level")


def train(rows: DataFrame, model: DataFrame, config: GmmConfig = GmmConfig()) -> DataFrame:
    """A mixture for each k-mer with enough events before and after noise is dropped.

    ``rows``: kmer, level. ``model``: kmer, mean, sd, at most 4^9 rows, broadcast. Noise is found with two range
    frames; the fit itself is one Arrow group for each k-mer, bounded by ``max_events``.
    """
    marked = noise(rows, "kmer", "level", config.eps, config.min_points)
    joined = marked.join(F.broadcast(model.select("kmer", "mean", "sd")), "kmer")

    def run(table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("level"))
        keep = x[~np.asarray(table.column("is_noise"))]
        out = []
        if len(x) >= config.min_events and len(keep) >= config.min_kept:
            mean, sd = table.column("mean")[0].as_py(), table.column("sd")[0].as_py()
            out = [(table.column("kmer")[0].as_py(), mean, sd, *fit(keep, (mean, sd), (float(keep.mean()), max(float(keep.std()), 1e-9)), config), len(x), len(keep))]
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}[c.split()[1]]) for c in COLUMNS.split(", ")])
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return joined.groupBy("kmer").applyInArrow(run, COLUMNS)
