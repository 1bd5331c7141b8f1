"""Likelihood-ratio calls at thymidines, and trimming of raw signal by its local variation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import align


def likelihood_ratios(event_means: np.ndarray, pairs: list[tuple[int, int]], ref_to_query: dict[int, int], reference: str, thymidine: tuple[np.ndarray, np.ndarray], analogue: tuple[np.ndarray, np.ndarray], scaling: align.Scaling, t: align.Transitions, half: int = 12, k: int = 9) -> list[tuple[int, float]]:
    """(place, log ratio) of the thymidines of a read that have enough events around them.

    Levels are (mean, sd) by k-mer index. The analogue's levels hold for k-mers over the thymidine that have a T.
    Places whose window is not bases alone, or that have fewer than ``2 half - k`` usable events, are left out.
    """
    idx = align.kmer_indexes(reference, k)
    event = np.array([e for e, _ in pairs], np.int64)
    query = np.array([q for _, q in pairs], np.int64)
    usable = (event_means[event] > 0) & (event_means[event] < 250) if len(event) else np.zeros(0, bool)
    out = []
    for place in range(2 * half, len(reference) - 2 * half):
        window = reference[place - half:place + half + k]
        if reference[place] != "T" or any(c not in align.DIGIT for c in window) or len(window) < 2 * half + k:
            continue
        lo, hi = np.searchsorted(query, [ref_to_query.get(place - half, 0), ref_to_query.get(place + half, 0)])
        x = scaling(event_means[event[lo:hi][usable[lo:hi]]])
        if len(x) < 2 * half - k:
            continue
        own = idx[place - half:place + half]
        mean, sd = thymidine[0][own], thymidine[1][own]
        changed = np.array([i > 0 and half - k // 2 <= i <= half + k // 2 and "T" in window[i:i + k] for i in range(2 * half)])
        other = np.where(changed, analogue[0][own], mean), np.where(changed, analogue[1][own], sd)
        out.append((place, align.log_likelihood_ratio(x, (mean, sd), other, t)))
    return out


def deviation(values: Column) -> Column:
    """Median absolute deviation of a group, scaled to a normal's standard deviation."""
    held = F.collect_list(values)
    middle = F.median(values)
    return 1.4826 * _median(F.transform(held, lambda v: F.abs(v - middle)))


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def trim_by_deviation(signal: np.ndarray, chunk: int = 100, share: float = 0.3) -> tuple[int, int]:
    """(start, end) of a signal without quiet chunks at its ends: those not above the given quantile of deviations."""
    n = len(signal) // chunk
    if not n:
        return 0, 0
    parts = signal[: n * chunk].reshape(n, chunk)
    spread = 1.4826 * np.median(np.abs(parts - np.median(parts, axis=1, keepdims=True)), axis=1)
    loud = np.flatnonzero(spread > np.quantile(spread, share))
    return (int(loud[0]) * chunk, int(loud[-1] + 1) * chunk) if len(loud) else (0, 0)


def chunk_deviations(samples: DataFrame, key: str, place: str, value: str, chunk: int = 100) -> DataFrame:
    """(key, chunk, deviation) of exploded signal."""
    return samples.groupBy(key, F.floor(F.col(place) / chunk).alias("chunk")).agg(deviation(F.col(value)).alias("deviation"))
