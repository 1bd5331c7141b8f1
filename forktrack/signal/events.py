"""Event detection: windowed t-statistics, a peak detector over two of them, and piecewise-constant events."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EventConfig

LEAST_VARIANCE = float(np.finfo(np.float32).tiny)


def prefix_sums(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows with running sum and sum of squares."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("sum", F.sum(value).over(w)).withColumn("sum_sq", F.sum(F.col(value) * F.col(value)).over(w))


def windowed_t(rows: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """Rows with ``t``: two-sided t-statistic of the windows before and from each row, 0 near the ends."""
    w = Window.partitionBy(key).orderBy(*order)
    x = F.col(value)
    before, after = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)

    def moments(frame):
        mean = F.sum(x).over(frame) / width
        return mean, F.sum(x * x).over(frame) / width - mean * mean

    (m1, v1), (m2, v2) = moments(before), moments(after)
    at, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(key))
    t = F.abs(m2 - m1) / F.sqrt(F.greatest(v1 + v2, F.lit(LEAST_VARIANCE)) / width)
    return rows.withColumn("t", F.when((at >= width) & (at <= n - width) & (n >= 2 * width), t).otherwise(F.lit(0.0)))


def t_statistic(signal: np.ndarray, width: int) -> np.ndarray:
    """The same statistic of one signal."""
    n, out = len(signal), np.zeros(len(signal))
    if n < 2 * width or width < 2:
        return out
    total, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (signal, signal * signal))
    at = np.arange(width, n - width + 1)
    m1, m2 = (total[at] - total[at - width]) / width, (total[np.minimum(at + width, n)] - total[at]) / width
    v = (squares[at] - squares[at - width]) / width - m1 * m1 + (squares[np.minimum(at + width, n)] - squares[at]) / width - m2 * m2
    good = at < n
    out[at[good]] = (np.abs(m2 - m1) / np.sqrt(np.maximum(v, LEAST_VARIANCE) / width))[good]
    return out


@dataclass
class _Peak:
    """What a detector knows of the peak that it may be on."""

    width: int
    threshold: float
    value: float = float("inf")
    at: int = -1
    sure: bool = False
    quiet_until: int = 0

    def forget(self, value: float) -> None:
        self.value, self.at, self.sure = value, -1, False

    def step(self, i: int, x: float, height: float) -> int | None:
        """Take the statistic at ``i``; gives a boundary when a peak is over."""
        if self.at < 0:
            if x < self.value:
                self.value = x
            elif x - self.value > height:
                self.value, self.at = x, i
            return None
        if x > self.value:
            self.value, self.at = x, i
        if self.value - x > height and self.value > self.threshold:
            self.sure = True
        return self.at if self.sure and i - self.at > self.width // 2 else None


def boundaries(signal: np.ndarray, config: EventConfig = EventConfig()) -> list[int]:
    """Event boundaries: a short-window peak above its threshold silences the long-window detector around it."""
    short, long = _Peak(config.short_window, config.short_threshold), _Peak(config.long_window, config.long_threshold)
    series = [(short, t_statistic(signal, short.width).tolist()), (long, t_statistic(signal, long.width).tolist())]
    out = []
    for i in range(len(signal)):
        for peak, t in series:
            if peak.quiet_until >= i:
                continue
            was_on = peak.at >= 0
            found = peak.step(i, t[i], config.peak_height)
            if peak is short and was_on and short.value > short.threshold:
                long.quiet_until = short.at + short.width
                long.forget(float("inf"))
            if found is not None:
                out.append(found)
                peak.forget(t[i])
    return out


def events(signal: np.ndarray, config: EventConfig = EventConfig(), compat: bool = False) -> list[tuple[int, int, float, float]]:
    """(start, length, mean, sd) of each event; a signal without boundaries is one event.

    ``compat`` gives what an older event table kept: the first event with mean 0, the last one left out.
    """
    if not len(signal):
        return []
    cuts = [0, *boundaries(signal, config), len(signal)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        part = signal[a:b]
        if len(part):
            out.append((a, len(part), float(part.mean()), float(part.std())))
    if compat:
        out = [(a, n, 0.0 if i == 0 else m, s) for i, (a, n, m, s) in enumerate(out[:-1])]
        return out
    return [e for e in out if e[2] > 0] if (signal > 0).any() else out


def detect_events(reads: DataFrame, config: EventConfig = EventConfig(), key: str = "read_id", signal: str = "raw") -> DataFrame:
    """(key, event, start, length, mean, sd) of every read's signal: a fold over each read, Arrow batches of reads."""
    kind = reads.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0), b.column(1)):
                found = events(np.array(raw.as_py() or [], float), config)
                if found:
                    start, n, mean, sd = (list(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), b.column(0).type), pa.array(range(len(found)), pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(mean), pa.array(sd)], [key, "event", "start", "length", "mean", "sd"])

    return reads.select(key, signal).mapInArrow(run, f"{key} {kind}, event int, start long, length long, mean double, sd double")
