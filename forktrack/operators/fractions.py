"""Call fractions in windows whose ends depend on the calls, and the two clusters they fall into."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..config import ForkConfig


def window_ends(coord: np.ndarray, span: int, least: int) -> list[tuple[int, int]]:
    """(first, last) rows of consecutive windows: the shortest runs longer than ``span`` with ``least`` rows."""
    out, start, n = [], 0, len(coord)
    while start < n:
        end = max(int(np.searchsorted(coord, coord[start] + span, "right")), start + least - 1)
        if end >= n:
            break
        out.append((start, end))
        start = end + 1
    return out


def call_fractions(calls: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """(read_id, window, brdu_fraction, edu_fraction): a call positive for both counts as BrdU; a read's last,
    unfinished window is left out. Each read is folded in order, one Arrow group at a time.
    """
    t, span, least = config.call_threshold, config.fraction_span, config.fraction_calls

    def run(table: pa.Table) -> pa.Table:
        coord = np.asarray(table.column("coord"))
        order = np.argsort(coord, kind="stable")
        coord = coord[order]
        brdu = np.asarray(table.column("p_brdu"))[order] > t
        edu = (np.asarray(table.column("p_edu"))[order] > t) & ~brdu
        ends = window_ends(coord, span, least)
        read = table.column("read_id")[0]
        return pa.table({
            "read_id": pa.array([read.as_py()] * len(ends), table.schema.field("read_id").type), "window": pa.array(np.arange(len(ends)), pa.int32()),
            "brdu_fraction": pa.array([float(brdu[a:b + 1].mean()) for a, b in ends], pa.float64()),
            "edu_fraction": pa.array([float(edu[a:b + 1].mean()) for a, b in ends], pa.float64()),
        })

    kind = calls.schema["read_id"].dataType.simpleString()
    lean = calls.select("read_id", F.col("coord").cast("long").alias("coord"), "p_edu", "p_brdu")
    return lean.groupBy("read_id").applyInArrow(run, f"read_id {kind}, window int, brdu_fraction double, edu_fraction double")


@dataclass(frozen=True)
class TwoMeans:
    """Centroid, least member and population deviation of each cluster; an empty cluster has no least member."""

    centroid_1: float
    lower_1: float | None
    deviation_1: float
    centroid_2: float
    lower_2: float | None
    deviation_2: float


def two_means(values: DataFrame, column: str, start: tuple[float, float] = (0.01, 0.5), tolerance: float = 1e-4, iterations: int = 100) -> TwoMeans:
    """Two clusters on a line from fixed starts; ties go to the second. One small aggregate for each iteration.

    ``values`` is read in each iteration: give a written table.
    """
    x = F.col(column)
    c1, c2 = start
    row = None
    for _ in range(iterations):
        one = F.abs(x - F.lit(float(c1))) < F.abs(x - F.lit(float(c2)))
        stats = []
        for k, inside in ((1, one), (2, ~one)):
            v = F.when(inside, x)
            stats += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"m{k}"), F.min(v).alias(f"l{k}"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"s{k}")]
        row = values.where(x.isNotNull()).agg(*stats).first()
        moved = abs(row.m1 - c1) > tolerance or abs(row.m2 - c2) > tolerance
        c1, c2 = row.m1, row.m2
        if not moved:
            break
    return TwoMeans(row.m1, row.l1, row.s1, row.m2, row.l2, row.s2)


def incorporation(fractions: DataFrame, config: ForkConfig = ForkConfig()) -> dict[str, tuple[float, float | None]]:
    """(centroid, lower bound) of the higher cluster of each analogue; refuses too few windows."""
    fractions = tables.written(fractions, "fractions")
    n = fractions.agg(F.count("edu_fraction").alias("edu"), F.count("brdu_fraction").alias("brdu")).first()
    if min(n.edu, n.brdu) < config.least_windows:
        raise ValueError(f"{min(n.edu, n.brdu)} windows are too few to estimate incorporation")
    out = {}
    for name in ("edu", "brdu"):
        m = two_means(fractions, f"{name}_fraction")
        out[name] = (m.centroid_1, m.lower_1) if m.centroid_1 > m.centroid_2 else (m.centroid_2, m.lower_2)
    return out
