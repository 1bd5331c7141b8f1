"""Streaming forms: event-time windows of calls, and segments of molecules as they finish.

The reference analysis has one global step, the incorporation estimate; a stream takes its densities from a
batch that came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ForkConfig
from ..operators.fractions import window_ends


def tumbling(events: DataFrame, time: str, width: str, late: str, key: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over windows that follow one another."""
    grouped = (events.withWatermark(time, late) if events.isStreaming else events).groupBy(F.window(time, width), *key).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in grouped.columns if c != "window"])


def sliding(events: DataFrame, time: str, width: str, slide: str, late: str, key: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over windows that overlap."""
    grouped = (events.withWatermark(time, late) if events.isStreaming else events).groupBy(F.window(time, width, slide), *key).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in grouped.columns if c != "window"])


def sessions(events: DataFrame, time: str, gap: str, late: str, key: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over runs of events without a longer gap."""
    grouped = (events.withWatermark(time, late) if events.isStreaming else events).groupBy(F.session_window(time, gap), *key).agg(*aggregates)
    return grouped.select(F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), *[c for c in grouped.columns if c != "session_window"])


def fractions(calls: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """Call-fraction windows of a stream of calls, emitted as they close: (read_id, start, n, brdu, edu).

    State is the open window of each molecule, at most the calls since its last closed one, and where that ended.
    The calls that a trigger brings are sorted with the open ones before windows are cut, in however many frames they
    come. A call from before the end of a window that an earlier trigger closed is too late and is left out.
    """
    t, span, least = config.call_threshold, config.fraction_span, config.fraction_calls

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        coords, brdu, edu, closed = state.get if state.exists else ([], [], [], None)
        held = [(list(coords), list(brdu), list(edu))]
        for f in frames:
            f = f if closed is None else f[f["coord"] >= closed]
            hit = f["p_brdu"] > t
            held.append((f["coord"].tolist(), hit.astype(int).tolist(), ((f["p_edu"] > t) & ~hit).astype(int).tolist()))
        coord, brdu, edu = (np.array([v for part in held for v in part[k]], np.int64) for k in range(3))
        order = np.argsort(coord, kind="stable")
        coord, brdu, edu = coord[order], brdu[order], edu[order]
        rows, used = [], 0
        for a, b in window_ends(coord, span, least):
            n = b - a + 1
            rows.append((key[0], int(coord[a]), n, brdu[a:b + 1].sum() / n, edu[a:b + 1].sum() / n))
            used, closed = b + 1, int(coord[b])
        state.update((coord[used:].tolist(), brdu[used:].tolist(), edu[used:].tolist(), closed))
        yield pd.DataFrame(rows, columns=["read_id", "start", "n", "brdu_fraction", "edu_fraction"])

    kind = calls.schema["read_id"].dataType.simpleString()
    return calls.select("read_id", F.col("coord").cast("long").alias("coord"), "p_brdu", "p_edu").groupBy("read_id").applyInPandasWithState(
        run, f"read_id {kind}, start long, n long, brdu_fraction double, edu_fraction double", "coords array<long>, brdu array<int>, edu array<int>, closed long", "append", GroupStateTimeout.NoTimeout,
    )


def run_available(stream: DataFrame, sink: str, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what a stream has now into files."""
    stream.writeStream.format(sink).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
