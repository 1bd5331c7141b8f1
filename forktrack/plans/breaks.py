"""Observed against expected run-off of forks: the test for breakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..config import BreakConfig
from ..operators import breaks


def analyse(left: DataFrame | None, right: DataFrame | None, tracks: DataFrame, reads: DataFrame, config: BreakConfig = BreakConfig(), compat: bool = False) -> DataFrame:
    """One row: expected, observed, difference, its interval, and the number of forks.

    Forks and tracks: read_id, start, end, read_start, read_end, tracks also ``line``; reads: read_start, read_end.
    """
    lines = breaks.single_lines(breaks.fork_lines(left, right))
    known = tables.written(breaks.with_track(lines, tracks, compat), "tracks")
    stats = breaks.length_stats(breaks.interior_lengths(known, config)).first()
    own = breaks.long_reads(known, stats.min_read_length)
    legacy = "is_legacy" in known.columns and bool(known.where("is_legacy").limit(1).count())
    tolerances = config.legacy_tolerances if legacy else config.tolerances
    seen = breaks.observed_by_tolerance(own, tolerances, config)
    n = seen.agg(F.max("n").alias("n")).first().n or 0
    if n < config.min_forks:
        raise ValueError("no forks are far enough from their read's ends")
    hoped = breaks.expected_by_tolerance(breaks.long_reads(reads, stats.min_read_length), breaks.interior_lengths(known, config), tolerances, config)
    return breaks.difference(breaks.pooled(seen, F.col("n")), breaks.pooled(hoped, n)).withColumn("n_forks", F.lit(n))
