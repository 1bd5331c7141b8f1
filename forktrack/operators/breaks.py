"""Observed and expected run-off of fork tracks, in closed form instead of resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BreakConfig


def fork_lines(left: DataFrame | None, right: DataFrame | None) -> DataFrame:
    """Left and right forks in one table; either may be absent."""
    tables = [t.withColumn("is_right", F.lit(side)) for t, side in ((left, False), (right, True)) if t is not None]
    if not tables:
        raise ValueError("left forks or right forks are needed")
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1], allowMissingColumns=True)


def single_lines(lines: DataFrame, key: str = "read_id") -> DataFrame:
    """Lines of reads that have no other line: duplicates are dropped altogether."""
    again = lines.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return lines.join(again, key, "left_anti")


def with_track(forks: DataFrame, tracks: DataFrame, compat: bool = False) -> DataFrame:
    """Forks with the second-analogue track that shares their tip.

    Of a read's tracks the last by ``line`` counts. A fork whose track doesn't share its tip is dropped; with
    ``compat``, a read without any track behaves as one at (0, 0).
    """
    last = tracks.groupBy("read_id").agg(F.max_by(F.struct("start", "end"), "line").alias("t")).select("read_id", F.col("t.start").alias("track_start"), F.col("t.end").alias("track_end"))
    out = forks.join(last, "read_id", "left" if compat else "inner")
    if compat:
        out = out.fillna(0, ["track_start", "track_end"])
    return out.where(F.when(F.col("is_right"), F.col("end") == F.col("track_end")).otherwise(F.col("start") == F.col("track_start")))


def interior_lengths(tracks: DataFrame, config: BreakConfig = BreakConfig()) -> DataFrame:
    """Tracks further than the boundary from both read ends, with their length."""
    inside = (F.col("track_start") - F.col("read_start") > config.boundary) & (F.col("read_end") - F.col("track_end") > config.boundary)
    return tracks.where(inside).withColumn("track_length", F.col("track_end") - F.col("track_start"))


def length_stats(lengths: DataFrame) -> DataFrame:
    """(mean, sd, min_read_length): the least read length is the integer mean plus three deviations."""
    mean, sd = F.coalesce(F.avg("track_length"), F.lit(0.0)), F.coalesce(F.stddev_pop("track_length"), F.lit(0.0))
    return lengths.agg(mean.alias("mean"), sd.alias("sd")).withColumn("min_read_length", (F.col("mean").cast("int") + 3 * F.col("sd")).cast("int"))


def long_reads(reads: DataFrame, least: int) -> DataFrame:
    return reads.where(F.col("read_end") - F.col("read_start") >= least)


def run_off(tracks: DataFrame, tolerance: Column | int, config: BreakConfig = BreakConfig()) -> DataFrame:
    """Tracks whose fork starts away from the read's end, with ``gap`` to the end it moves to and ``run_off``."""
    right = F.col("is_right")
    origin = F.when(right, F.col("start") - F.col("read_start")).otherwise(F.col("read_end") - F.col("end"))
    gap = F.when(right, F.col("read_end") - F.col("end")).otherwise(F.col("start") - F.col("read_start"))
    limit = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    return tracks.withColumn("gap", gap).where(origin > config.boundary).withColumn("run_off", F.col("gap") < limit)


def sweep(rows: DataFrame, tolerances: tuple[int, ...]) -> DataFrame:
    """``rows`` once for each tolerance: a handful of literals, exploded without a join."""
    return rows.withColumn("tolerance", F.explode(F.array(*[F.lit(t) for t in tolerances])))


def expected_by_tolerance(reads: DataFrame, lengths: DataFrame, tolerances: tuple[int, ...], config: BreakConfig = BreakConfig()) -> DataFrame:
    """(tolerance, p): chance that a track of random length from a random place on a random read runs off.

    Lengths and read spans are counted first, so that what meets are distinct values with weights, and each
    distinct (span, length) pair has one clipped linear formula. Reads shorter than both boundaries are left out.
    """
    spans = reads.select((F.col("read_end") - F.col("read_start")).alias("span")).where(F.col("span") >= 2 * config.boundary).groupBy("span").agg(F.count("*").alias("w_span"))
    sizes = lengths.groupBy("track_length").agg(F.count("*").alias("w_length"))
    pairs = sweep(spans.crossJoin(F.broadcast(sizes)), tolerances)
    room = F.col("span") - 2 * config.boundary + 1
    first = F.greatest(F.lit(config.boundary), F.col("span") - F.col("tolerance") - F.col("track_length") + 1)
    hits = F.least(F.greatest(F.col("span") - config.boundary - first + 1, F.lit(0)), room)
    weight = F.col("w_span") * F.col("w_length")
    return pairs.groupBy("tolerance").agg((F.sum(hits / room * weight) / F.sum(weight)).alias("p"))


def observed_by_tolerance(tracks: DataFrame, tolerances: tuple[int, ...], config: BreakConfig = BreakConfig()) -> DataFrame:
    """(tolerance, p, n) of observed tracks."""
    flags = run_off(sweep(tracks, tolerances), F.col("tolerance"), config)
    return flags.groupBy("tolerance").agg(F.avg(F.col("run_off").cast("double")).alias("p"), F.count("*").alias("n"))


def pooled(by_tolerance: DataFrame, n: Column | int) -> DataFrame:
    """(p, sd) of draws pooled over tolerances: within variance p(1-p)/n, plus the variance between tolerances."""
    size = n if isinstance(n, Column) else F.lit(n)
    within = F.avg(F.col("p") * (1 - F.col("p")) / size)
    return by_tolerance.agg(F.avg("p").alias("p"), F.sqrt(within + F.var_pop("p")).alias("sd"))


def difference(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: both proportions with deviations, their difference, its deviation and 95 % interval."""
    o = observed.select(F.col("p").alias("observed"), F.col("sd").alias("observed_sd"))
    e = expected.select(F.col("p").alias("expected"), F.col("sd").alias("expected_sd"))
    both = o.crossJoin(e)  # one row each
    both = both.withColumn("difference", F.col("observed") - F.col("expected")).withColumn("difference_sd", F.sqrt(F.col("observed_sd") ** 2 + F.col("expected_sd") ** 2))
    return both.withColumn("low", F.col("difference") - 1.96 * F.col("difference_sd")).withColumn("high", F.col("difference") + 1.96 * F.col("difference_sd"))
