"""Joins of reads with indexes, files and targets, and small relational helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..config import AlignmentFilter


def usable(alignments: DataFrame, limits: AlignmentFilter = AlignmentFilter()) -> DataFrame:
    """Alignments of enough quality and length with a sequence; both tests are plain columns, so a scan takes them."""
    return alignments.where((F.col("mapq") >= limits.min_quality) & (F.col("ref_end") - F.col("ref_start") >= limits.min_length) & (F.length("seq") > 0))


def fetch_id(alignments: DataFrame) -> Column:
    """The id that signal is stored under: the parent's for a split read."""
    return F.coalesce("pi", "read_id") if "pi" in alignments.columns else F.col("read_id")


def with_index(reads: DataFrame, index: DataFrame, key: str = "read_id") -> DataFrame:
    """Reads that the index knows, with their place."""
    return reads.join(index, key)


def missing_from(reads: DataFrame, index: DataFrame, key: str = "read_id") -> DataFrame:
    """Reads that the index doesn't know, for the log."""
    return reads.join(index.select(key), key, "left_anti")


def with_signal(reads: DataFrame, signals: DataFrame, key: str = "read_id") -> DataFrame:
    """Reads with the columns of their signal, the parent's for a split read; reads without one are dropped.

    ``signals``: a row for each stored read, with ``key`` and any others.
    """
    stored = signals.withColumnRenamed(key, "_stored")
    return reads.withColumn("_fetch", fetch_id(reads)).join(stored, F.col("_fetch") == F.col("_stored")).drop("_fetch", "_stored")


def reference_slices(alignments: DataFrame, genome: DataFrame, key: str = "read_id", tile: int = 1 << 16) -> DataFrame:
    """``alignments`` with ``reference``: the genome's bases from ref_start to before ref_end.

    ``genome``: contig, seq. Contigs are cut into tiles, which are what moves; an alignment meets the few that it
    spans, so a long contig is no hot key. Bases beyond a contig's end are missing, and so are alignments without any.
    """
    tiles = genome.where(F.length("seq") > 0).select(
        "contig", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"(length(seq) - 1) div {tile}").cast("int")), lambda i: F.substring("seq", i * tile + 1, F.lit(tile)))).alias("_tile", "_bases")
    )
    spans = alignments.where("ref_end > ref_start").select(key, "contig", "ref_start", "ref_end", F.explode(F.sequence(F.expr(f"ref_start div {tile}").cast("int"), F.expr(f"(ref_end - 1) div {tile}").cast("int"))).alias("_tile"))
    parts = spans.join(tiles, ["contig", "_tile"]).groupBy(key, "ref_start", "ref_end").agg(F.array_sort(F.collect_list(F.struct("_tile", "_bases"))).alias("_parts"))
    bases = F.array_join(F.transform("_parts", lambda p: p["_bases"]), "")
    sliced = parts.select(key, "ref_start", "ref_end", F.substring(bases, (F.col("ref_start") % tile + 1).cast("int"), (F.col("ref_end") - F.col("ref_start")).cast("int")).alias("reference"))
    return alignments.join(sliced.where("reference <> ''"), [key, "ref_start", "ref_end"])


def with_calls(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Aligned events with the calls of their coordinate, null where a read has none there."""
    return events.join(calls.select("read_id", "coord", "p_edu", "p_brdu"), ["read_id", "coord"], "left")


def latest(index: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    return index.groupBy(key).agg(F.max_by(F.struct(*[c for c in index.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def by_basename(names: DataFrame, name: str, paths: DataFrame, path: str) -> DataFrame:
    """Names with the first path, by order, whose last component they are; names that no file has are dropped."""
    first = paths.groupBy(basename(F.col(path)).alias("_base")).agg(F.min(path).alias(path))
    return names.join(first, F.col(name) == F.col("_base")).drop("_base")


def restricted(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    return rows.join(targets.select(key).distinct(), key, "left_semi")


def top_per_key(rows: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key: Spark prunes each task's rows by rank before the exchange."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def quantile_medians(rows: DataFrame, key: str, value: str, parts: int = 10) -> DataFrame:
    """(key, part, median): the middle element of each tenth of a key's sorted values."""
    sorted_values = rows.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("v"))
    step = F.floor(F.size("v") / parts)
    place = F.floor((F.col("part") * step + (F.col("part") + 1) * step) / 2)
    return sorted_values.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(key, "part", F.get("v", place.cast("int")).alias("median"))


def _upper_median(values: np.ndarray, n: int) -> float | None:
    """Element n // 2 of the sorted values, of which those beyond ``values`` are null."""
    return float(np.partition(values, n // 2)[n // 2]) if n // 2 < len(values) else None


def theil_sen_line(x: np.ndarray, y: np.ndarray, n: int) -> tuple[float | None, float | None]:
    """Slope and intercept, upper medians over all pairs; ``n`` counts points without a value too."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | ~np.isfinite(x[1:])])[: len(x)]  # equal infinities differ by nan, not by nought
    with np.errstate(all="ignore"):
        rows = [(y[end:] - y[start:end, None]) / (x[end:] - x[start]) for start, end in zip(first[:-1].tolist(), first[1:].tolist())]
        slopes = np.concatenate([np.zeros(0), *(r.ravel() for r in rows)])
        slope = _upper_median(slopes, len(slopes))
        return slope, None if slope is None else _upper_median(y - slope * x, n)


def theil_sen(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, slope, intercept): upper medians over all pairs of a key's points, which are bounded by thinning.

    The pairs of a key, of a thousand points at most, are plain arrays in a task and no rows; medians are selected,
    not sorted for.
    """
    lean = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def fit(group: pa.Table) -> pa.Table:
        known = group.filter(pc.and_(pc.is_valid(group["x"]), pc.is_valid(group["y"])))
        line = theil_sen_line(known["x"].to_numpy(), known["y"].to_numpy(), len(group))
        return pa.table([group[key].slice(0, 1), *(pa.array([v], pa.float64()) for v in line)], [key, "slope", "intercept"])

    return lean.groupBy(key).applyInArrow(fit, f"`{key}` {lean.schema[key].dataType.simpleString()}, slope double, intercept double")


def thinned(rows: DataFrame, key: str, order: list, trim: int = 50, most: int = 1000) -> DataFrame:
    """At most ``most`` evenly spaced rows of each key, after ``trim`` from both ends."""
    n = F.count("*").over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    numbered = rows.withColumn("_n", n - 2 * trim).withColumn("_at", place - trim)
    step = F.greatest(F.floor(F.col("_n") / most), F.lit(1))
    kept = numbered.where((F.col("_at") >= 0) & (F.col("_at") < F.col("_n")) & (F.col("_at") % step == 0) & (F.col("_at") / step < most))
    return kept.drop("_n", "_at")


def noise(rows: DataFrame, key: str, value: str, eps: float, least: float) -> DataFrame:
    """``rows`` with ``is_noise`` of density clustering on a line.

    A row is core if enough of its key lie within ``eps``, itself included; noise is neither core nor within
    ``eps`` of a core row. Two range frames over one sort.
    """
    near = f"OVER (PARTITION BY `{key}` ORDER BY `{value}` RANGE BETWEEN {float(eps)}D PRECEDING AND {float(eps)}D FOLLOWING)"
    n = F.count("*").over(Window.partitionBy(key))
    core = rows.withColumn("_core", (F.expr(f"count(*) {near}") >= F.floor(n * least)).cast("int"))
    return core.withColumn("is_noise", F.expr(f"max(_core) {near}") == 0).drop("_core")


def collected(rows: DataFrame, key: list[str], order: str, value: str, size: int | None = None) -> DataFrame:
    """(key, values): a key's values in order, zero-padded or cut to ``size``."""
    lists = rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("values"))
    if size is None:
        return lists
    return lists.withColumn("values", F.slice(F.concat("values", F.array_repeat(F.lit(0.0), size)), 1, size))


def intervals(rows: DataFrame, key: str, position: str, start: Column) -> DataFrame:
    """Rows with the half-open interval from the row before, the first from ``start``."""
    return rows.withColumn("interval_start", F.coalesce(F.lag(position).over(Window.partitionBy(key).orderBy(position)), start)).withColumn("interval_end", F.col(position))


def sharded(reads: DataFrame, order: str, size: int = 300) -> DataFrame:
    """Distinct reads with the number, from 1, of the shard of ``size`` they are written to.

    Ranks come from counts of range partitions, not from a window over everything: each partition numbers its own
    rows, and offsets are a row for each partition.
    """
    spread = tables.written(reads.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "shards")
    local = spread.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = local.join(F.broadcast(before), "_part")
    return numbered.withColumn("shard", (F.floor((F.col("_before") + F.col("_at") - 1) / size) + 1).cast("long")).drop("_part", "_at", "_before")


def first_reads(rows: DataFrame, key: str, most: int) -> DataFrame:
    """All rows of the first ``most`` reads by key: an exact limit, where a count of reads is asked for."""
    return rows.join(F.broadcast(rows.select(key).distinct().orderBy(key).limit(most)), key, "left_semi")


def by_file(rows: DataFrame, path: str = "path") -> DataFrame:
    """Rows of one signal file in one task, so that a file is opened once."""
    return rows.repartition(path).sortWithinPartitions(path)
