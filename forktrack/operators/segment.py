"""Segments of labelled calls: islands, trimming by local density, stitching across short gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForkConfig
from .density import positive

#: Columns of a segments table.
SEGMENT = ["read_id", "label", "left_coord", "left_idx", "right_coord", "right_idx"]


def segments(labelled: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """Islands of equal label, ambiguous rows apart.

    An island ends on the row that opens the next one, or on the read's last row; E and B islands of at least the
    least length are kept.
    """
    read = Window.partitionBy("read_id")
    ordered = read.orderBy("coord")
    ends = labelled.select("read_id", "coord", "idx", "label", F.max("coord").over(read).alias("last_coord"), F.max("idx").over(read).alias("last_idx"))
    sure = ends.where("label is not null").withColumn("before", F.lag("label").over(ordered))
    starts = sure.where(F.col("before").isNull() | (F.col("before") != F.col("label")))
    closed = starts.select(
        "read_id", "label", F.col("coord").alias("left_coord"), F.col("idx").alias("left_idx"),
        F.coalesce(F.lead("coord").over(ordered), "last_coord").alias("right_coord"),
        F.coalesce(F.lead("idx").over(ordered), "last_idx").alias("right_idx"),
    )
    return closed.where((F.col("label") != "T") & (F.abs(F.col("right_coord") - F.col("left_coord")) >= config.min_segment))


def rows_of(calls: DataFrame, spans: DataFrame, lo: str = "left_idx", hi: str = "right_idx") -> DataFrame:
    """Calls of each span, both ends included; every span column is kept."""
    own = calls.select(F.col("read_id").alias("_read"), "idx", "coord", "p_edu", "p_brdu")
    return spans.join(own, (F.col("read_id") == F.col("_read")) & F.col("idx").between(F.col(lo), F.col(hi))).drop("_read")


def trim(spans: DataFrame, calls: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """Long segments without the ends whose density is below that of their middle third."""
    long = F.col("right_coord") - F.col("left_coord") >= config.trim_span
    rows = rows_of(calls, spans.where(long))
    own = F.when(F.col("label") == "E", positive("p_edu", config.call_threshold)).otherwise(positive("p_brdu", config.call_threshold))
    other = F.when(F.col("label") == "E", positive("p_brdu", config.call_threshold)).otherwise(positive("p_edu", config.call_threshold))
    rows = rows.withColumn("net", own - other)
    key = ["read_id", "label", "left_coord", "left_idx", "right_coord", "right_idx"]
    span = Window.partitionBy(*key).orderBy("coord")
    inner, outer = span.rangeBetween(1 - config.radius, config.radius - 1), span.rangeBetween(-config.radius, config.radius)
    n = F.col("right_idx") - F.col("left_idx") + 1
    place = F.col("idx") - F.col("left_idx")
    middle = (place >= F.floor(n * 0.33)) & (place < n * 0.66)
    dense = rows.withColumn("density", F.when(middle, F.sum("net").over(inner) / F.count("*").over(inner)))
    dense = dense.withColumn("n_near", F.count("*").over(outer)).withColumn("net_near", F.greatest(F.sum("net").over(outer), F.lit(0)))
    least = dense.withColumn("least", F.avg("density").over(Window.partitionBy(*key)))
    # The least count is truncated toward zero, as an integer conversion does.
    needed = F.col("n_near") * F.coalesce("least", F.lit(0.0))
    passed = F.col("net_near") >= F.when(needed < 0, F.ceil(needed)).otherwise(F.floor(needed))
    bounds = least.where(passed).groupBy(*key).agg(F.min_by("coord", "idx").alias("lc"), F.min("idx").alias("li"), F.max_by("coord", "idx").alias("rc"), F.max("idx").alias("ri"))
    trimmed = bounds.select("read_id", "label", F.col("lc").alias("left_coord"), F.col("li").alias("left_idx"), F.col("rc").alias("right_coord"), F.col("ri").alias("right_idx"))
    return spans.where(~long).select(*SEGMENT).unionByName(trimmed)


def stitch(spans: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """Merge neighbours of one analogue that are close, with no segment of the other inside the gap.

    Segments of a read don't overlap, so one of the other analogue lies in the gap exactly if it stands between
    the two in the read's order: no self-join is needed.
    """
    read = Window.partitionBy("read_id").orderBy("left_coord")
    joins = (F.lag("label").over(read) == F.col("label")) & (F.col("left_coord") - F.lag("right_coord").over(read) < config.stitch_gap)
    marked = spans.withColumn("opens", F.when(joins, 0).otherwise(1))
    grouped = marked.withColumn("run", F.sum("opens").over(read))
    return grouped.groupBy("read_id", "label", "run").agg(
        F.min("left_coord").alias("left_coord"), F.min("left_idx").alias("left_idx"), F.max("right_coord").alias("right_coord"), F.max("right_idx").alias("right_idx"),
    ).select(*SEGMENT)


def paint(calls: DataFrame, spans: DataFrame) -> DataFrame:
    """(read_id, idx, coord, edu, brdu): whether each call lies in a segment of either analogue, ends included."""
    hits = rows_of(calls, spans).groupBy("read_id", "idx").agg(
        F.max(F.when(F.col("label") == "E", 1).otherwise(0)).alias("edu"), F.max(F.when(F.col("label") == "B", 1).otherwise(0)).alias("brdu"),
    )
    return calls.select("read_id", "idx", "coord").join(hits, ["read_id", "idx"], "left").fillna(0, ["edu", "brdu"])


def enough_calls(calls: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """Calls of reads with more than the least number of them."""
    n = F.count("*").over(Window.partitionBy("read_id"))
    return calls.withColumn("_n", n).where(F.col("_n") > config.min_calls).drop("_n")
