"""Fork bounds, partners and stress signatures from paired segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForkConfig
from ..functions import cigar
from .density import positive
from .match import fork_pairs
from .segment import rows_of

KEY = ["read_id", "direction", "left_coord", "left_idx", "right_coord", "right_idx"]


def paired(first: DataFrame, second: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """Pairs of both directions, with each segment's number of partners over both."""
    pairs = fork_pairs(first, second, config)
    for side in ("a", "b"):
        pairs = pairs.withColumn(f"{side}_partners", F.count("*").over(Window.partitionBy("read_id", f"{side}_left_coord")))
    return pairs


def bounds(pairs: DataFrame) -> DataFrame:
    """Fork coordinates: a segment that two forks share is cut at its middle.

    ``tip_partners`` is 1 where the fork's tip, on the second analogue, is shared.
    """
    right = F.col("direction") == "right"

    def edge(side, end, kind):
        middle = F.expr(f"({side}_left_{kind} + {side}_right_{kind}) div 2")
        return F.when(F.col(f"{side}_partners") == 2, middle).otherwise(F.col(f"{side}_{end}_{kind}"))

    out = pairs
    for kind in ("coord", "idx"):
        out = out.withColumn(f"left_{kind}", F.when(right, edge("a", "left", kind)).otherwise(edge("b", "left", kind)))
        out = out.withColumn(f"right_{kind}", F.when(right, edge("b", "right", kind)).otherwise(edge("a", "right", kind)))
    return out.withColumn("tip_partners", F.when(F.col("b_partners") == 2, 1).otherwise(0))


def signatures(forks: DataFrame, calls: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """Forks with their seven stress numbers: length, each track's length, and the share of calls of its own and
    the other analogue in each track, first analogue first. Shares of empty tracks are null.
    """
    right = F.col("direction") == "right"
    sized = (
        forks.withColumn("length", F.col("right_coord") - F.col("left_coord"))
        .withColumn("first_length", F.when(right, F.col("a_right_coord") - F.col("left_coord")).otherwise(F.col("right_coord") - F.col("a_left_coord")))
        .withColumn("second_length", F.when(right, F.col("right_coord") - F.col("b_left_coord")).otherwise(F.col("b_right_coord") - F.col("left_coord")))
        .withColumn("first_lo", F.when(right, F.col("left_idx")).otherwise(F.col("a_left_idx")))
        .withColumn("first_hi", F.when(right, F.col("a_right_idx")).otherwise(F.col("right_idx")))
        .withColumn("second_lo", F.when(right, F.col("b_left_idx")).otherwise(F.col("left_idx")))
        .withColumn("second_hi", F.when(right, F.col("right_idx")).otherwise(F.col("b_right_idx")))
    )
    keep = [*KEY, "tip_partners", "length", "first_length", "second_length"]
    lean = sized.select(*keep, "first_lo", "first_hi", "second_lo", "second_hi", F.least("first_lo", "second_lo").alias("lo"), F.greatest("first_hi", "second_hi").alias("hi"))
    rows = rows_of(calls, lean, "lo", "hi")
    edu, brdu = positive("p_edu", config.call_threshold), positive("p_brdu", config.call_threshold)

    def share(hit, side):
        inside = (F.col("idx") >= F.col(f"{side}_lo")) & (F.col("idx") < F.col(f"{side}_hi"))
        return F.avg(F.when(inside, hit))

    return rows.groupBy(*keep).agg(
        share(brdu, "first").alias("brdu_in_first"), share(edu, "first").alias("edu_in_first"), share(edu, "second").alias("edu_in_second"), share(brdu, "second").alias("brdu_in_second"),
    )


def query_span(forks: DataFrame, alignments: DataFrame) -> DataFrame:
    """Forks with the distance on the query between their ends, through the operations of their alignments.

    ``alignments``: read_id, ref_start, ref_end, is_reverse, ops. They are as many as the forks, so they are never
    broadcast, however small their files are; bases are not written out.
    """
    placed = forks.join(alignments.select("read_id", "ref_start", "ref_end", "is_reverse", "ops").hint("merge"), "read_id")

    def at(column):
        index = F.when(F.col("is_reverse"), F.col("ref_end") - F.col(column)).otherwise(F.col(column) - F.col("ref_start"))
        return cigar.query_at(F.col("ops"), F.col("is_reverse"), index)

    return placed.withColumn("query_span", F.abs(at("right_coord") - at("left_coord"))).drop("ref_start", "ref_end", "is_reverse", "ops")
