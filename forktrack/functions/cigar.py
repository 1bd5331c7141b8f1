"""CIGAR strings and the maps between reference and query that they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations that consume the reference, and the query.
REFERENCE, QUERY = ("M", "=", "X", "D", "N"), ("M", "=", "X", "I", "S")


def parse(cigar: Column) -> Column:
    """Array of (len, op) of a CIGAR string."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), lambda s: F.struct(F.regexp_extract(s, r"\d+", 0).cast("int").alias("len"), F.substring(s, -1, 1).alias("op")))


def consumed(ops: Column, kinds: tuple[str, ...]) -> Column:
    used = F.filter(ops, lambda o: o["op"].isin(*kinds))
    return F.aggregate(used, F.lit(0), lambda total, o: total + o["len"])


def reference_end(position: Column, ops: Column) -> Column:
    return position + consumed(ops, REFERENCE)


def _ops(alignments: DataFrame, key: str, ops: str, reverse: str) -> DataFrame:
    """A row for each operation in sequencing order, with the reference and query bases before it."""
    ordered = F.when(F.col(reverse), F.reverse(F.col(ops))).otherwise(F.col(ops))
    rows = alignments.select(key, F.posexplode(ordered).alias("n", "o")).select(key, "n", F.col("o.op").alias("op"), F.col("o.len").alias("len"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)

    def prefix(kinds):
        return F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("len")).otherwise(0)).over(before), F.lit(0))

    return rows.withColumn("r0", prefix(REFERENCE)).withColumn("q0", prefix(QUERY))


def reference_to_query(alignments: DataFrame, key: str = "read_id", ops: str = "ops", reverse: str = "is_reverse") -> DataFrame:
    """(key, ref_idx, query_idx, is_del) of every reference base of a read; a deleted base has the next query base."""
    rows = _ops(alignments, key, ops, reverse).where(F.col("op").isin(*REFERENCE))
    each = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    deleted = F.col("op").isin("D", "N")
    return each.select(key, (F.col("r0") + F.col("x")).alias("ref_idx"), F.when(deleted, F.col("q0")).otherwise(F.col("q0") + F.col("x")).alias("query_idx"), deleted.alias("is_del"))


def query_at(ops: Column, is_reverse: Column, ref_idx: Column) -> Column:
    """The query_idx that ``reference_to_query`` has at a ref_idx, read from the operations; null outside the read."""
    ordered = F.when(is_reverse, F.reverse(ops)).otherwise(ops)
    zero = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.lit(None).cast("long").alias("at"))

    def step(s, o):
        on_reference, deleted = o["op"].isin(*REFERENCE), o["op"].isin("D", "N")
        here = on_reference & (ref_idx >= s["r"]) & (ref_idx < s["r"] + o["len"])
        return F.struct(
            (s["r"] + F.when(on_reference, o["len"]).otherwise(0)).alias("r"), (s["q"] + F.when(o["op"].isin(*QUERY), o["len"]).otherwise(0)).alias("q"),
            F.when(here, F.when(deleted, s["q"]).otherwise(s["q"] + ref_idx.cast("long") - s["r"])).otherwise(s["at"]).alias("at"),
        )

    return F.aggregate(ordered, zero, step)["at"]


def query_to_reference(alignments: DataFrame, key: str = "read_id", ops: str = "ops", reverse: str = "is_reverse") -> DataFrame:
    """(key, query_idx, ref_idx) of every query base; inserted and clipped bases go on from where the reference is."""
    rows = _ops(alignments, key, ops, reverse).where(F.col("op").isin(*QUERY))
    each = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    return each.select(key, (F.col("q0") + F.col("x")).alias("query_idx"), (F.col("r0") + F.col("x")).alias("ref_idx"))


def has_long_indel(ops: Column, most: int) -> Column:
    return F.exists(ops, lambda o: o["op"].isin("I", "D") & (o["len"] > most))


def coordinate(index: Column, ref_start: Column, ref_end: Column, is_reverse: Column, k: int = 9) -> Column:
    """Reference coordinate of the centre of the k-mer at an index in sequencing direction."""
    return F.when(is_reverse, ref_end - index - k // 2 - 1).otherwise(ref_start + index + k // 2)
