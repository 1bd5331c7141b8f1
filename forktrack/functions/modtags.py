"""Base modification tags: delta-coded positions and quantised probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Modification codes of the two analogues in MM tags.
CODES = {"b": "p_brdu", "e": "p_edu"}


def quantise(p: Column) -> Column:
    """Probability to 0..255, rounded down."""
    return F.floor(p * 255).cast("int")


def restore(value: Column) -> Column:
    return value / 255


def deltas(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Rows with ``delta``: bases skipped since the position before, or since the start."""
    before = F.lag(position).over(Window.partitionBy(key).orderBy(position))
    return rows.withColumn("delta", F.col(position) - F.coalesce(before + 1, F.lit(0)))


def positions(rows: DataFrame, key: str, order: str, delta: str = "delta") -> DataFrame:
    """Rows with ``position`` restored from deltas."""
    return rows.withColumn("position", F.sum(F.col(delta) + 1).over(Window.partitionBy(key).orderBy(order)) - 1)


def _values(code: str) -> Column:
    return F.transform("r", lambda s: s[code].cast("smallint"))


def encode(calls: DataFrame, key: str = "read_id", position: str = "query_idx") -> DataFrame:
    """(key, mm, ml): one field for each analogue, BrdU first; values in the fields' order."""
    rows = deltas(calls, key, position)
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, "delta", quantise(F.col("p_brdu")).alias("b"), quantise(F.col("p_edu")).alias("e")))).alias("r"))
    skips = F.array_join(F.transform("r", lambda s: s["delta"].cast("string")), ",")
    mm = F.concat(*[F.concat(F.lit(f"N+{code}?,"), skips, F.lit(";")) for code in CODES])
    ml = F.concat(*[_values(code) for code in CODES])
    return held.select(key, mm.alias("mm"), ml.alias("ml"))


def decode(tags: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, code, query_idx, value): calls of each field; a field's values follow those of the fields before it."""
    fields = tags.select(key, "ml", F.posexplode(F.filter(F.split("mm", ";"), lambda f: f != "")).alias("field", "text"))
    parts = fields.withColumn("parts", F.split("text", ",")).withColumn("size", F.size("parts") - 1)
    before = Window.partitionBy(key).orderBy("field").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("code", F.regexp_extract("text", r"^N\+([a-z0-9]+)", 1))
    each = parts.where("size > 0").select(key, "code", "field", "offset", "ml", F.posexplode(F.slice("parts", 2, F.greatest(F.col("size"), F.lit(1)))).alias("n", "delta"))
    values = each.withColumn("value", F.get("ml", (F.col("offset") + F.col("n")).cast("int"))).withColumn("delta", F.col("delta").cast("int"))
    place = F.sum(F.col("delta") + 1).over(Window.partitionBy(key, "field").orderBy("n")) - 1
    return values.select(key, "code", place.cast("int").alias("query_idx"), F.col("value").cast("int").alias("value"))


def calls(decoded: DataFrame, query_map: DataFrame, reads: DataFrame, key: str = "read_id", compat: bool = False) -> DataFrame:
    """Calls on reference coordinates: (key, coord, p_edu, p_brdu), through the query-to-reference map.

    ``compat`` places reverse reads one base to the right, as the tag decoder that wrote older files did.
    """
    wide = decoded.groupBy(key, "query_idx").agg(*[F.max(F.when(F.col("code") == code, restore(F.col("value")))).alias(name) for code, name in CODES.items()])
    placed = wide.join(query_map, [key, "query_idx"]).join(reads.select(key, "ref_start", "ref_end", "is_reverse"), key)
    at = F.when(F.col("is_reverse"), F.col("ref_end") - F.col("ref_idx") - (0 if compat else 1)).otherwise(F.col("ref_start") + F.col("ref_idx"))
    return placed.select(key, at.cast("long").alias("coord"), "p_edu", "p_brdu")


def merged(mm: Column, ml: Column, new_mm: Column, new_ml: Column) -> tuple[Column, Column]:
    """Existing tags with new ones behind them."""
    return F.concat(F.coalesce(mm, F.lit("")), new_mm), F.concat(F.coalesce(ml, F.array().cast("array<smallint>")), new_ml)


__all__ = ["CODES", "calls", "decode", "deltas", "encode", "merged", "positions", "quantise", "restore"]
