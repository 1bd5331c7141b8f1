"""Mutual nearest matching within a read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForkConfig

_SIDE = ["left_coord", "left_idx", "right_coord", "right_idx"]


def _sided(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("read_id", *[F.col(c).alias(f"{prefix}_{c}") for c in _SIDE if c in df.columns])


def _nearest(pairs: DataFrame, key: list[str]) -> DataFrame:
    of_a = Window.partitionBy(*key, "a_left_coord", "a_right_coord")
    of_b = Window.partitionBy(*key, "b_left_coord", "b_right_coord")
    ranked = pairs.select("*", F.min("distance").over(of_b).alias("_b"), F.row_number().over(of_a.orderBy("distance", "b_left_coord")).alias("_rank"))
    return ranked.where((F.col("_rank") == 1) & (F.col("distance") == F.col("_b"))).drop("_b", "_rank")


def mutual_nearest(a: DataFrame, b: DataFrame, allowed: Column, distance: Column) -> DataFrame:
    """Pairs of one read where each is the nearest of the other.

    If one ``a`` is as far from several ``b``, the leftmost of these is taken; several ``a`` that are as far from
    one ``b`` all stay. The read is the join key, so no pair is formed across reads.
    """
    return _nearest(_sided(a, "a").join(_sided(b, "b"), "read_id").where(allowed).withColumn("distance", distance), ["read_id"])


def fork_pairs(first: DataFrame, second: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """First-analogue segments (a) with the nearest second-analogue segment (b) on either side.

    ``direction`` is right where b lies to the right of a, and left where it lies to the left; segments don't
    overlap, so a pair has one direction, and both are matched over one join.
    """
    right, left = F.col("b_left_coord") >= F.col("a_right_coord"), F.col("a_left_coord") >= F.col("b_right_coord")
    pairs = _sided(first, "a").join(_sided(second, "b"), "read_id").where(right | left)
    pairs = pairs.withColumn("direction", F.when(right, F.lit("right")).otherwise(F.lit("left")))
    pairs = pairs.withColumn("distance", F.when(right, F.col("b_left_coord") - F.col("a_right_coord")).otherwise(F.col("a_left_coord") - F.col("b_right_coord")))
    return _nearest(pairs, ["read_id", "direction"]).where(F.col("distance") < config.pair_gap)


def right_pairs(first: DataFrame, second: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """Pairs with the second analogue to the right."""
    return fork_pairs(first, second, config).where("direction = 'right'")


def left_pairs(first: DataFrame, second: DataFrame, config: ForkConfig = ForkConfig()) -> DataFrame:
    """Pairs with the second analogue to the left."""
    return fork_pairs(first, second, config).where("direction = 'left'")


def _region(pairs: DataFrame, one: str, two: str) -> DataFrame:
    return pairs.select("read_id", F.least(one, two).alias("start"), F.greatest(one, two).alias("end"))


def origins(left_forks: DataFrame, right_forks: DataFrame) -> DataFrame:
    """Regions between a left fork and the nearest right fork that ends further right."""
    pairs = mutual_nearest(left_forks, right_forks, F.col("b_right_coord") >= F.col("a_right_coord"), F.col("b_right_coord") - F.col("a_left_coord"))
    return _region(pairs, "a_right_coord", "b_left_coord")


def terminations(left_forks: DataFrame, right_forks: DataFrame) -> DataFrame:
    """Regions between a left fork and the nearest right fork that ends no further right."""
    pairs = mutual_nearest(left_forks, right_forks, F.col("a_right_coord") >= F.col("b_right_coord"), F.col("a_right_coord") - F.col("b_left_coord"))
    return _region(pairs, "a_left_coord", "b_right_coord")
