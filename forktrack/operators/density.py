"""Density labels: net positive calls of each analogue within a radius of every call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForkConfig


def positive(column: str, threshold: float = 0.5) -> Column:
    return F.when(F.col(column) > threshold, 1).otherwise(0)


def label_calls(calls: DataFrame, edu_density: float | Column, brdu_density: float | Column, config: ForkConfig = ForkConfig()) -> DataFrame:
    """``calls`` with ``label``: E, B, T (neither), or null where both analogues pass.

    One range frame serves both analogues, so a read is shuffled and sorted once. Coordinates of a read must be
    distinct; the least count that passes is truncated to an integer.
    """
    near = Window.partitionBy("read_id").orderBy("coord").rangeBetween(-config.radius, config.radius)
    n = F.count("*").over(near)
    edu = F.sum(positive("p_edu", config.call_threshold)).over(near)
    brdu = F.sum(positive("p_brdu", config.call_threshold)).over(near)

    def passes(own, other, density):
        least = F.floor(n * (density if isinstance(density, Column) else F.lit(float(density))))
        return F.greatest(own - other, F.lit(0)) >= least

    e, b = passes(edu, brdu, edu_density), passes(brdu, edu, brdu_density)
    return calls.withColumn("label", F.when(e & b, F.lit(None)).when(e, F.lit("E")).when(b, F.lit("B")).otherwise(F.lit("T")))


def least_density(lower_bound: float | None, config: ForkConfig = ForkConfig()) -> float:
    """The density a region needs: the incorporation cluster's lower bound, or the floor."""
    return max(config.density_floor, lower_bound if lower_bound is not None else 0.0)
