"""Probabilities in log space; zero is minus infinity, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = float("-inf")


def log_of(x: Column) -> Column:
    """Natural logarithm; minus infinity at 0, an error below."""
    return F.when(x < 0, F.raise_error(F.lit("logarithm of a negative probability")).cast("double")).when(x == 0, F.lit(NEVER)).otherwise(F.log(x))


def exp_of(x: Column) -> Column:
    return F.when(x == NEVER, F.lit(0.0)).otherwise(F.exp(x))


def log_sum(a: Column, b: Column) -> Column:
    """log(exp a + exp b)."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(high == NEVER, F.lit(NEVER)).otherwise(high + F.log1p(F.exp(low - high)))


def log_product(a: Column, b: Column) -> Column:
    return a + b


def log_greater(a: Column, b: Column) -> Column:
    return a > b


def normal_density(mean: Column, sd: Column, x: Column) -> Column:
    return F.exp(-0.5 * ((x - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))


def uniform_density(low: Column, high: Column, x: Column) -> Column:
    return F.when((x >= low) & (x <= high), 1 / (high - low)).otherwise(F.lit(0.0))


def cauchy_density(location: Column, scale: Column, x: Column) -> Column:
    return 1 / (math.pi * scale * (1 + ((x - location) / scale) ** 2))


def log_normal_density(mean: Column, sd: Column, x: Column) -> Column:
    return -0.5 * math.log(2 * math.pi) - F.log(sd) - 0.5 * ((x - mean) / sd) ** 2
