"""Stall scores at fork tips."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForkConfig
from .density import positive

#: Codes of tips that have no score.
PARTNERED, SUSPECT, NEAR_END = -1.0, -2.0, -3.0


def scaled(drop: Column, beta: float = 1.0) -> Column:
    """Softplus scaling of a relative drop, 0 at 0 and 1 at 1."""
    alpha = 1 / math.log(2 / (1 + math.exp(-beta)))
    return F.lit(alpha) * (F.log(F.lit(1.0) + F.exp(F.lit(beta) * (drop - 1))) - F.lit(math.log(1 + math.exp(-beta))))


def stall_scores(forks: DataFrame, calls: DataFrame, second: str, config: ForkConfig = ForkConfig()) -> DataFrame:
    """Forks with ``score``; ``second`` is the call column of the second analogue.

    A shared tip is -1, one near a read's end -3, one with no more calls behind than ahead -2; a tip with too few
    calls on a side or too few positive ones behind has no score (null). The tip's own row counts as after it.
    """
    at_right = F.col("direction") == "right"
    tips = forks.withColumn("tip_idx", F.when(at_right, F.col("right_idx")).otherwise(F.col("left_idx")))
    # A tip that isn't shared is the end of its segment; a shared one has no score, wherever its middle is.
    tips = tips.withColumn("tip_coord", F.when(at_right, F.col("right_coord")).otherwise(F.col("left_coord")))
    own = calls.select(F.col("read_id").alias("_read"), "idx", "coord", positive(second, config.call_threshold).alias("hit"), F.count("*").over(Window.partitionBy("read_id")).alias("n_calls"))
    near = tips.join(own, (F.col("read_id") == F.col("_read")) & F.col("idx").between(F.col("tip_idx") - config.stall_rows, F.col("tip_idx") + config.stall_rows - 1))
    before, close = F.col("idx") < F.col("tip_idx"), F.abs(F.col("coord") - F.col("tip_coord")) < config.stall_radius
    out = near.groupBy(*tips.columns, "n_calls").agg(
        F.count(F.when(before & close, 1)).alias("n_before"), F.avg(F.when(before & close, F.col("hit"))).alias("f_before"),
        F.count(F.when(~before & close, 1)).alias("n_after"), F.avg(F.when(~before & close, F.col("hit"))).alias("f_after"),
    )
    behind = F.when(at_right, F.col("f_before")).otherwise(F.col("f_after"))
    ahead = F.when(at_right, F.col("f_after")).otherwise(F.col("f_before"))
    inside = (F.col("tip_idx") > config.stall_rows) & (F.col("tip_idx") < F.col("n_calls") - config.stall_rows)
    few = (F.col("n_before") < config.stall_attempts) | (F.col("n_after") < config.stall_attempts) | (behind < config.stall_near)
    score = (
        F.when(F.col("tip_partners") > 0, F.lit(PARTNERED)).when(~inside, F.lit(NEAR_END)).when(F.coalesce(few, F.lit(True)), F.lit(None).cast("double"))
        .when(behind > ahead, scaled((behind - ahead) / behind, config.stall_beta)).otherwise(F.lit(SUSPECT))
    )
    return out.withColumn("score", score).drop("n_calls", "n_before", "f_before", "n_after", "f_after", "tip_idx", "tip_coord")
