"""Hedge ratios and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_hedge(panel: DataFrame, train_end: str) -> DataFrame:
    """Adds beta, alpha (least squares over the rows up to train_end) and spread = y - beta x - alpha; pairs without them go.

    The sums are a window over the pair's partition, so that the panel's exchange by pair serves them.
    """
    every = Window.partitionBy("pair")
    early = F.col("date") <= F.lit(train_end).cast("date")
    y, x = F.when(early, F.col("y")), F.when(early, F.col("x"))
    out = panel.withColumn("beta", F.regr_slope(y, x).over(every)).withColumn("alpha", F.regr_intercept(y, x).over(every))
    return out.withColumn("spread", F.col("y") - F.col("beta") * F.col("x") - F.col("alpha")).filter(F.col("spread").isNotNull())


def naive_spread(panel: DataFrame) -> DataFrame:
    """Adds naive = y - (y0 / x0) x by the pair's first row."""
    w = Window.partitionBy("pair").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return panel.withColumn("naive", F.col("y") - F.first("y").over(w) / F.first("x").over(w) * F.col("x"))
