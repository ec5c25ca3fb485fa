"""Returns net of costs, trades and performance measures from a signal column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covary.functions import exprs as x


def returns(df: DataFrame, hedge: str = "beta", keys: tuple[str, ...] = ("pair",), size: float = 0.05, slippage_bps: float = 5.0, commission: float = 1.0, notional: float = 10_000.0, signal: str = "signal") -> DataFrame:
    """Adds spread_return, gross, slippage, commission, impact and net (first row null)."""
    w = x.pair_window(*keys)
    every = Window.partitionBy(*keys)
    out = df.withColumn("spread_return", F.col("ry") - F.col(hedge) * F.col("rx")).withColumn("before", F.lag(signal).over(w)).withColumn("moved", F.coalesce(F.abs(F.col(signal) - F.col("before")), F.lit(0)))
    out = out.withColumn("gross", size * F.col("before") * F.col("spread_return")).withColumn("slippage", F.col("moved") * slippage_bps / 1e4)
    traded = (F.col("moved") > 0).cast("int")
    sigma = F.coalesce(x.rolling(F.stddev_samp, "ry", w, 20), F.stddev_samp("ry").over(every))
    out = out.withColumn("commission", traded * 2 * commission / notional).withColumn("impact", traded * 0.1 * sigma * math.sqrt(notional / 2e8))
    return out.withColumn("net", F.col("gross") - F.col("slippage") - F.col("commission") - F.col("impact"))


def metrics(df: DataFrame, by: list[str], r: str = "net", order: str = "t") -> DataFrame:
    """n, total, annual (-1 where all was lost), vol, sharpe (geometric), max_drawdown and win_rate of a return column; zeros where it does not vary."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = df.filter(F.col(r).isNotNull()).withColumn("_e", F.product(1 + F.col(r)).over(w)).withColumn("_p", F.max("_e").over(w))
    got = e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.product(1 + F.col(r)) - 1).alias("total"), (F.stddev_samp(r) * math.sqrt(252)).alias("vol"),
        F.min(F.col("_e") / F.col("_p") - 1).alias("max_drawdown"), F.avg((F.col(r) > 0).cast("int")).alias("win_rate"),
    )
    flat = F.coalesce(F.col("vol") == 0, F.lit(True))
    out = got.withColumn("annual", F.when(flat, 0.0).otherwise(F.pow(F.greatest(1 + F.col("total"), F.lit(0.0)), 252.0 / F.col("n")) - 1))
    out = out.withColumn("sharpe", F.when(flat, 0.0).otherwise(F.col("annual") / F.col("vol")))
    zero = lambda c: F.when(flat, 0.0).otherwise(F.col(c)).alias(c)
    return out.select(*by, "n", zero("total"), "annual", zero("vol"), "sharpe", zero("max_drawdown"), zero("win_rate"))


def trades(df: DataFrame, keys: tuple[str, ...] = ("pair",), signal: str = "signal", r: str = "net") -> DataFrame:
    """Closed trades: islands of a position and the row that ends it; pnl sums the returns from entry to exit."""
    w = x.pair_window(*keys)
    prev = F.coalesce(F.lag(signal).over(w), F.lit(0))
    out = df.withColumn("_prev", prev).withColumn("_open", ((F.col(signal) != 0) & (F.col("_prev") == 0)).cast("int")).withColumn("_close", ((F.col(signal) == 0) & (F.col("_prev") != 0)).cast("int"))
    out = out.withColumn("trade_id", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col(signal) != 0) | (F.col("_prev") != 0))
    got = out.groupBy(*keys, "trade_id").agg(
        F.min("date").alias("entry_date"), F.max("date").alias("exit_date"), F.max(F.when(F.col("_open") == 1, F.col(signal))).alias("entry_signal"), F.max(F.when(F.col("_open") == 1, F.col("z"))).alias("entry_z"),
        F.sum(r).alias("pnl"), F.max("_close").alias("_closed"),
    )
    return got.filter("_closed = 1").drop("_closed").withColumn("duration_days", F.datediff("exit_date", "entry_date")).withColumn("profitable", F.col("pnl") > 0)
