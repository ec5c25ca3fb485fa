"""Batteries of methods and settings over the same panel: the method or setting is a column."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.operators import folds
from covary.plans.base import query, spine
from covary.plans.scalar import r6
from covary.plans.trading import BT, backtest, signal_sql


_MEASURES = "count(r)::BIGINT AS n, round(sum(r), 5) AS total, round(avg((r > 0)::INT), 6) AS win_rate"


def _measured(df, *by):
    return df.groupBy(*by).agg(F.count("r").alias("n"), F.round(F.sum("r"), 5).alias("total"), r6(F.avg((F.col("r") > 0).cast("int"))).alias("win_rate"))


@query("b13_baselines", BT + f"SELECT method, pair, {_MEASURES} FROM (SELECT 'full' AS method, pair, net AS r FROM bt UNION ALL SELECT 'gross only', pair, gross FROM bt UNION ALL SELECT 'buy and hold', pair, (ry + rx) / 200 FROM bt UNION ALL SELECT 'market', pair, rm / 100 FROM bt) GROUP BY ALL")
def b13(spark, sf_dir):
    """The methods' returns side by side from one backtest: a row per day becomes a row per day and method by one explode."""
    one = lambda name, r: F.struct(F.lit(name).alias("method"), r.alias("r"))
    methods = F.array(one("full", F.col("net")), one("gross only", F.col("gross")), one("buy and hold", (F.col("ry") + F.col("rx")) / 200), one("market", F.col("rm") / 100))
    return _measured(backtest(spark, sf_dir).withColumn("v", F.explode(methods)).select("pair", "v.method", "v.r"), "method", "pair")


VARIANTS = [(0, 1.5, 0.5), (1, 1.0, 0.5), (2, 2.0, 0.5), (3, 1.5, 0.1)]
_VARIED = ", ".join(signal_sql(e, q, name=f"v{i}") for i, e, q in VARIANTS)
_ALL = " UNION ALL ".join(f"SELECT {i} AS config_id, pair, t, pos FROM v{i}" for i, _, _ in VARIANTS)


@query("b14_ablation", f", {_VARIED}, every AS ({_ALL}) SELECT *, round(total - first_value(total) OVER (PARTITION BY pair ORDER BY config_id), 4) AS delta FROM (SELECT config_id, pair, round(sum(r), 5) AS total FROM (SELECT config_id, e.pair, lag(pos) OVER (PARTITION BY config_id, e.pair ORDER BY e.t) * 0.05 * (ry - beta * rx) AS r FROM every e JOIN spine s ON s.pair = e.pair AND s.t = e.t) GROUP BY ALL)")
def b14(spark, sf_dir):
    """What each change of the rules does to a pair's total, against the full system (setting 0)."""
    s = spine(spark, sf_dir)
    swept = folds.sweep_signals(s, [(i, folds.Rules(entry=e, exit=q)) for i, e, q in VARIANTS])
    both = swept.join(s.select("pair", "t", (0.05 * (F.col("ry") - F.col("beta") * F.col("rx"))).alias("sr")), ["pair", "t"]).withColumn("r", F.lag("signal").over(x.pair_window("config_id", "pair")) * F.col("sr"))
    total = both.groupBy("config_id", "pair").agg(F.round(F.sum("r"), 5).alias("total"))
    full = F.first("total").over(Window.partitionBy("pair").orderBy("config_id"))
    return total.withColumn("delta", F.round(F.col("total") - full, 4))


@query("j13_positions", BT + "SELECT pair, signal, z, coalesce(qty, 0)::BIGINT AS qty, coalesce(qty, 0) * y AS value FROM (SELECT pair, arg_max(signal, t)::INT AS signal, arg_max(z, t) AS z, arg_max(y, t) AS y FROM bt WHERE z IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT pair, length(pair) - 15 AS qty FROM pairs WHERE length(pair) > 17) USING (pair)")
def j13(spark, sf_dir):
    """Latest signals with positions held; a pair without a position holds 0."""
    last = backtest(spark, sf_dir).filter("z is not null").groupBy("pair").agg(F.max_by(F.struct("signal", "z", "y"), "t").alias("v")).select("pair", "v.*")
    held = spine(spark, sf_dir).select("pair").distinct().filter(F.length("pair") > 17).select("pair", (F.length("pair") - 15).alias("qty"))
    qty = F.coalesce("qty", F.lit(0))
    return last.join(held, "pair", "left").select("pair", "signal", "z", qty.cast("bigint").alias("qty"), (qty * F.col("y")).alias("value"))


@query("b20_attribution", f", {signal_sql()}, {signal_sql(regime='calm', source='(SELECT *, 2 AS calm FROM spine)', name='flat')} SELECT pair, round(sum(a), 5) AS gated, round(sum(b), 5) AS ungated, round(sum(a) - sum(b), 4) AS timing_alpha FROM (SELECT s.pair, lag(g.pos) OVER w * 0.05 * (ry - beta * rx) AS a, lag(f.pos) OVER w * 0.05 * (ry - beta * rx) AS b FROM spine s JOIN sig g ON g.pair = s.pair AND g.t = s.t JOIN flat f ON f.pair = s.pair AND f.t = s.t WINDOW w AS (PARTITION BY s.pair ORDER BY s.t)) GROUP BY 1")
def b20(spark, sf_dir):
    """What the regime gate adds: the difference of totals with and without it."""
    s = folds.signals(spine(spark, sf_dir)).withColumn("calm", F.lit(2))
    s = folds.signals(s, regime="calm", name="ungated")
    sr = 0.05 * (F.col("ry") - F.col("beta") * F.col("rx"))
    s = s.withColumn("a", F.lag("signal").over(x.pair_window()) * sr).withColumn("b", F.lag("ungated").over(x.pair_window()) * sr)
    return s.groupBy("pair").agg(F.round(F.sum("a"), 5).alias("gated"), F.round(F.sum("b"), 5).alias("ungated"), F.round(F.sum("a") - F.sum("b"), 4).alias("timing_alpha"))
