"""Hedges, signals, backtests, sweeps and their summaries (K, B) over the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.operators import backtest as b
from covary.operators import folds, jvmfolds
from covary.operators import joins as j
from covary.plans.base import query, spine
from covary.plans.relational import _PERIODS_SQL
from covary.plans.scalar import r6
from covary.sources import panel as p



def signal_sql(entry=1.5, leave=0.5, source="spine", regime="regime", name="sig"):
    """The signal machine as a recursive walk over row numbers."""
    e, q = f"(CASE WHEN s.{regime} = 1 THEN 2.0 ELSE {entry} END)", f"(CASE WHEN s.{regime} = 1 THEN 0.3 ELSE {leave} END)"
    new = f"""CASE WHEN s.z IS NULL OR s.{regime} IS NULL THEN g.pos
      WHEN g.pos <> 0 THEN CASE WHEN -g.pos * s.z > {e} * 2.0 OR s.t - g.since > 30 OR (s.{regime} <> 0 AND s.t - g.since >= 3 AND abs(s.z) < {q}) THEN 0 ELSE g.pos END
      WHEN s.{regime} <> 0 AND s.z > {e} THEN -1 WHEN s.{regime} <> 0 AND s.z < -{e} THEN 1 ELSE 0 END"""
    return f"""{name}(pair, t, pos, since) AS (SELECT pair, 0, 0, 0 FROM ols
    UNION ALL SELECT s.pair, s.t, {new}, CASE WHEN g.pos = 0 THEN s.t ELSE g.since END FROM {name} g JOIN {source} s ON s.pair = g.pair AND s.t = g.t + 1)"""


BT = f""",
{signal_sql()},
bt0 AS (SELECT s.*, pos AS signal, ry - beta * rx AS spread_return, lag(pos) OVER w AS before, CASE WHEN count(ry) OVER r >= 20 THEN stddev_samp(ry) OVER r END AS s20, stddev_samp(ry) OVER (PARTITION BY pair) AS sall
  FROM spine s JOIN sig USING (pair, t) WINDOW w AS (PARTITION BY pair ORDER BY t), r AS (PARTITION BY pair ORDER BY t ROWS 19 PRECEDING)),
bt1 AS (SELECT *, coalesce(abs(signal - before), 0) AS moved, 0.05 * before * spread_return AS gross FROM bt0),
bt AS (SELECT *, moved * 5.0 / 1e4 AS slippage, (moved > 0)::INT * 2 * 1.0 / 10000 AS commission, (moved > 0)::INT * 0.1 * coalesce(s20, sall) * sqrt(10000 / 2e8) AS impact,
  gross - moved * 5.0 / 1e4 - (moved > 0)::INT * 2 * 1.0 / 10000 - (moved > 0)::INT * 0.1 * coalesce(s20, sall) * sqrt(10000 / 2e8) AS net,
  CASE WHEN date <= DATE '{p.SPLIT}' THEN 'train' ELSE 'oos' END AS period FROM bt1)
"""


def metric_sql(source: str, by: str, r: str = "net", places: int = 6, of_ratio: int = 5):
    return f"""SELECT {by}, n, CASE WHEN flat THEN 0 ELSE round(total, {places}) END::DOUBLE AS total, round(annual, {places}) AS annual, CASE WHEN flat THEN 0 ELSE round(vol, {places}) END::DOUBLE AS vol,
  CASE WHEN flat THEN 0 ELSE round(annual / vol, {of_ratio}) END::DOUBLE AS sharpe, CASE WHEN flat THEN 0 ELSE round(dd, {places}) END::DOUBLE AS max_drawdown, CASE WHEN flat THEN 0 ELSE round(wr, {places}) END::DOUBLE AS win_rate
  FROM (SELECT *, coalesce(vol = 0, true) AS flat, CASE WHEN coalesce(vol = 0, true) THEN 0 ELSE greatest(1 + total, 0.0) ^ (252.0 / n) - 1 END::DOUBLE AS annual FROM (
    SELECT {by}, count(*)::BIGINT AS n, product(1 + {r}) - 1 AS total, stddev_samp({r}) * sqrt(252) AS vol, min(e / pk - 1) AS dd, avg(({r} > 0)::INT) AS wr FROM (
      SELECT *, max(e) OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT *, product(1 + {r}) OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING) AS e FROM {source} WHERE {r} IS NOT NULL)) GROUP BY {by}))"""


def backtest(spark, sf_dir):
    out = b.returns(jvmfolds.signals(spine(spark, sf_dir)))
    return out.withColumn("period", x.mark_period("date", p.SPLIT))


def rounded(m):
    return m.select(*[F.round(c, 5 if c == "sharpe" else 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@query("k3_fixed_hedge", "SELECT pair, t, round(spread, 4) AS spread, round(beta, 6) AS beta FROM spine")
def k3(spark, sf_dir):
    return spine(spark, sf_dir).select("pair", "t", F.round("spread", 4).alias("spread"), r6("beta").alias("beta"))


@query("k4_signals", BT + "SELECT pair, t, signal FROM bt")
def k4(spark, sf_dir):
    return folds.signals(spine(spark, sf_dir)).select("pair", "t", "signal")


def _kalman_sql(damp: bool, name="kal"):
    gain = "f.a * f.x / f.r" + (" * CASE WHEN len(f.h) >= 10 AND list_median(list_transform(f.h, lambda v: abs(v - list_median(f.h)))) > 1e-6 AND abs(f.e - list_median(f.h)) > 3 * list_median(list_transform(f.h, lambda v: abs(v - list_median(f.h)))) THEN 0.05 ELSE 1 END" if damp else "")
    return f""",
{name}(pair, t, w, c, h, e, sd) AS (SELECT pair, t, y / x, 1e-4::DOUBLE, []::DOUBLE[], 0.0::DOUBLE, sqrt(1e-3)::DOUBLE FROM spine WHERE t = 0
  UNION ALL SELECT pair, t, w + k * e, a - k * x * a, h, e, sqrt(r) FROM (SELECT *, {gain} AS k FROM (
    SELECT *, a * x * x + 1e-3 AS r, list_append(h0, e)[-50:] AS h FROM (SELECT s.pair, s.t, s.x, g.w, g.h AS h0, s.y - g.w * s.x AS e, g.c + 1e-4 * (CASE s.regime WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END) AS a FROM {name} g JOIN spine s ON s.pair = g.pair AND s.t = g.t + 1)) f))
"""


for _name, _damp in (("k1_kalman", True), ("k2_kalman_plain", False)):

    @query(_name, _kalman_sql(_damp) + "SELECT pair, t, round(e, 3) AS innovation, round(sd, 4) AS sd, round(w, 7) AS hedge FROM kal")
    def k1(spark, sf_dir, damp=_damp):
        got = folds.kalman(spine(spark, sf_dir).select("pair", "t", "y", "x", "regime"), damp)
        return got.select("pair", "t", F.round("innovation", 3).alias("innovation"), F.round("innovation_sd", 4).alias("sd"), F.round("hedge", 7).alias("hedge"))


_TRADES = """, tr AS (SELECT pair, id AS trade_id, min(date) AS entry_date, max(date) AS exit_date, max(CASE WHEN o = 1 THEN signal END) AS entry_signal, max(CASE WHEN o = 1 THEN z END) AS entry_z, sum(net) AS pnl FROM (
  SELECT *, sum(o) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS id FROM (SELECT *, coalesce(before, 0) AS pv, (signal <> 0 AND coalesce(before, 0) = 0)::INT AS o FROM bt)) WHERE signal <> 0 OR pv <> 0 GROUP BY 1, 2 HAVING max((signal = 0 AND pv <> 0)::INT) = 1)
"""


@query("k5_trades", BT + _TRADES + "SELECT pair, trade_id, entry_date, exit_date, entry_signal::INT AS entry_signal, entry_z, round(pnl, 6) AS pnl, (exit_date - entry_date)::INT AS duration_days, pnl > 0 AS profitable FROM tr")
def k5(spark, sf_dir):
    return b.trades(backtest(spark, sf_dir)).withColumn("pnl", r6("pnl"))


@query("j10_trade_returns", BT + _TRADES + "SELECT tr.pair, trade_id, round(sum(net), 6) AS pnl FROM tr JOIN bt ON bt.pair = tr.pair AND bt.date BETWEEN entry_date AND exit_date GROUP BY ALL")
def j10(spark, sf_dir):
    """Daily returns summed over each trade's days, by a range join within the pair."""
    bt = backtest(spark, sf_dir).select("pair", "date", "net", "t", "signal", "z")
    tr = b.trades(bt).select(F.col("pair").alias("p"), "trade_id", "entry_date", "exit_date")
    return tr.join(bt, (F.col("p") == F.col("pair")) & F.col("date").between(F.col("entry_date"), F.col("exit_date"))).groupBy("pair", "trade_id").agg(r6(F.sum("net")).alias("pnl"))


_GATE = """, hl AS (SELECT b.*, t % 40 < 25 AS healthy FROM bt b),
gate(pair, t, sick, pos) AS (SELECT pair, -1, 0, 0 FROM ols UNION ALL SELECT h.pair, h.t, CASE WHEN healthy THEN 0 ELSE sick + 1 END, CASE WHEN healthy THEN h.signal WHEN g.pos = 0 OR sick + 1 > 5 THEN 0 ELSE g.pos END FROM gate g JOIN hl h ON h.pair = g.pair AND h.t = g.t + 1)
"""


@query("k8_health_gate", BT + _GATE + "SELECT pair, t, pos AS gated FROM gate WHERE t >= 0")
def k8(spark, sf_dir):
    s = folds.signals(spine(spark, sf_dir)).withColumn("healthy", F.col("t") % 40 < 25)
    return folds.health_gate(s).select("pair", "t", "gated")


@query("k9_health_sizing", BT + "SELECT pair, t, signal * (CASE WHEN h < 0.4 THEN 0.0 WHEN h < 0.6 THEN 0.5 WHEN h < 0.8 THEN 0.75 ELSE 1.0 END)::DOUBLE AS sized FROM (SELECT *, coalesce(last_value(CASE WHEN t % 5 = 0 AND z IS NOT NULL THEN abs(z) / 2 END IGNORE NULLS) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING), 1.0) AS h FROM bt)")
def k9(spark, sf_dir):
    score = x.ffill(F.when((F.col("t") % 5 == 0) & F.col("z").isNotNull(), F.abs("z") / 2), x.pair_window(), 1.0)
    return folds.signals(spine(spark, sf_dir)).select("pair", "t", (F.col("signal") * x.size_by_health(score)).alias("sized"))


@query("b1_b4_net_returns", BT + "SELECT pair, t, round(spread_return, 6) AS spread_return, round(gross, 6) AS gross, round(slippage, 8) AS slippage, round(commission, 8) AS commission, round(impact, 8) AS impact, round(net, 6) AS net FROM bt")
def b1(spark, sf_dir):
    return backtest(spark, sf_dir).select("pair", "t", r6("spread_return").alias("spread_return"), r6("gross").alias("gross"), *[F.round(c, 8).alias(c) for c in ("slippage", "commission", "impact")], r6("net").alias("net"))


@query("b6_metrics", BT + metric_sql("bt", "pair, period"))
def b6(spark, sf_dir):
    return rounded(b.metrics(backtest(spark, sf_dir), ["pair", "period"]))


@query("b7_arithmetic_sharpe", BT + "SELECT pair, round(((1 + avg(net)) ^ 252 - 1) / nullif(stddev_pop(net) * sqrt(252), 0), 4) AS sharpe, round(avg(net) / nullif(stddev_pop(net), 0) * sqrt(252), 6) AS plain FROM bt GROUP BY 1")
def b7(spark, sf_dir):
    m, s = F.avg("net"), F.nullif(F.stddev_pop("net"), F.lit(0.0))
    return backtest(spark, sf_dir).groupBy("pair").agg(F.round((F.pow(1 + m, F.lit(252.0)) - 1) / (s * 252**0.5), 4).alias("sharpe"), r6(m / s * 252**0.5).alias("plain"))


@query("b9_trade_counts", BT + "SELECT pair, count(*) FILTER (moved > 0 AND signal <> 0)::BIGINT AS entries, (count(*) FILTER (moved > 0) // 2)::BIGINT AS round_trips FROM bt GROUP BY 1")
def b9(spark, sf_dir):
    return backtest(spark, sf_dir).groupBy("pair").agg(F.count_if((F.col("moved") > 0) & (F.col("signal") != 0)).alias("entries"), F.expr("count_if(moved > 0) div 2").alias("round_trips"))


@query("b10_cost_breakdown", BT + "SELECT pair, round(1e4 * sum(gross), 3) AS gross_bps, round(1e4 * sum(slippage), 3) AS slippage_bps, round(1e4 * sum(commission), 3) AS commission_bps, round(1e4 * sum(impact), 3) AS impact_bps FROM bt GROUP BY 1")
def b10(spark, sf_dir):
    return backtest(spark, sf_dir).groupBy("pair").agg(*[F.round(1e4 * F.sum(c), 3).alias(c + "_bps") for c in ("gross", "slippage", "commission", "impact")])


@query("b11_by_regime", BT + "SELECT regime, count(*)::BIGINT AS days, round(sum(net), 5) AS total, round(avg(net), 8) AS mean_net FROM bt GROUP BY 1")
def b11(spark, sf_dir):
    return backtest(spark, sf_dir).groupBy("regime").agg(F.count(F.lit(1)).alias("days"), F.round(F.sum("net"), 5).alias("total"), F.round(F.avg("net"), 8).alias("mean_net"))


@query("b12_buy_hold", metric_sql("(SELECT pair, t, (ry + rx) / 200 AS net FROM spine)", "pair"))
def b12(spark, sf_dir):
    """Half of each leg, held throughout (a hundredth of the money)."""
    return rounded(b.metrics(spine(spark, sf_dir).select("pair", "t", ((F.col("ry") + F.col("rx")) / 200).alias("net")), ["pair"]))


_CALM = signal_sql(regime="calm", source="(SELECT *, 2 AS calm FROM spine)", name="calm_sig")


@query("b5_no_regime", f", {_CALM}, {signal_sql()} SELECT pair, t, a.pos AS signal, c.pos AS baseline FROM sig a JOIN calm_sig c USING (pair, t)")
def b5(spark, sf_dir):
    """The baseline whose regime is always normal, beside the gated signal."""
    s = folds.signals(spine(spark, sf_dir)).withColumn("calm", F.lit(2))
    return folds.signals(s, regime="calm", name="baseline").select("pair", "t", "signal", "baseline")


SWEEP = [(i, e, q) for i, (e, q) in enumerate((e, q) for e in (1.0, 1.25, 1.5, 1.75, 2.0) for q in (0.25, 0.5, 0.75))]
_SWEPT = ", ".join(signal_sql(e, q, name=f"g{i}") for i, e, q in SWEEP)
_SWEPT_ALL = " UNION ALL ".join(f"SELECT {i} AS config_id, pair, t, pos FROM g{i}" for i, _, _ in SWEEP)


@query("b15_sensitivity", f", {_SWEPT}, every AS ({_SWEPT_ALL}) SELECT config_id, pair, count(*) FILTER (pos <> 0)::BIGINT AS active, round(sum(r), 5) AS gross FROM (SELECT config_id, e.pair, pos, lag(pos) OVER (PARTITION BY config_id, e.pair ORDER BY e.t) * 0.05 * (ry - beta * rx) AS r FROM every e JOIN spine s ON s.pair = e.pair AND s.t = e.t) GROUP BY ALL")
def b15(spark, sf_dir):
    """Fifteen settings of entry and exit in one job: the pair's rows are exchanged once."""
    s = spine(spark, sf_dir)
    swept = folds.sweep_signals(s, [(i, folds.Rules(entry=e, exit=q)) for i, e, q in SWEEP])
    both = swept.join(s.select("pair", "t", (0.05 * (F.col("ry") - F.col("beta") * F.col("rx"))).alias("sr")), ["pair", "t"])
    both = both.withColumn("r", F.lag("signal").over(x.pair_window("config_id", "pair")) * F.col("sr"))
    return both.groupBy("config_id", "pair").agg(F.count_if(F.col("signal") != 0).alias("active"), F.round(F.sum("r"), 5).alias("gross"))


@query("b18_stress", BT + f"SELECT name, pair, count(*)::BIGINT AS days, round(100 * (product(1 + net) - 1), 4) AS strategy_pct, round(100 * (product(1 + rm / 100) - 1), 4) AS market_pct, round(avg((moved > 0)::INT), 6) AS trade_rate, round(avg((regime = 0)::INT), 6) AS crisis FROM bt JOIN (VALUES {_PERIODS_SQL}) c(name, a, b) ON date BETWEEN a AND b GROUP BY ALL")
def b18(spark, sf_dir):
    d = j.in_periods(backtest(spark, sf_dir), j.periods(spark))
    return d.groupBy("name", "pair").agg(F.count(F.lit(1)).alias("days"), F.round(100 * x.compound("net"), 4).alias("strategy_pct"), F.round(100 * x.compound(F.col("rm") / 100), 4).alias("market_pct"), r6(F.avg((F.col("moved") > 0).cast("int"))).alias("trade_rate"), r6(F.avg((F.col("regime") == 0).cast("int"))).alias("crisis"))


@query("b19_filter_impact", BT + _GATE + "SELECT b.pair, count(*) FILTER (b.signal <> 0 AND g.pos = 0)::BIGINT AS blocked, round(avg((b.t % 40 < 25)::INT), 6) AS healthy FROM bt b JOIN gate g USING (pair, t) GROUP BY 1")
def b19(spark, sf_dir):
    s = folds.health_gate(folds.signals(spine(spark, sf_dir)).withColumn("healthy", F.col("t") % 40 < 25))
    return s.groupBy("pair").agg(F.count_if((F.col("signal") != 0) & (F.col("gated") == 0)).alias("blocked"), r6(F.avg(F.col("healthy").cast("int"))).alias("healthy"))


@query("b16_walk_forward", BT + "SELECT f::INT AS fold, pair, count(net)::BIGINT AS n, round(sum(net), 5) AS total, round(avg((net > 0)::INT), 6) AS win_rate FROM bt JOIN range(5) r(f) ON t BETWEEN 150 + 30 * f AND 150 + 30 * f + 49 GROUP BY ALL")
def b16(spark, sf_dir):
    """Out-of-sample windows of an expanding walk, every fold of every pair at once."""
    folds_ = j.walk_forward_folds(spark, 320, 150, 30, 50)
    d = backtest(spark, sf_dir).join(F.broadcast(folds_), F.col("t").between(F.col("test_start_t"), F.col("test_end_t")))
    return d.groupBy("fold", "pair").agg(F.count("net").alias("n"), F.round(F.sum("net"), 5).alias("total"), r6(F.avg((F.col("net") > 0).cast("int"))).alias("win_rate"))


def fold_metrics(spark, sf_dir):
    """Metrics of every test window of every pair's own walk."""
    return b.metrics(j.in_own_folds(backtest(spark, sf_dir), 150, 30, 50), ["pair", "fold"])


WALK = BT + """, own AS (SELECT pair, unnest(range(0, (max(t) + 1 - 200) // 30 + 1))::INT AS fold FROM bt GROUP BY 1 HAVING max(t) + 1 >= 200),
walk AS (SELECT fold, b.* FROM bt b JOIN own o ON o.pair = b.pair AND b.t BETWEEN 150 + 30 * o.fold AND 199 + 30 * o.fold)
"""


@query("b16_walk_forward_whole", WALK + metric_sql("walk", "pair, fold"))
def b16_whole(spark, sf_dir):
    """The walk over as many folds as each pair's rows allow; b16_walk_forward and its SQL stop at five."""
    return rounded(fold_metrics(spark, sf_dir))
