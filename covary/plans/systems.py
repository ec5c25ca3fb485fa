"""Whole systems and studies over them: baselines, ablations, walks with refitted hedges, health-gated backtests, rotation, significance."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.functions import udfs
from covary.operators import backtest as b
from covary.operators import folds
from covary.operators import joins as j
from covary.operators import schedules as sc
from covary.operators import systems as sy
from covary.operators.systems import NO_STOP, System
from covary.plans.base import query, spine
from covary.plans.research import HEALTH, _health, p_sql
from covary.plans.scalar import r6
from covary.plans.trading import _kalman_sql, metric_sql, rounded, signal_sql
from covary.sources import panel as p
from covary.sources.sinks import written

R = folds.Rules
BASELINES = [
    System("full"),
    System("distance", "distance", costs="slippage", gated=False),
    System("least squares", "fixed", costs="slippage", gated=False),
    System("kalman only", gated=False, costs="slippage"),
    System("regime only", "fixed", R(entry_volatile=2.0, exit_volatile=0.4), costs="slippage"),
]
ABLATIONS = [
    System("full"),
    System("no damping", "plain"),
    System("no regime", gated=False),
    System("no kalman", "fixed"),
    System("short z window", z_rows=10),
    System("no stop", rules=R(stop=NO_STOP)),
    System("no least hold", rules=R(min_hold=0)),
    System("no costs", costs="none"),
    System("no volatile rules", rules=R(entry_volatile=1.5, exit_volatile=0.5)),
]


# regimes by the pair's own train quantiles of volatility, as in m4: levels of other markets would call every row of these a crisis
QUANTILES = f""",
qcut AS (SELECT pair, quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.66) AS hi FROM spine WHERE date <= DATE '{p.SPLIT}' GROUP BY 1),
qspine AS (SELECT s.* REPLACE (CASE WHEN vol IS NULL THEN 2 WHEN vol > hi THEN 0 WHEN vol > lo THEN 1 ELSE 2 END AS regime) FROM spine s LEFT JOIN qcut USING (pair))"""


def quantile_spine(spark, sf_dir):
    """The spine with regimes by the pair's train quantiles of volatility."""
    q, early = Window.partitionBy("pair"), F.when(F.col("date") <= F.lit(p.SPLIT).cast("date"), F.col("vol"))
    s = spine(spark, sf_dir).withColumn("_lo", F.percentile(early, 0.33).over(q)).withColumn("_hi", F.percentile(early, 0.66).over(q))
    v = F.col("vol")
    return s.withColumn("regime", F.when(v.isNull(), 2).when(v > F.col("_hi"), 0).when(v > F.col("_lo"), 1).otherwise(2)).drop("_lo", "_hi")


def _move_sql(rules: R) -> str:
    """The machine's next position from a row s and the state g; rules of numbers or of columns."""
    e = f"(CASE WHEN s.regime = 1 THEN {rules.entry_volatile} ELSE {rules.entry} END)"
    q = f"(CASE WHEN s.regime = 1 THEN {rules.exit_volatile} ELSE {rules.exit} END)"
    return f"""CASE WHEN s.z IS NULL OR s.regime IS NULL THEN g.pos
      WHEN g.pos <> 0 THEN CASE WHEN -g.pos * s.z > {e} * {rules.stop} OR s.t - g.since > {rules.max_hold} OR (s.regime <> 0 AND s.t - g.since >= {rules.min_hold} AND abs(s.z) < {q}) THEN 0 ELSE g.pos END
      WHEN s.regime <> 0 AND s.z > {e} THEN -1 WHEN s.regime <> 0 AND s.z < -{e} THEN 1 ELSE 0 END"""


def machine_sql(name: str, source: str, rules: R, pair: str = "pair") -> str:
    """The signal machine over (pair, t, z, regime) of a source, as a recursive walk."""
    return f"""{name}({pair}, t, pos, since) AS (SELECT DISTINCT {pair}, -1, 0, 0 FROM {source}
    UNION ALL SELECT s.{pair}, s.t, {_move_sql(rules)}, CASE WHEN g.pos = 0 THEN s.t ELSE g.since END FROM {name} g JOIN {source} s ON s.{pair} = g.{pair} AND s.t = g.t + 1)"""


def grid_sql(name: str, source: str, systems: list[System]) -> str:
    """The same machine for every setting of a grid at once: name(system, pair, t, pos, since)."""
    number = lambda v: f"'{v!r}'::DOUBLE"
    rows = ", ".join(f"('{s.name}', {', '.join(number(v) for v in (s.rules.entry, s.rules.exit, s.rules.entry_volatile, s.rules.exit_volatile))}, {s.rules.max_hold})" for s in systems)
    move = _move_sql(R("r.enter", "r.leave", "r.enter_volatile", "r.leave_volatile", max_hold="r.longest"))
    return f"""grid AS (SELECT * FROM (VALUES {rows}) v(system, enter, leave, enter_volatile, leave_volatile, longest)),
{name}(system, pair, t, pos, since) AS (SELECT system, pair, -1, 0, 0 FROM grid CROSS JOIN (SELECT DISTINCT pair FROM {source})
    UNION ALL SELECT g.system, s.pair, s.t, {move}, CASE WHEN g.pos = 0 THEN s.t ELSE g.since END FROM {name} g JOIN grid r ON r.system = g.system JOIN {source} s ON s.pair = g.pair AND s.t = g.t + 1)"""


def _z_sql(name: str, source: str, n: int) -> str:
    """(pair, t, regime, hedge, z): the rolling z-score of s."""
    return f"""{name} AS (SELECT pair, t, regime, hedge, round(CASE WHEN total < {n} THEN CASE WHEN ne >= 10 THEN (s - mue) / (sde + 1e-8) END WHEN nw >= {n} THEN (s - mu) / (sd + 1e-8) END, 6) AS z
  FROM (SELECT *, count(*) OVER (PARTITION BY pair) AS total, avg(s) OVER w AS mu, stddev_samp(s) OVER w AS sd, count(s) OVER w AS nw, avg(s) OVER e AS mue, stddev_samp(s) OVER e AS sde, count(s) OVER e AS ne
    FROM {source} WINDOW w AS (PARTITION BY pair ORDER BY t ROWS {n - 1} PRECEDING), e AS (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING)))"""


def systems_sql(systems: list[System], settings: list[System] = ()) -> str:
    """CTEs up to sysbt(system, pair, t, date, period, signal, net, rm) of the systems, or of one system's settings that differ in their rules alone."""
    parts, arms = [], []
    calm = "calm AS (SELECT * REPLACE (2 AS regime) FROM spine)"
    parts.append(calm)
    needed = {(s.hedge, s.gated) for s in systems}
    for hedge, gated in sorted(needed):
        source, name = ("qspine" if gated else "calm"), f"h_{hedge}_{int(gated)}"
        if hedge in ("kalman", "plain"):
            parts.append(_kalman_sql(hedge == "kalman", f"k_{name}").strip().removeprefix(",").replace("FROM spine", f"FROM {source}").replace("JOIN spine", f"JOIN {source}").strip())
            parts.append(f"{name} AS (SELECT k.pair, k.t, s.regime, k.e AS s, k.w AS hedge FROM k_{name} k JOIN {source} s USING (pair, t))")
        elif hedge == "fixed":
            parts.append(f"{name} AS (SELECT pair, t, regime, spread AS s, beta AS hedge FROM {source})")
    for i, s in enumerate(systems):
        if s.hedge == "distance":
            parts.append(f"d0_{i} AS (SELECT *, y / first_value(y) OVER w - x / first_value(x) OVER w AS s FROM spine WINDOW w AS (PARTITION BY pair ORDER BY t))")
            parts.append(f"z_{i} AS (SELECT pair, t, 2 AS regime, 1.0 AS hedge, round((s - avg(s) FILTER (date <= DATE '{p.SPLIT}') OVER q) / coalesce(nullif(stddev_samp(s) FILTER (date <= DATE '{p.SPLIT}') OVER q, 0), 1e-8), 6) AS z FROM d0_{i} WINDOW q AS (PARTITION BY pair))")
            parts.append(f"""m_{i}(pair, t, pos) AS (SELECT DISTINCT pair, -1, 0 FROM z_{i} UNION ALL SELECT s.pair, s.t, CASE WHEN s.z IS NULL THEN g.pos WHEN g.pos = 0 THEN CASE WHEN s.z > 2 THEN -1 WHEN s.z < -2 THEN 1 ELSE 0 END
              WHEN abs(s.z) < 0.1 OR (g.pos = 1 AND s.z > 4) OR (g.pos = -1 AND s.z < -4) THEN 0 ELSE g.pos END FROM m_{i} g JOIN z_{i} s ON s.pair = g.pair AND s.t = g.t + 1)""")
        else:
            parts.append(_z_sql(f"z_{i}", f"h_{s.hedge}_{int(s.gated)}", s.z_rows))
            parts.append(grid_sql(f"m_{i}", f"z_{i}", settings) if settings else machine_sql(f"m_{i}", f"z_{i}", s.rules))
        arms.append(f"SELECT {'m.system' if settings else repr(s.name) + ' AS system'}, '{s.costs}' AS costs, m.pair, m.t, m.pos AS signal, z.hedge FROM m_{i} m JOIN z_{i} z USING (pair, t)")
    parts.append(f"arms AS ({' UNION ALL '.join(arms)})")
    parts.append("""sy0 AS (SELECT a.*, s.date, s.ry, s.rx, s.rm, lag(signal) OVER w AS before, CASE WHEN count(ry) OVER r >= 20 THEN stddev_samp(ry) OVER r END AS s20, stddev_samp(ry) OVER (PARTITION BY system, a.pair) AS sall
  FROM arms a JOIN spine s ON s.pair = a.pair AND s.t = a.t WINDOW w AS (PARTITION BY system, a.pair ORDER BY a.t), r AS (PARTITION BY system, a.pair ORDER BY a.t ROWS 19 PRECEDING))""")
    parts.append(f"""sysbt AS (SELECT system, pair, t, date, CASE WHEN date <= DATE '{p.SPLIT}' THEN 'train' ELSE 'oos' END AS period, signal, rm, ry, rx, moved,
  before * (ry - hedge * rx) - CASE WHEN costs = 'none' THEN 0 ELSE moved * 5.0 / 1e4 END - CASE WHEN costs = 'all' THEN (moved > 0)::INT * (2 * 1.0 / 10000 + 0.1 * coalesce(s20, sall) * sqrt(10000 / 2e8)) ELSE 0 END AS net FROM (SELECT *, coalesce(abs(signal - before), 0) AS moved FROM sy0))""")
    return QUANTILES + ",\n" + ",\n".join(parts) + "\n"


def t_cdf_sql(t: str, df: str) -> str:
    """Student's t distribution for whole degrees of freedom: a finite sum of powers of a cosine (other than the library's continued fraction)."""
    sine, cos2 = f"(abs({t}) / sqrt({df} + {t} * {t}))", f"greatest({df} / ({df} + {t} * {t}), 1e-300)"
    even = f"{sine} * list_sum(list_transform(range(({df} // 2)::BIGINT), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + j * ln({cos2}))))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {sine} * sqrt({cos2}) * coalesce(list_sum(list_transform(range((({df} - 1) // 2)::BIGINT), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5) + j * ln({cos2})))), 0))"
    return f"(0.5 + sign({t}) * least(CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END, 1) / 2)"


def chi2_sf_sql(v: str, df: int) -> str:
    """The upper tail for an even number of degrees of freedom."""
    return f"(exp(-{v} / 2) * ({' + '.join(f'({v} / 2) ** {i} / {math.factorial(i)}' for i in range(df // 2))}))"


LARGE = 1e6  # a short wild series compounds to any number: from here on measures are given to seven digits
_WILD = ("total", "annual", "vol", "sharpe", "max_drawdown")


def digits_sql(sql: str, columns=_WILD) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"CASE WHEN abs({c}) >= {LARGE} AND isfinite({c}) THEN printf('%.6e', {c})::DOUBLE ELSE {c} END AS {c}" for c in columns) + f") FROM ({sql})"


def digits(df, columns=_WILD):
    """df with large values to seven digits, which no order of multiplication changes."""
    large = lambda c: F.when((F.abs(c) >= LARGE) & (F.abs(c) < float("inf")), F.format_string("%.6e", c).cast("double")).otherwise(F.col(c))
    return df.withColumns({c: large(c) for c in columns})


def measured(df, by):
    """Rounded metrics."""
    return digits(rounded(b.metrics(df, by)))


def run_systems(spark, sf_dir, systems):
    s = quantile_spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "ry", "rx", "rm", "regime", "spread", "beta")
    return sy.net_returns(sy.run_systems(s, systems, p.SPLIT)).withColumn("period", x.mark_period("date", p.SPLIT))


@query("k11_kalman_only", systems_sql([BASELINES[3]]) + "SELECT pair, t, signal, round(net, 6) AS net FROM sysbt")
def k11(spark, sf_dir):
    """Adaptive hedge without regimes: every row counts as normal, slippage is the only cost."""
    return run_systems(spark, sf_dir, [BASELINES[3]]).select("pair", "t", "signal", r6("net").alias("net"))


@query("k12_regime_only", systems_sql([BASELINES[4]]) + "SELECT pair, t, signal, round(net, 6) AS net FROM sysbt")
def k12(spark, sf_dir):
    """Fixed hedge of the train rows with regimes by rule and stricter levels in volatile ones."""
    return run_systems(spark, sf_dir, [BASELINES[4]]).select("pair", "t", "signal", r6("net").alias("net"))


@query("k7_distance_machine", systems_sql([BASELINES[1]]) + "SELECT pair, t, signal, round(net, 6) AS net FROM sysbt")
def k7(spark, sf_dir):
    """Normalised-price distance with its own machine; hedge one to one."""
    return run_systems(spark, sf_dir, [BASELINES[1]]).select("pair", "t", "signal", r6("net").alias("net"))


_HELD = "SELECT 'buy and hold' AS system, pair, t, (ry + rx) / 2 AS net FROM spine WHERE date > DATE '{0}' UNION ALL SELECT 'market', pair, t, rm FROM spine WHERE date > DATE '{0}'".format(p.SPLIT)


@query("b13_baseline_battery", systems_sql(BASELINES) + f", seven AS (SELECT system, pair, t, net FROM sysbt WHERE period = 'oos' UNION ALL {_HELD})" + digits_sql(metric_sql("seven", "system, pair")))
def b13(spark, sf_dir):
    """Seven methods over every pair after the split: the method is a column of one job."""
    ran = run_systems(spark, sf_dir, BASELINES).filter("period = 'oos'")
    # holding needs no machine: its returns stand in the rows of the first system
    held = F.when(F.col("system") == BASELINES[0].name, F.array(*[F.struct(F.lit(n).alias("system"), r.alias("net")) for n, r in (("buy and hold", (F.col("ry") + F.col("rx")) / 2), ("market", F.col("rm")))]))
    every = ran.withColumn("v", F.explode(F.concat(F.array(F.struct("system", "net")), F.coalesce(held, F.array().cast("array<struct<system:string,net:double>>")))))
    return measured(every.select("v.system", "pair", "t", "v.net"), ["system", "pair"])


_ABLATED = systems_sql(ABLATIONS) + f", ab AS ({digits_sql(metric_sql('(SELECT * FROM sysbt WHERE period = ' + chr(39) + 'oos' + chr(39) + ')', 'system, pair'))})"


@query("b14_ablation_battery", _ABLATED + "SELECT *, (row_number() OVER (PARTITION BY pair ORDER BY delta, system))::INT AS place FROM (" + digits_sql("SELECT system, pair, total, sharpe, round(sharpe - max(sharpe) FILTER (system = 'full') OVER (PARTITION BY pair), 5) AS delta FROM ab", ("delta",)) + ")")
def b14(spark, sf_dir):
    """Nine systems, each without one component, what that does to the Sharpe ratio of the full one, and the place of the loss (1: most is lost without it)."""
    m = measured(run_systems(spark, sf_dir, ABLATIONS).filter("period = 'oos'"), ["system", "pair"])
    full = F.max(F.when(F.col("system") == "full", F.col("sharpe"))).over(Window.partitionBy("pair"))
    m = digits(m.select("system", "pair", "total", "sharpe", F.round(F.col("sharpe") - full, 5).alias("delta")), ("delta",))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy("delta", "system")))


@query("b20_attribution_parts", _ABLATED + """SELECT pair, round(max(total) FILTER (system = 'full'), 6) AS full_total, round(max(total) FILTER (system = 'full') - max(total) FILTER (system = 'no regime'), 6) AS regime_timing, round(max(total) FILTER (system = 'full') - max(total) FILTER (system = 'no kalman'), 6) AS kalman,
  round(max(total) FILTER (system = 'full') - max(total) FILTER (system = 'no least hold'), 6) AS holding FROM ab GROUP BY 1""")
def b20(spark, sf_dir):
    """What regimes, the adaptive hedge and the least holding time add: differences of totals between systems (the random leg is t3)."""
    m = measured(run_systems(spark, sf_dir, [s for s in ABLATIONS if s.name in ("full", "no regime", "no kalman", "no least hold")]).filter("period = 'oos'"), ["system", "pair"])
    of = lambda n: F.max(F.when(F.col("system") == n, F.col("total")))
    return m.groupBy("pair").agg(r6(of("full")).alias("full_total"), *[F.round(of("full") - of(n), 6).alias(a) for n, a in (("no regime", "regime_timing"), ("no kalman", "kalman"), ("no least hold", "holding"))])


AGGRESSIVE = System("aggressive", rules=R(1.0, 0.3, 1.5, 0.2, min_hold=2))


@query("b20_attribution_whole")
def b20_whole(spark, sf_dir):
    """Four alphas of every pair and their sum: regime timing, entries by z-score against random ones on tradeable rows, sizing against eager rules, adaptive hedge."""
    kinds = [*(s for s in ABLATIONS if s.name in ("full", "no regime", "no kalman", "no least hold")), AGGRESSIVE]
    ran = run_systems(spark, sf_dir, kinds).filter("period = 'oos'")
    full = ran.filter("system = 'full'").withColumn("spread_return", F.col("ry") - F.col("hedge") * F.col("rx"))
    timing = sc.entry_alpha(full, b.trades(full)).select("pair", "n_trades", F.col("alpha").alias("mean_reversion"), "random_mean", "random_sd", "p")
    of = lambda n: F.max(F.when(F.col("system") == n, F.col("total")))
    parts = {"regime_timing": "no regime", "sizing": "aggressive", "kalman": "no kalman", "holding": "no least hold"}
    sides = ran.groupBy("system", "pair").agg(x.compound("net").alias("total")).groupBy("pair").agg(of("full").alias("total"), *[(of("full") - of(n)).alias(a) for a, n in parts.items()])
    both = sides.join(timing, "pair").withColumn("sum_of_alphas", F.col("regime_timing") + F.col("mean_reversion") + F.col("sizing") + F.col("kalman"))
    return _rounded_all(both)


# walk-forward with a hedge refitted on every fold's train rows ------------------------------------------------------------

LEAST, STEP, TEST = 150, 30, 50
WALK = System("walk", z_rows=40)
_WALK = f""",
wf0 AS (SELECT s.*, f.f::INT AS fold, s.pair || '#' || f.f AS k FROM (SELECT *, max(t) OVER (PARTITION BY pair) AS last FROM spine) s JOIN range(0, 10000) f(f) ON f.f <= (s.last + 1 - {LEAST + TEST}) // {STEP} AND s.last + 1 >= {LEAST + TEST} AND s.t < {LEAST + TEST} + {STEP} * f.f),
wfc AS (SELECT k, quantile_cont(vol, 0.33) FILTER (t < {LEAST} + {STEP} * fold) AS lo, quantile_cont(vol, 0.66) FILTER (t < {LEAST} + {STEP} * fold) AS hi FROM wf0 GROUP BY 1),
wfs AS (SELECT k AS pair, pair AS base, fold, t, date, y, x, ry, rx, CASE WHEN vol IS NULL THEN 2 WHEN vol > hi THEN 0 WHEN vol > lo THEN 1 ELSE 2 END AS regime FROM wf0 JOIN wfc USING (k)),
{_kalman_sql(True, "wfk").strip().removeprefix(",").replace("FROM spine", "FROM wfs").replace("JOIN spine", "JOIN wfs").strip()},
wfh AS (SELECT k.pair, k.t, s.regime, k.e AS s, k.w AS hedge FROM wfk k JOIN wfs s USING (pair, t)),
{_z_sql("wfz", "wfh", WALK.z_rows)},
{machine_sql("wfm", "wfz", WALK.rules)},
wf4 AS (SELECT s.*, z.hedge, m.pos AS signal, lag(m.pos) OVER w AS before, CASE WHEN count(ry) OVER r >= 20 THEN stddev_samp(ry) OVER r END AS s20, stddev_samp(ry) OVER (PARTITION BY s.pair) AS sall FROM wfs s JOIN wfz z USING (pair, t) JOIN wfm m USING (pair, t) WINDOW w AS (PARTITION BY s.pair ORDER BY s.t), r AS (PARTITION BY s.pair ORDER BY s.t ROWS 19 PRECEDING)),
wf5 AS (SELECT *, before * (ry - hedge * rx) - moved * 5.0 / 1e4 - (moved > 0)::INT * (2 * 1.0 / 10000 + 0.1 * coalesce(s20, sall) * sqrt(10000 / 2e8)) AS net FROM (SELECT *, coalesce(abs(signal - before), 0) AS moved FROM wf4)),
wf AS (SELECT base AS pair, fold, t, net FROM wf5 WHERE t >= {LEAST} + {STEP} * fold)
"""


def fold_regimes(s):
    """s (pair, t, vol, ..) once for each fold that holds the row, with fold and the regime by that fold's train quantiles of volatility."""
    last = F.max("t").over(Window.partitionBy("pair"))
    s = s.withColumn("_last", last).withColumn("_most", F.floor((F.col("_last") + 1 - LEAST - TEST) / STEP).cast("int"))
    first = F.greatest(F.ceil((F.col("t") - (LEAST + TEST - 1)) / STEP), F.lit(0)).cast("int")
    s = s.withColumn("fold", F.explode(F.when(F.col("_most") >= first, F.sequence(first, F.col("_most"))))).drop("_last", "_most")
    every, early = Window.partitionBy("pair", "fold"), F.when(F.col("t") < LEAST + STEP * F.col("fold"), F.col("vol"))
    s = s.withColumn("_lo", F.percentile(early, 0.33).over(every)).withColumn("_hi", F.percentile(early, 0.66).over(every))
    v = F.col("vol")
    return s.withColumn("regime", F.when(v.isNull(), 2).when(v > F.col("_hi"), 0).when(v > F.col("_lo"), 1).otherwise(2)).drop("_lo", "_hi")


def walked(spark, sf_dir):
    """Test rows of every fold of every pair: regimes of the fold's train rows, an adaptive hedge, z-score, machine and costs of its own. Nothing behind a fold's train rows is fitted on."""
    s = fold_regimes(spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "ry", "rx", "vol")).drop("vol")
    made = sy.net_returns(sy.run_systems(s, [WALK], p.SPLIT, ("pair", "fold")), ("pair", "fold"))
    return made.filter(F.col("t") >= LEAST + STEP * F.col("fold"))


@query("b16_walk_forward_refit", _WALK + digits_sql(metric_sql("wf", "pair, fold")))
def b16(spark, sf_dir):
    """Expanding walk in which every fold is fitted on its own train rows only and runs its own filter; all folds of all pairs in one job."""
    return measured(walked(spark, sf_dir), ["pair", "fold"])


_TREND = """SELECT pair, count(*)::BIGINT AS folds, CASE WHEN count(*) >= 4 AND stddev_pop(rs) > 0 THEN round(corr(fold, rs), 6) END AS sharpe_trend, CASE WHEN count(*) >= 4 AND stddev_pop(rt) > 0 THEN round(corr(fold, rt), 6) END AS return_trend,
  round(avg((total > 0)::INT), 6) AS consistency, round(avg(total), 8) AS mean_return, round(avg(sharpe), 8) AS mean_sharpe, CASE WHEN round(avg(total), 8) > 0 AND avg((total > 0)::INT) >= 0.6 AND round(avg(sharpe), 8) > 0.3 THEN 'pass' WHEN round(avg(total), 8) > 0 AND avg((total > 0)::INT) >= 0.5 THEN 'marginal' ELSE 'fail' END AS verdict
  FROM (SELECT *, rank() OVER (PARTITION BY pair ORDER BY sharpe) + (count(*) OVER (PARTITION BY pair, sharpe) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY pair ORDER BY total) + (count(*) OVER (PARTITION BY pair, total) - 1) / 2.0 AS rt FROM wfx) GROUP BY 1"""


@query("b17_refit_trend", _WALK + f", wfx AS ({digits_sql(metric_sql('wf', 'pair, fold'))})" + digits_sql(_TREND, ("mean_return", "mean_sharpe")))
def b17(spark, sf_dir):
    """Rank correlation of a fold's Sharpe ratio and return with its number, consistency and verdict, over the refitted walk."""
    v = b16(spark, sf_dir)
    rank = lambda c: F.rank().over(Window.partitionBy("pair").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("pair", c)) - 1) / 2.0
    v = v.withColumn("rs", rank("sharpe")).withColumn("rt", rank("total"))
    trend = lambda c: F.when((F.count(F.lit(1)) >= 4) & (F.stddev_pop(c) > 0), r6(F.try_divide(F.covar_pop("fold", c), F.stddev_pop("fold") * F.stddev_pop(c))))
    share = F.avg((F.col("total") > 0).cast("int"))
    got = v.groupBy("pair").agg(F.count(F.lit(1)).alias("folds"), trend("rs").alias("sharpe_trend"), trend("rt").alias("return_trend"), r6(share).alias("consistency"), F.round(F.avg("total"), 8).alias("mean_return"), F.round(F.avg("sharpe"), 8).alias("mean_sharpe"), share.alias("_c"))
    good = (F.col("mean_return") > 0) & (F.col("_c") >= 0.6) & (F.col("mean_sharpe") > 0.3)
    got = got.withColumn("verdict", F.when(good, "pass").when((F.col("mean_return") > 0) & (F.col("_c") >= 0.5), "marginal").otherwise("fail")).drop("_c")
    return digits(got, ("mean_return", "mean_sharpe"))


# regimes by source --------------------------------------------------------------------------------------------------------

_SOURCES = f""",
rg0 AS (SELECT s.*, hi, lo, m / max(m) OVER (PARTITION BY s.pair ORDER BY t ROWS 59 PRECEDING) - 1 AS dd FROM spine s JOIN (SELECT pair, quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.66) AS hi FROM spine WHERE date <= DATE '{p.SPLIT}' GROUP BY 1) USING (pair)),
rg AS (SELECT v.source, pair || '#' || v.source AS k, g.* EXCLUDE (regime), CASE v.source WHEN 'simple' THEN regime WHEN 'none' THEN 2
    WHEN 'quantile' THEN CASE WHEN vol IS NULL THEN 2 WHEN vol > hi THEN 0 WHEN vol > lo THEN 1 ELSE 2 END
    ELSE CASE WHEN coalesce(vol > 0.35, false) OR coalesce(dd < -0.20, false) THEN 0 WHEN coalesce(vol > 0.22, false) OR coalesce(dd < -0.10, false) THEN 1 ELSE 2 END END AS regime
  FROM rg0 g CROSS JOIN (VALUES ('simple'), ('none'), ('quantile'), ('rule')) v(source)),
{machine_sql("rgm", "rg", R(), "k")},
rg1 AS (SELECT s.*, m.pos AS signal, lag(m.pos) OVER w AS before, CASE WHEN count(ry) OVER r >= 20 THEN stddev_samp(ry) OVER r END AS s20, stddev_samp(ry) OVER (PARTITION BY s.k) AS sall FROM rg s JOIN rgm m ON m.k = s.k AND m.t = s.t WINDOW w AS (PARTITION BY s.k ORDER BY s.t), r AS (PARTITION BY s.k ORDER BY s.t ROWS 19 PRECEDING)),
rgb AS (SELECT *, before * (ry - beta * rx) - moved * 5.0 / 1e4 - (moved > 0)::INT * (2 * 1.0 / 10000 + 0.1 * coalesce(s20, sall) * sqrt(10000 / 2e8)) AS net FROM (SELECT *, coalesce(abs(signal - before), 0) AS moved FROM rg1))
"""


def by_regime_source(spark, sf_dir):
    s = spine(spark, sf_dir)
    q = Window.partitionBy("pair")
    early = F.when(F.col("date") <= F.lit(p.SPLIT).cast("date"), F.col("vol"))
    s = s.withColumn("lo", F.percentile(early, 0.33).over(q)).withColumn("hi", F.percentile(early, 0.66).over(q))
    s = s.withColumn("dd", F.col("m") / F.max("m").over(x.pair_window().rowsBetween(-59, 0)) - 1)
    quantile = F.when(F.col("vol").isNull(), 2).when(F.col("vol") > F.col("hi"), 0).when(F.col("vol") > F.col("lo"), 1).otherwise(2)
    kinds = {"simple": F.col("regime"), "none": F.lit(2), "quantile": quantile, "rule": x.regime_rule("vol", "dd")}
    s = s.withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("source"), c.cast("int").alias("regime")) for n, c in kinds.items()])))
    return s.select("pair", "date", "t", "ry", "rx", "vol", F.col("beta").alias("hedge"), "z", F.col("v.source").alias("source"), F.col("v.regime").alias("regime"))


@query("b21_regime_value", _SOURCES + digits_sql(metric_sql(f"(SELECT * FROM rgb WHERE date > DATE '{p.SPLIT}')", "source, pair")))
def b21(spark, sf_dir):
    """What regimes of four sources are worth to the same machine: the source is a key."""
    made = sy.net_returns(folds.signals(by_regime_source(spark, sf_dir), keys=["source", "pair"]).withColumn("costs", F.lit("all")), ("source", "pair"))
    return measured(made.filter(F.col("date") > F.lit(p.SPLIT).cast("date")), ["source", "pair"])


_RUNS = """, rr AS (SELECT source, pair, t, regime, lag(regime) OVER (PARTITION BY source, pair ORDER BY t) AS was FROM rg)
SELECT source, pair, count(*)::BIGINT AS n, sum((was <> regime)::INT)::BIGINT AS changes, round(52.0 * sum((was <> regime)::INT) / count(*), 4) AS changes_a_year, round(count(*) / (1.0 + sum((was <> regime)::INT)), 4) AS mean_run,
  round(avg((regime = 0)::INT), 6) AS crisis, round(avg((regime = 1)::INT), 6) AS volatile, round(avg((regime = 2)::INT), 6) AS normal FROM rr GROUP BY 1, 2"""


@query("m12_regime_comparison", _SOURCES + _RUNS)
def m12(spark, sf_dir):
    """Sources of regimes side by side: changes, how long a regime lasts, and shares of each."""
    s = by_regime_source(spark, sf_dir)
    s = s.withColumn("was", F.lag("regime").over(x.pair_window("source", "pair")))
    n, changes = F.count(F.lit(1)), F.count_if(F.col("was") != F.col("regime"))
    share = lambda k, name: r6(F.avg((F.col("regime") == k).cast("int"))).alias(name)
    return s.groupBy("source", "pair").agg(n.alias("n"), changes.alias("changes"), F.round(52.0 * changes / n, 4).alias("changes_a_year"), F.round(n / (1.0 + changes), 4).alias("mean_run"), share(0, "crisis"), share(1, "volatile"), share(2, "normal"))


# health-gated backtest ----------------------------------------------------------------------------------------------------

_HEALTHY = HEALTH + QUANTILES + f""", {signal_sql(source="qspine")},
hh AS (SELECT s.*, g.pos AS signal, coalesce(last_value(checks_passed >= 2 IGNORE NULLS) OVER w, true) AS healthy, coalesce(last_value(h.score IGNORE NULLS) OVER w, 1.0) AS hscore
  FROM spine s JOIN sig g ON g.pair = s.pair AND g.t = s.t LEFT JOIN health h ON h.pair = s.pair AND h.t = s.t WINDOW w AS (PARTITION BY s.pair ORDER BY s.t ROWS UNBOUNDED PRECEDING)),
hgate(pair, t, sick, pos) AS (SELECT DISTINCT pair, -1, 0, 0 FROM hh UNION ALL SELECT h.pair, h.t, CASE WHEN healthy THEN 0 ELSE sick + 1 END, CASE WHEN healthy THEN h.signal WHEN g.pos = 0 OR sick + 1 > 5 THEN 0 ELSE g.pos END FROM hgate g JOIN hh h ON h.pair = g.pair AND h.t = g.t + 1),
hg AS (SELECT h.*, g.pos AS gated FROM hh h JOIN hgate g ON g.pair = h.pair AND g.t = h.t)
"""


def healthy_signals(spark, sf_dir):
    """The spine with signal, its pair's rolling health as of each row (healthy before any is known) and the gated signal."""
    s = folds.signals(quantile_spine(spark, sf_dir))
    h = _health(spark, sf_dir).select("pair", "t", "healthy", "health_score")
    s = s.join(h, ["pair", "t"], "left").withColumn("healthy", x.ffill("healthy", x.pair_window(), True)).withColumn("health_score", x.ffill("health_score", x.pair_window(), 1.0))
    return folds.health_gate(s)


@query("k8_health_gate_rolling", _HEALTHY + "SELECT pair, t, healthy, gated FROM hg")
def k8(spark, sf_dir):
    return healthy_signals(spark, sf_dir).select("pair", "t", "healthy", "gated")


@query("k9_health_sizing_rolling", _HEALTHY + "SELECT pair, t, signal * (CASE WHEN h < 0.4 THEN 0.0 WHEN h < 0.6 THEN 0.5 WHEN h < 0.8 THEN 0.75 ELSE 1.0 END)::DOUBLE AS sized FROM (SELECT *, round(hscore, 6) AS h FROM hg)")
def k9(spark, sf_dir):
    return healthy_signals(spark, sf_dir).select("pair", "t", (F.col("signal") * x.size_by_health(F.round("health_score", 6))).alias("sized"))


_FILTERED = HEALTH + systems_sql([System("full")]) + """, fh AS (SELECT s.pair, s.t, s.date, s.ry, s.rx, a.hedge, a.signal AS raw, coalesce(last_value(checks_passed >= 2 IGNORE NULLS) OVER w, true) AS healthy
  FROM spine s JOIN arms a ON a.pair = s.pair AND a.t = s.t LEFT JOIN health h ON h.pair = s.pair AND h.t = s.t WINDOW w AS (PARTITION BY s.pair ORDER BY s.t ROWS UNBOUNDED PRECEDING)),
fgate(pair, t, sick, pos) AS (SELECT DISTINCT pair, -1, 0, 0 FROM fh UNION ALL SELECT h.pair, h.t, CASE WHEN healthy THEN 0 ELSE sick + 1 END, CASE WHEN healthy THEN h.raw WHEN g.pos = 0 OR sick + 1 > 5 THEN 0 ELSE g.pos END FROM fgate g JOIN fh h ON h.pair = g.pair AND h.t = g.t + 1),
fl AS (SELECT h.pair, h.t, h.ry, h.rx, hedge, k.kind, healthy, raw, CASE WHEN k.kind = 'filtered' THEN g.pos ELSE raw END AS signal FROM fh h JOIN fgate g ON g.pair = h.pair AND g.t = h.t CROSS JOIN (VALUES ('filtered'), ('unfiltered')) k(kind)),
fl1 AS (SELECT *, lag(signal) OVER w AS before, CASE WHEN count(ry) OVER r >= 20 THEN stddev_samp(ry) OVER r END AS s20, stddev_samp(ry) OVER (PARTITION BY kind, pair) AS sall FROM fl WINDOW w AS (PARTITION BY kind, pair ORDER BY t), r AS (PARTITION BY kind, pair ORDER BY t ROWS 19 PRECEDING)),
flb AS (SELECT *, before * (ry - hedge * rx) - moved * 5.0 / 1e4 - (moved > 0)::INT * (2 * 1.0 / 10000 + 0.1 * coalesce(s20, sall) * sqrt(10000 / 2e8)) AS net FROM (SELECT *, coalesce(abs(signal - before), 0) AS moved FROM fl1))
"""


def gated_system(spark, sf_dir):
    """The full system's rows (adaptive hedge) with its pair's rolling health as of each row and the gated signal; written once, as much derives from it."""
    s = run_systems(spark, sf_dir, [System("full")]).select("pair", "date", "t", "ry", "rx", "z", "hedge", "signal")
    h = _health(spark, sf_dir).select("pair", "t", "healthy")
    s = s.join(h, ["pair", "t"], "left").withColumn("healthy", x.ffill("healthy", x.pair_window(), True))
    return written(folds.health_gate(s), "gated")


@query("b19_filter_comparison", _FILTERED + f""", fm AS ({digits_sql(metric_sql("flb", "kind, pair"))}), fs AS (SELECT pair, round(avg(healthy::INT), 6) AS healthy, round(count(*) FILTER (raw <> 0 AND signal = 0) / greatest(1, count(*) FILTER (raw <> 0)), 6) AS blocked FROM flb WHERE kind = 'filtered' GROUP BY 1)
SELECT pair, healthy, blocked, a.total AS filtered_total, u.total AS unfiltered_total, a.sharpe AS filtered_sharpe, u.sharpe AS unfiltered_sharpe, a.max_drawdown AS filtered_drawdown, u.max_drawdown AS unfiltered_drawdown
FROM fs JOIN (SELECT * FROM fm WHERE kind = 'filtered') a USING (pair) JOIN (SELECT * FROM fm WHERE kind = 'unfiltered') u USING (pair)""")
def b19(spark, sf_dir):
    """Backtest of the adaptive system with and without the health gate, side by side, with the share of healthy rows and of blocked positions."""
    s = gated_system(spark, sf_dir)
    both = s.withColumn("v", F.explode(F.array(F.struct(F.lit("filtered").alias("kind"), F.col("gated").alias("s")), F.struct(F.lit("unfiltered").alias("kind"), F.col("signal").alias("s")))))
    both = both.select("pair", "t", "ry", "rx", "hedge", F.col("v.kind").alias("kind"), F.col("v.s").alias("signal"), F.lit("all").alias("costs"))
    m = measured(sy.net_returns(both, ("kind", "pair")), ["kind", "pair"])
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    side = m.groupBy("pair").agg(*[of(k, c).alias(f"{k}_{n}") for c, n in (("total", "total"), ("sharpe", "sharpe"), ("max_drawdown", "drawdown")) for k in ("filtered", "unfiltered")])
    shares = s.groupBy("pair").agg(r6(F.avg(F.col("healthy").cast("int"))).alias("healthy"), r6(F.count_if((F.col("signal") != 0) & (F.col("gated") == 0)) / F.greatest(F.lit(1), F.count_if(F.col("signal") != 0))).alias("blocked"))
    return shares.join(side, "pair")


# stability and rotation ---------------------------------------------------------------------------------------------------

_STABLE = HEALTH + f""", st AS (SELECT pair, count(*)::BIGINT AS n, round(100.0 * avg((eg_p < 0.05)::INT), 4) AS cointegrated_pct, round(avg(hurst), 6) AS mean_hurst, round(100.0 * avg((hurst < 0.5)::INT), 4) AS reverting_pct, round(100.0 * avg((df_p < 0.05)::INT), 4) AS stationary_pct FROM he WHERE date > DATE '{p.SPLIT}' AND t >= 126 GROUP BY 1),
hl2 AS (SELECT pair, round(avg(half_life), 4) AS mean_half_life, round(stddev_samp(b), 6) AS hedge_sd FROM dg WHERE date > DATE '{p.SPLIT}' AND t >= 126 AND t % 5 = 0 GROUP BY 1),
stab AS (SELECT *, (cointegrated_pct > 50)::INT + (mean_hurst < 0.5)::INT + (mean_half_life < 25)::INT + coalesce(hedge_sd < 0.15, false)::INT + (stationary_pct > 50)::INT AS met FROM st JOIN hl2 USING (pair))
"""


def stability(spark, sf_dir):
    from covary.operators import diagnostics as d

    s = spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "spread")
    after = (F.col("date") > F.lit(p.SPLIT).cast("date")) & (F.col("t") >= 126) & (F.col("t") % 5 == 0)
    rolled = d.rolling_pairs(s).filter(after).join(d.rolling_hurst(s), ["pair", "t"], "left")
    pct = lambda c: F.round(100.0 * F.avg(c.cast("int")), 4)
    got = rolled.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), pct(F.col("eg_p") < 0.05).alias("cointegrated_pct"), r6(F.avg("hurst")).alias("mean_hurst"), pct(F.col("hurst") < 0.5).alias("reverting_pct"), pct(F.col("df_p") < 0.05).alias("stationary_pct"),
        F.round(F.avg("half_life"), 4).alias("mean_half_life"), r6(F.stddev_samp("hedge")).alias("hedge_sd"),
    )
    tests = (F.col("cointegrated_pct") > 50, F.col("mean_hurst") < 0.5, F.col("mean_half_life") < 25, F.coalesce(F.col("hedge_sd") < 0.15, F.lit(False)), F.col("stationary_pct") > 50)
    return got.withColumn("met", sum((c.cast("int") for c in tests), F.lit(0)))


@query("r8_stability", _STABLE + "SELECT *, CASE WHEN met >= 4 THEN 'stable' WHEN met >= 2 THEN 'partly stable' ELSE 'unstable' END AS verdict FROM stab")
def r8(spark, sf_dir):
    """Each pair's diagnostics after the split, five criteria and a verdict."""
    return stability(spark, sf_dir).withColumn("verdict", F.when(F.col("met") >= 4, "stable").when(F.col("met") >= 2, "partly stable").otherwise("unstable"))


@query("r9_stability_ranking", _STABLE + "SELECT pair, score, (row_number() OVER (ORDER BY score DESC, pair))::INT AS place FROM (SELECT pair, round(0.3 * cointegrated_pct / 100 + 0.3 * (1 - least(greatest(mean_hurst, 0), 1)) + 0.2 * reverting_pct / 100 + 0.2 * stationary_pct / 100, 5) AS score FROM stab)")
def r9(spark, sf_dir):
    """Pairs by a weighted score of their stability, over every pair; a row per pair meets in the ranking window."""
    score = 0.3 * F.col("cointegrated_pct") / 100 + 0.3 * (1 - x.clip("mean_hurst", 0.0, 1.0)) + 0.2 * F.col("reverting_pct") / 100 + 0.2 * F.col("stationary_pct") / 100
    return stability(spark, sf_dir).select("pair", F.round(score, 5).alias("score")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "pair")))


EVERY = 60  # rows between rotations
_ROTATED = HEALTH + f""", dates AS (SELECT DISTINCT t FROM health WHERE t % {EVERY} = 0),
strict AS (SELECT t, pair, row_number() OVER (PARTITION BY t ORDER BY round(score, 4) DESC, pair) AS k FROM health WHERE t % {EVERY} = 0 AND checks_passed >= 2 AND score >= 0.5),
loose AS (SELECT t, pair, row_number() OVER (PARTITION BY t ORDER BY round(score, 4) DESC, pair) AS k FROM health WHERE t % {EVERY} = 0 AND score >= 0.3),
chosen AS (SELECT d.t, coalesce(a.l, b.l) AS own FROM dates d LEFT JOIN (SELECT t, list(pair ORDER BY k) FILTER (k <= 5) AS l FROM strict GROUP BY 1) a USING (t) LEFT JOIN (SELECT t, list(pair ORDER BY k) FILTER (k <= 5) AS l FROM loose GROUP BY 1) b USING (t)),
state AS (SELECT t, coalesce(last_value(own IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), []) AS active FROM chosen),
rot AS (SELECT t, active, coalesce(lag(active) OVER (ORDER BY t), []) AS was FROM state)
"""


@query("d10_rotation_log", _ROTATED + "SELECT t, active, list_sort(list_filter(active, lambda v: NOT list_contains(was, v))) AS rotated_in, list_sort(list_filter(was, lambda v: NOT list_contains(active, v))) AS rotated_out, least(0.2, 1.0 / greatest(1, len(active)))::DOUBLE AS size FROM rot")
def d10(spark, sf_dir):
    """Every rotation: the best five healthy pairs, or by a lower bar where none is healthy, or those kept; pairs that come and go, and the size of each. The state is a row per rotation date."""
    h = _health(spark, sf_dir).filter(F.col("t") % EVERY == 0).withColumn("s", F.round("health_score", 4))

    def best(rows, name):
        k = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s"), "pair"))
        top = rows.withColumn("k", k).filter("k <= 5")
        return top.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pair"))), lambda v: v["pair"]).alias(name))

    strict, loose = best(h.filter("healthy and health_score >= 0.5"), "strict"), best(h.filter("health_score >= 0.3"), "loose")
    own = h.select("t").distinct().join(strict, "t", "left").join(loose, "t", "left").select("t", F.coalesce("strict", "loose").alias("own"))
    order, none = Window.orderBy("t"), F.array().cast("array<string>")
    state = own.select("t", F.coalesce(F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), none).alias("active"))
    state = state.withColumn("was", F.coalesce(F.lag("active").over(order), none))
    return state.select("t", "active", F.array_sort(F.array_except("active", "was")).alias("rotated_in"), F.array_sort(F.array_except("was", "active")).alias("rotated_out"), F.least(F.lit(0.2), 1.0 / F.greatest(F.lit(1), F.size("active"))).alias("size"))


@query("d11_rotation_due", f"SELECT pair, t, (t // {EVERY}) * {EVERY} AS last_t, (date - max(date) FILTER (t % {EVERY} = 0) OVER w)::INT AS days, (date - max(date) FILTER (t % {EVERY} = 0) OVER w) >= 30 AS due FROM spine WINDOW w AS (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING)")
def d11(spark, sf_dir):
    """For every date of a pair, the days since its last rotation and whether one is due: as of that date, never of today."""
    last = F.last(F.when(F.col("t") % EVERY == 0, F.col("date")), ignorenulls=True).over(x.pair_window().rowsBetween(Window.unboundedPreceding, 0))
    s = spine(spark, sf_dir).withColumn("days", F.datediff("date", last))
    return s.select("pair", "t", (F.expr(f"t div {EVERY}") * EVERY).cast("int").alias("last_t"), "days", (F.col("days") >= 30).alias("due"))


# legacy system ------------------------------------------------------------------------------------------------------------


TRAINED = 252  # rows on which the legacy system's regimes are fitted


def legacy_panel(spark, sf_dir):
    """What the legacy machine reads: spread and hedge of the adaptive filter, regimes by quantiles of the first rows, three time frames, trend, correlation and the pair's half-life."""
    w, q = x.pair_window(), Window.partitionBy("pair")
    s = spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "ry", "rx", "rm", "vol")
    early, v = F.when(F.col("t") < TRAINED, F.col("vol")), F.col("vol")
    s = s.withColumn("_lo", F.percentile(early, 0.33).over(q)).withColumn("_hi", F.percentile(early, 0.66).over(q))
    s = s.withColumn("regime", F.when(v.isNull(), 2).when(v > F.col("_hi"), 0).when(v > F.col("_lo"), 1).otherwise(2)).drop("_lo", "_hi")
    s = folds.kalman(s).withColumnRenamed("innovation", "spread").drop("innovation_sd")
    for name, n in (("z", 60), ("z30", 30), ("z60", 60), ("z90", 90)):
        s = s.withColumn(name, F.round(x.zscore("spread", w, n), 6))
    lagged = F.when(F.col("t") < 500, F.lag("spread").over(w))
    s = s.withColumn("l", lagged).withColumn("d", F.when(F.col("t") < 500, F.col("spread") - F.col("l")))
    theta = F.regr_slope("d", "l").over(q)
    half = F.when(theta < 0, F.least(F.greatest(-0.6931471805599453 / theta, F.lit(5.0)), F.lit(60.0))).otherwise(60.0)
    return s.withColumn("trend", x.rolling(F.avg, "z", w, 5, before=True)).withColumn("corr", x.rolling(F.corr, ["y", "x"], w, 30)).withColumn("half_life", F.round(half, 6)).drop("l", "d")


_CONFIRMED = f""",
lcut AS (SELECT pair, quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.66) AS hi FROM spine WHERE t < {TRAINED} GROUP BY 1),
lspine AS (SELECT s.* REPLACE (CASE WHEN vol IS NULL THEN 2 WHEN vol > hi THEN 0 WHEN vol > lo THEN 1 ELSE 2 END AS regime) FROM spine s LEFT JOIN lcut USING (pair))""" + _kalman_sql(True, "lk").replace("FROM spine", "FROM lspine").replace("JOIN spine", "JOIN lspine") + """,
lks AS (SELECT k.pair, k.t, s.regime, k.w AS hedge, k.e AS s, s.y, s.x FROM lk k JOIN lspine s USING (pair, t)),
""" + ",\n".join(_z_sql(f"lz{n}", "lks", n) for n in (30, 60, 90)) + """,
lhalf AS (SELECT pair, round(CASE WHEN theta < 0 THEN least(greatest(-ln(2) / theta, 5.0), 60.0) ELSE 60.0 END, 6) AS half FROM (SELECT pair, regr_slope(s - before, before) AS theta FROM (SELECT pair, t, s, lag(s) OVER (PARTITION BY pair ORDER BY t) AS before FROM lks) WHERE t < 500 GROUP BY 1)),
lin AS (SELECT k.pair, k.t, k.regime, c.z, a.z AS z30, b.z AS z90, CASE WHEN k.regime = 1 THEN 2.5 ELSE 2.0 END AS lim, CASE WHEN k.regime = 1 THEN 0.3 ELSE 0.5 END AS near, floor(half * 3)::INT AS most, CASE WHEN count(c.z) OVER w5 = 5 THEN avg(c.z) OVER w5 END AS trend, CASE WHEN count(*) OVER w30 = 30 THEN corr(k.y, k.x) OVER w30 END AS legs
  FROM lks k JOIN lz30 a USING (pair, t) JOIN lz60 c USING (pair, t) JOIN lz90 b USING (pair, t) JOIN lhalf USING (pair) WINDOW w5 AS (PARTITION BY k.pair ORDER BY k.t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w30 AS (PARTITION BY k.pair ORDER BY k.t ROWS 29 PRECEDING)),
lsee AS (SELECT *, CASE WHEN z30 > lim AND z > lim AND z90 > 0.8 * lim AND (t < 5 OR coalesce(z > trend, false)) THEN -1 WHEN -z30 > lim AND -z > lim AND -z90 > 0.8 * lim AND (t < 5 OR coalesce(z < trend, false)) THEN 1 ELSE 0 END AS enter FROM lin)"""


def confirmed_sql(name: str, min_hold: int = 3, min_corr: float = 0.5) -> str:
    """The machine with several confirmations, as a recursive walk: name(pair, t, pos, since, seen)."""
    return f"""{name}(pair, t, pos, since, seen) AS (SELECT DISTINCT pair, -1, 0, 0, 0.0::DOUBLE FROM lsee
  UNION ALL SELECT s.pair, s.t, CASE WHEN s.z IS NULL THEN g.pos WHEN coalesce(s.legs < {min_corr}, false) OR s.regime = 0 THEN 0 WHEN g.pos = 0 THEN s.enter
    WHEN -g.pos * s.z > 1.5 * s.lim OR s.t - g.since > s.most OR (s.t - g.since >= {min_hold} AND (coalesce(s.near > abs(s.z30), false) OR s.near > abs(s.z) OR (s.regime = 1 AND abs(g.seen) < 2.5))) THEN 0 ELSE g.pos END,
    CASE WHEN g.pos = 0 THEN s.t ELSE g.since END, CASE WHEN g.pos = 0 THEN coalesce(s.z, 0) ELSE g.seen END FROM {name} g JOIN lsee s ON s.pair = g.pair AND s.t = g.t + 1)"""


@query("k6_legacy_signals", _CONFIRMED + ", " + confirmed_sql("lmach") + " SELECT pair, t, pos AS signal FROM lmach WHERE t >= 0")
def k6(spark, sf_dir):
    """Positions of the machine with several confirmations."""
    return sy.legacy_signals(legacy_panel(spark, sf_dir)).select("pair", "t", "signal")


def legacy_monitor(df, window: int = 60, step: int = 20):
    """(pair, t, p, state) at every step-th row with a full window: BROKEN between 5 and 10 per cent, WARNING above, else HEALTHY."""
    from covary.operators import diagnostics as d

    got = d.rolling_pairs(df, window).filter((F.col("t") % step == 0) & (F.col("t") >= window))
    state = F.when(F.col("eg_p") > 0.10, "WARNING").when(F.col("eg_p") > 0.05, "BROKEN").otherwise("HEALTHY")
    return got.select("pair", "t", F.round("eg_p", 4).alias("p"), state.alias("state"))


_LEGACY = f""", lw AS (SELECT pair, t, y, x, lag(y) OVER o AS y1, lag(x) OVER o AS x1, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM spine WINDOW o AS (PARTITION BY pair ORDER BY t), w AS (PARTITION BY pair ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
le AS (SELECT o.pair, o.t, sum((i.y1 - o.a - o.b * i.x1) ^ 2) AS uu, sum((i.y1 - o.a - o.b * i.x1) * ((i.y - i.y1) - o.b * (i.x - i.x1))) AS ud, sum(((i.y - i.y1) - o.b * (i.x - i.x1)) ^ 2) AS dd
  FROM lw o JOIN lw i ON i.pair = o.pair AND i.t BETWEEN o.t - 59 AND o.t - 1 WHERE o.t >= 60 AND o.t % 20 = 0 GROUP BY 1, 2),
lt AS (SELECT pair, t, round(ud / uu / sqrt((dd - ud * ud / uu) / 58 / uu), 6) AS tau FROM le), lp AS (SELECT pair, t, {p_sql('tau', 2)} AS p FROM lt),
lstate AS (SELECT pair, t, round(p, 4) AS p, CASE WHEN p > 0.10 THEN 'WARNING' WHEN p > 0.05 THEN 'BROKEN' ELSE 'HEALTHY' END AS state FROM lp)"""


@query("k10_legacy_monitor", _LEGACY + "SELECT * FROM lstate")
def k10(spark, sf_dir):
    return legacy_monitor(spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "spread"))


_LEGACY_TESTED = _CONFIRMED + ", " + confirmed_sql("lmach") + ", " + confirmed_sql("lfree", 0, 0.0) + _LEGACY + f""",
lb0 AS (SELECT s.pair, s.t, s.regime, s.ry - k.hedge * s.rx AS sr, f.pos AS free, m.pos, coalesce(last_value(e.state IGNORE NULLS) OVER (PARTITION BY s.pair ORDER BY s.t ROWS UNBOUNDED PRECEDING), 'HEALTHY') AS state,
  CASE WHEN z.z IS NOT NULL THEN least(greatest((least(greatest((abs(z.z) - 2) / 2, 0.0), 0.5) + 1) * least(greatest(1 - (coalesce(s.vol, 0.15) - 0.15) / 0.15, 0.5), 1.0), 0.5), 1.5) END AS size
  FROM lspine s JOIN lks k USING (pair, t) JOIN lz60 z USING (pair, t) JOIN lmach m USING (pair, t) JOIN lfree f USING (pair, t) LEFT JOIN lstate e USING (pair, t)),
lb1 AS (SELECT *, CASE WHEN state = 'BROKEN' THEN 0 ELSE pos END AS signal FROM lb0),
lb2 AS (SELECT *, lag(signal) OVER o * coalesce(lag(size) OVER o, 1.0) * sr AS sized, lag(free) OVER o * sr AS plain FROM lb1 WINDOW o AS (PARTITION BY pair ORDER BY t)),
lb3 AS (SELECT 'legacy' AS system, pair, t, sized AS net FROM lb2 UNION ALL SELECT 'free', pair, t, plain FROM lb2),
lb4 AS ({digits_sql(metric_sql('lb3', 'system, pair'))}),
ldays AS (SELECT pair, {', '.join(f'count(*) FILTER (regime = {k}) AS {n}_days' for k, n in x.REGIMES.items())}, count(*) FILTER (state = 'BROKEN') AS broken_days, round(1 - count(*) FILTER (signal <> 0) / greatest(1, count(*) FILTER (free <> 0)), 6) AS filtered FROM lb2 GROUP BY 1)
SELECT * FROM lb4 JOIN ldays USING (pair)"""


@query("b23_legacy_backtest", _LEGACY_TESTED)
def b23(spark, sf_dir):
    """The legacy system and, beside it, the machine without least hold and correlation floor: adaptive hedge, monitor that forces flat, sizing by z and volatility, no costs; days by regime and state."""
    s = written(legacy_panel(spark, sf_dir), "legacy")
    states = legacy_monitor(s.select("pair", "date", "t", "y", "x", "spread")).select("pair", "t", "state")
    s = sy.legacy_signals(s)
    s = sy.legacy_signals(s, min_hold=0, min_corr=0.0, name="free")
    s = s.join(states, ["pair", "t"], "left").withColumn("state", x.ffill("state", x.pair_window(), "HEALTHY"))
    s = s.withColumn("signal", F.when(F.col("state") == "BROKEN", 0).otherwise(F.col("signal")))
    size = x.position_size("z", F.coalesce("vol", F.lit(0.15)))
    sr = F.col("ry") - F.col("hedge") * F.col("rx")
    w = x.pair_window()
    s = s.withColumn("sized", F.lag("signal").over(w) * F.coalesce(F.lag(size).over(w), F.lit(1.0)) * sr).withColumn("plain", F.lag("free").over(w) * sr)
    m = b.metrics(s.withColumn("v", F.explode(F.array(F.struct(F.lit("legacy").alias("system"), F.col("sized").alias("net")), F.struct(F.lit("free").alias("system"), F.col("plain").alias("net"))))).select("pair", "t", "v.*"), ["system", "pair"])
    days = s.groupBy("pair").agg(*[F.count_if(F.col("regime") == k).alias(f"{n}_days") for k, n in x.REGIMES.items()], F.count_if(F.col("state") == "BROKEN").alias("broken_days"), r6(1 - F.count_if(F.col("signal") != 0) / F.greatest(F.lit(1), F.count_if(F.col("free") != 0))).alias("filtered"))
    return digits(rounded(m)).join(days, "pair")


# significance -------------------------------------------------------------------------------------------------------------


def _full(spark, sf_dir):
    s = run_systems(spark, sf_dir, [System("full")]).filter("period = 'oos'")
    return s.withColumn("spread_return", F.col("ry") - F.col("hedge") * F.col("rx"))


def _rounded_all(df, d=6):
    return df.select(*[F.round(c, d).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("t1_bootstrap_sharpe")
def t1(spark, sf_dir):
    """Resampled Sharpe ratio of the full system after the split, 10 000 draws: point, error and interval."""
    return _rounded_all(sy.bootstrap(_full(spark, sf_dir), block=1).filter("measure = 'sharpe'").drop("measure"))


@query("t2_bootstrap_measures")
def t2(spark, sf_dir):
    """Five measures resampled 10 000 times, the Sharpe ratio in circular blocks of five rows: bias, error and interval."""
    return _rounded_all(sy.bootstrap(_full(spark, sf_dir)))


@query("t3_random_schedules")
def t3(spark, sf_dir):
    """Is it the timing? The full system against 10 000 random schedules of as many trades."""
    s = _full(spark, sf_dir)
    return _rounded_all(sc.random_schedules(s, b.trades(s)))


@query("t4_paired_sharpe")
def t4(spark, sf_dir):
    """Difference of Sharpe ratios to the market's on the same resampled rows."""
    return _rounded_all(sy.paired_bootstrap(_full(spark, sf_dir), "net", "rm")).withColumn("effect", x.cohens_band("cohens_d"))


@query("t12_survivors")
def t12(spark, sf_dir):
    """All pairs' paired tests with three corrections for their number; a row per pair meets in the windows."""
    return corrected(t4(spark, sf_dir))


def corrected(tests):
    """A table (pair, diff, p) with the p-values of three corrections and what passes at 5 per cent."""
    t = tests.select("pair", "diff", "p").withColumn("k", F.row_number().over(Window.orderBy("p", "pair"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    up, back = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    one = F.lit(1.0)
    return t.select(
        "pair", "diff", "p", F.least(one, F.min(F.col("p") * F.col("m") / F.col("k")).over(back)).alias("bh"), F.least(one, F.col("p") * F.col("m")).alias("bonferroni"),
        F.least(one, F.max(F.col("p") * (F.col("m") - F.col("k") + 1)).over(up)).alias("holm"),
    ).withColumns({f"{c}_pass": F.col(c) <= 0.05 for c in ("bh", "bonferroni", "holm")})


@query("t5_diebold_mariano_p", systems_sql([System("full")]) + f""", dm AS (SELECT pair, count(*) AS n, avg(d) / sqrt(greatest(var_samp(d) / count(*), 1e-12)) AS stat FROM (SELECT pair, net * net - rm * rm AS d FROM sysbt WHERE period = 'oos' AND net IS NOT NULL AND rm IS NOT NULL) GROUP BY 1),
dp AS (SELECT *, 2 * (1 - {t_cdf_sql('abs(stat)', '(n - 1)')}) AS p FROM dm)
SELECT pair, n, round(stat, 6) AS stat, round(p, 6) AS p, CASE WHEN p >= 0.05 THEN 'no difference' WHEN stat < 0 THEN 'less variable' ELSE 'more variable' END AS conclusion FROM dp""")
def t5(spark, sf_dir):
    """Squared returns of the system and the market: statistic and two-sided p of Student's t."""
    d = _full(spark, sf_dir).filter("net is not null and rm is not null").select("pair", (F.col("net") * F.col("net") - F.col("rm") * F.col("rm")).alias("d"))
    g = d.groupBy("pair").agg(F.count("d").alias("n"), F.avg("d").alias("mean_d"), F.var_samp("d").alias("v"))
    stat = F.col("mean_d") / F.sqrt(F.greatest(F.col("v") / F.col("n"), F.lit(1e-12)))
    g = g.withColumn("stat", stat).withColumn("p", 2 * (1 - udfs.t_cdf(F.abs("stat"), (F.col("n") - 1).cast("double"))))
    return g.select("pair", "n", r6("stat").alias("stat"), r6("p").alias("p"), F.when(F.col("p") >= 0.05, "no difference").when(F.col("stat") < 0, "less variable").otherwise("more variable").alias("conclusion"))


_TESTS = systems_sql([System("full")]) + f""", td AS (SELECT pair, net, net - avg(net) OVER (PARTITION BY pair) AS dev, row_number() OVER (PARTITION BY pair ORDER BY t) AS i FROM sysbt WHERE period = 'oos' AND net IS NOT NULL),
tg AS (SELECT *, m3 / m2 ** 1.5 AS g1, m4 / (m2 * m2) - 3 AS g2, mu / (sd / sqrt(n)) AS ts FROM (SELECT pair, count(*) AS n, avg(net) AS mu, stddev_samp(net) AS sd, avg(dev ** 2) AS m2, avg(dev ** 3) AS m3, avg(dev ** 4) AS m4 FROM td GROUP BY 1) WHERE sd > 0 AND n > 20),
tl AS (SELECT g.pair, n * (n + 2) * sum((c / (n * m2)) ** 2 / (n - k)) AS lb FROM (SELECT a.pair, k, sum(a.dev * b.dev) AS c FROM td a CROSS JOIN range(1, 11) q(k) JOIN td b ON b.pair = a.pair AND b.i = a.i - k GROUP BY 1, 2) JOIN tg g USING (pair) GROUP BY g.pair, n),
ta AS (SELECT *, n / 6.0 * (g1 * g1 + g2 * g2 / 4) AS jb FROM tg JOIN tl USING (pair))
SELECT pair, n, round(jb, 6) AS jarque_bera, round({chi2_sf_sql('jb', 2)}, 6) AS p_normal, round(lb, 6) AS ljung_box, round({chi2_sf_sql('lb', 10)}, 6) AS p_lags, round(ts, 6) AS t_stat, round(1 - {t_cdf_sql('ts', '(n - 1)')}, 6) AS p_mean,
  round(g1 * sqrt(n * (n - 1)) / (n - 2), 6) AS skew, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), 6) AS kurtosis FROM ta"""


@query("t6_return_tests_p", _TESTS)
def t6(spark, sf_dir):
    """Normality, mean above zero, autocorrelation over ten lags, skew and excess kurtosis of the system's returns, with p-values."""
    return return_tests(_full(spark, sf_dir))


def return_tests(s):
    """The tests of a table (pair, t, net)."""
    s = s.filter("net is not null").select("pair", "t", "net")
    q, w = Window.partitionBy("pair"), x.pair_window()
    s = s.withColumn("dev", F.col("net") - F.avg("net").over(q))
    g = s.groupBy("pair").agg(F.count("net").alias("n"), F.sum(F.col("dev") * F.col("dev")).alias("ss"), F.skewness("net").alias("g1"), F.kurtosis("net").alias("g2"), F.avg("net").alias("mu"), F.stddev_samp("net").alias("sd"))
    lags = s.select("pair", *[(F.col("dev") * F.lag("dev", k).over(w)).alias(f"v{k}") for k in range(1, 11)]).groupBy("pair").agg(*[F.sum(f"v{k}").alias(f"c{k}") for k in range(1, 11)])
    o = g.join(lags, "pair").filter("sd > 0 and n > 20")
    n = F.col("n")
    lb = n * (n + 2) * sum(((F.col(f"c{k}") / F.col("ss")) ** 2 / (n - k) for k in range(1, 11)), F.lit(0.0))
    jb = n / 6.0 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4)
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    o = o.withColumn("jb", jb).withColumn("lb", lb).withColumn("ts", F.col("mu") / (F.col("sd") / F.sqrt(n)))
    return o.select("pair", "n", r6("jb").alias("jarque_bera"), r6(x.chi2_sf("jb", 2)).alias("p_normal"), r6("lb").alias("ljung_box"), r6(x.chi2_sf("lb", 10)).alias("p_lags"), r6("ts").alias("t_stat"), r6(1 - udfs.t_cdf(F.col("ts"), (n - 1).cast("double"))).alias("p_mean"), r6(skew).alias("skew"), r6(kurt).alias("kurtosis"))


@query("a10_spearman_p", f""", rk AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY ry) + (count(*) OVER (PARTITION BY pair, ry) - 1) / 2.0 AS a, rank() OVER (PARTITION BY pair ORDER BY rx) + (count(*) OVER (PARTITION BY pair, rx) - 1) / 2.0 AS b FROM spine WHERE ry IS NOT NULL AND rx IS NOT NULL),
rr AS (SELECT *, rho * sqrt((n - 2) / greatest(1e-300, 1 - rho * rho)) AS ts FROM (SELECT pair, count(*) AS n, corr(a, b) AS rho FROM rk GROUP BY 1))
SELECT pair, n, round(rho, 6) AS rho, round(2 * (1 - {t_cdf_sql('abs(ts)', '(n - 2)')}), 6) AS p FROM rr""")
def a10(spark, sf_dir):
    """Rank correlation of the legs' returns with the p of its t statistic."""
    s = spine(spark, sf_dir).filter("ry is not null and rx is not null").select("pair", "ry", "rx")
    rank = lambda c: F.rank().over(Window.partitionBy("pair").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("pair", c)) - 1) / 2.0
    g = s.withColumn("a", rank("ry")).withColumn("b", rank("rx")).groupBy("pair").agg(F.corr("a", "b").alias("rho"), F.count(F.lit(1)).alias("n"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-300), 1 - F.col("rho") * F.col("rho")))
    return g.select("pair", "n", r6("rho").alias("rho"), r6(2 * (1 - udfs.t_cdf(F.abs(t), (F.col("n") - 2).cast("double")))).alias("p"))


@query("x9_student_t", f""", st AS (SELECT pair, avg(ry) / (stddev_samp(ry) / sqrt(count(ry))) AS ts, count(ry) - 1 AS df FROM spine GROUP BY 1)
SELECT pair, round(ts, 6) AS t, round({t_cdf_sql('ts', 'df')}, 6) AS cdf FROM st""")
def x9(spark, sf_dir):
    """Student's t distribution at every pair's mean return."""
    g = spine(spark, sf_dir).groupBy("pair").agg((F.avg("ry") / (F.stddev_samp("ry") / F.sqrt(F.count("ry")))).alias("t"), (F.count("ry") - 1).cast("double").alias("df"))
    return g.select("pair", r6("t").alias("t"), r6(udfs.t_cdf("t", "df")).alias("cdf"))


def _lagged(columns, most: int):
    """Grouped map: the lag-selected statistic of each pair's series (one column), or of the residuals of the first on the second (two)."""
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        s = frame[columns[0]].to_numpy(float)
        if len(columns) == 2:
            v = frame[columns[1]].to_numpy(float)
            m = np.column_stack([v, np.ones(len(v))])
            s = s - m @ np.linalg.lstsq(m, s, rcond=None)[0]
        if len(s) < 20:
            return pd.DataFrame([], columns=["pair", "tau", "lags"])
        tau, lags = udfs.lagged_unit_root(s, most, constant=len(columns) == 1)
        return pd.DataFrame([(frame["pair"].iloc[0], tau, lags)], columns=["pair", "tau", "lags"])

    return run


@query("r1_dickey_fuller_lagged")
def r1(spark, sf_dir):
    """Unit-root test of every pair's whole spread, lags (up to 15) by the information criterion."""
    got = spine(spark, sf_dir).select("pair", "t", "spread").groupBy("pair").applyInPandas(_lagged(["spread"], 15), "pair string, tau double, lags int")
    return got.select("pair", "lags", r6("tau").alias("tau"), r6(x.unit_root_p("tau", 1)).alias("p"))


@query("r2_engle_granger_lagged")
def r2(spark, sf_dir):
    """Cointegration test of every pair's legs over all rows, lags (up to 15) by the information criterion."""
    got = spine(spark, sf_dir).select("pair", "t", "y", "x").groupBy("pair").applyInPandas(_lagged(["y", "x"], 15), "pair string, tau double, lags int")
    return got.select("pair", "lags", r6("tau").alias("tau"), r6(x.unit_root_p("tau", 2)).alias("p"))


@query("b22_universe_record")
def b22(spark, sf_dir):
    """A row per pair: the full system before and after the split, what it adds to the market, trades, timing test, interval and crisis share."""
    s = written(run_systems(spark, sf_dir, [System("full")]), "system")  # four tables derive from it
    m = b.metrics(s, ["pair", "period"])
    of = lambda k, c: F.max(F.when(F.col("period") == k, F.col(c)))
    side = m.groupBy("pair").agg(*[r6(of(k, c)).alias(f"{k}_{c}") for k in ("train", "oos") for c in ("total", "sharpe", "max_drawdown")])
    after = s.filter("period = 'oos'").withColumn("spread_return", F.col("ry") - F.col("hedge") * F.col("rx"))
    market = after.groupBy("pair").agg((F.product(1 + F.col("rm")) - 1).alias("market_total"), r6(F.avg((F.col("regime") == 0).cast("int"))).alias("crisis"))
    timing = sc.random_schedules(after, b.trades(after)).select("pair", "n_trades", F.round("p_sharpe", 4).alias("p_timing"))
    interval = sy.bootstrap(after, block=1).filter("measure = 'sharpe'").select("pair", r6("low").alias("low"), r6("high").alias("high"))
    out = side.join(market, "pair").join(timing, "pair", "left").join(interval, "pair", "left")
    return out.withColumn("alpha", r6(F.col("oos_total") - F.col("market_total"))).drop("market_total")


@query("a19_universe_hits")
def a19(spark, sf_dir):
    """The universe as one row: hit rates, ratio of train to later Sharpe ratios, best and worst pair, survivors of the timing test."""
    u = b22(spark, sf_dir)
    up = lambda c: r6(F.avg((F.col(c) > 0).cast("int")))
    return u.agg(
        F.count(F.lit(1)).alias("pairs"), up("oos_total").alias("hit_rate"), up("alpha").alias("alpha_hit_rate"), r6(F.avg("oos_sharpe")).alias("mean_sharpe"), r6(F.median("oos_sharpe")).alias("median_sharpe"),
        r6(F.try_divide(F.avg("train_sharpe"), F.avg("oos_sharpe"))).alias("overfit_ratio"), F.max_by("pair", F.struct("oos_sharpe", "pair")).alias("best"), F.min_by("pair", F.struct("oos_sharpe", "pair")).alias("worst"), F.count_if(F.col("p_timing") < 0.05).alias("timed"),
    )


@query("t7_scorecard")
def t7(spark, sf_dir):
    """Scores of every pair by walk, timing, interval, stress, and tests, and their mean."""
    walk = b17(spark, sf_dir).select("pair", F.when((F.col("consistency") >= 0.6) & (F.col("mean_sharpe") > 0.3), 100).when((F.col("consistency") >= 0.5) & (F.col("mean_sharpe") > 0), 60).otherwise(20).alias("walk"))
    ran = written(run_systems(spark, sf_dir, [System("full")]), "system")  # timing, interval, stress and tests derive from it
    s = ran.filter("period = 'oos'").withColumn("spread_return", F.col("ry") - F.col("hedge") * F.col("rx"))
    p_ = F.col("p_sharpe")
    timing = sc.random_schedules(s, b.trades(s)).select("pair", F.when(p_ < 0.01, 100).when(p_ < 0.05, 80).when(p_ < 0.10, 60).otherwise(20).alias("timing"))
    interval = sy.bootstrap(s, block=1).filter("measure = 'sharpe'").select("pair", F.when(F.col("low") > 0, 100).when(F.col("point") > 0, 60).otherwise(20).alias("interval"))
    stress = j.in_periods(ran, j.periods(spark)).groupBy("pair", "name").agg((100 * (x.compound("net") - x.compound("rm"))).alias("alpha"), (100 * F.avg((F.col("moved") > 0).cast("int"))).alias("rate"))
    stress = stress.groupBy("pair").agg(F.avg("alpha").alias("a"), F.avg("rate").alias("r")).select("pair", F.when(F.col("a") > 0, 100).when(F.col("r") < 30, 80).when(F.col("a") > -3, 60).otherwise(20).alias("stress"))
    tests = return_tests(s).join(r1(spark, sf_dir).select("pair", F.col("p").alias("p_root")), "pair")
    part = lambda c: F.when(F.col(c) < 0.05, 50).when(F.col(c) < 0.10, 25).otherwise(0)
    tests = tests.select("pair", (part("p_mean") + part("p_root")).alias("tests"))
    swept = sy.net_returns(sy.run_systems(quantile_spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "ry", "rx", "rm", "regime", "spread", "beta"), SWEEP, p.SPLIT))
    sweep = swept.filter(F.col("date") > F.lit(p.SPLIT).cast("date")).groupBy("pair", "system").agg(x.compound("net").alias("total")).groupBy("pair").agg(F.avg((F.col("total") > 0).cast("int")).alias("v")).select("pair", F.when(F.col("v") >= 0.75, 100).when(F.col("v") >= 0.6, 70).otherwise(20).alias("sweep"))
    out = walk
    for other in (timing, interval, stress, tests, sweep):
        out = out.join(other, "pair", "left")
    names = ["walk", "timing", "interval", "stress", "sweep", "tests"]
    out = out.select("pair", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return out.withColumn("overall", F.round(sum((F.col(n) for n in names), F.lit(0.0)) / len(names), 4))


SWEEP = [
    System(f"{entry}/{leave}/{hold}", rules=R(entry, leave, entry + 0.5, max(0.1, leave - 0.1), max_hold=hold))
    for entry in (1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5) for leave in (0.0, 0.25, 0.5, 0.75, 1.0) for hold in (20, 30, 45) if leave < entry
]


_SWEPT = metric_sql("(SELECT * FROM sysbt WHERE period = 'oos')", "system, pair")


@query("b15_sensitivity_whole", systems_sql([System("full")], SWEEP) + f"SELECT system, pair, n, total, sharpe, max_drawdown FROM ({digits_sql(_SWEPT)})")
def b15(spark, sf_dir):
    """All settings of entry, exit and longest hold, net of costs, after the split; a pair's rows are exchanged once for all of them."""
    m = measured(run_systems(spark, sf_dir, SWEEP).filter("period = 'oos'"), ["system", "pair"])
    return m.select("system", "pair", "n", "total", "sharpe", "max_drawdown")
