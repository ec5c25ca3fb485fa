"""Diagnostics, discovery, health, rotation, inference and regimes (R, D, T, M) over the weekly panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.operators import diagnostics as d
from covary.operators import unitroot as u
from covary.plans.base import query, spine
from covary.plans.scalar import _K, _columns, r6
from covary.plans.trading import BT, backtest
from covary.sources import panel as p

PD = "PARTITION BY pair ORDER BY t ROWS BETWEEN"


def p_sql(tau: str, series: int) -> str:
    """The p-value of a unit-root statistic."""
    star, small, large, top, bottom = x._SURFACES[series]
    poly = lambda k: " + ".join(f"({v}) * ({tau}) ^ {i}" for i, v in enumerate(k))
    v = f"(CASE WHEN {tau} <= {star} THEN {poly(small)} ELSE {poly(large)} END)"
    k = _K.replace("abs(z)", f"abs({v})")
    tail = f"(exp(-{v} * {v} / 2) / sqrt(2 * pi()) * {k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429)))))"
    return f"CASE WHEN {tau} > {top} THEN 1.0 WHEN {tau} < {bottom} THEN 0.0 WHEN {v} >= 0 THEN 1 - {tail} ELSE {tail} END"


ROLL = f""",
dg0 AS (SELECT *, lag(spread) OVER (PARTITION BY pair ORDER BY t) AS l, lag(y) OVER (PARTITION BY pair ORDER BY t) AS y1, lag(x) OVER (PARTITION BY pair ORDER BY t) AS x1 FROM spine),
dg1 AS (SELECT *, spread - l AS ds FROM dg0),
dg2 AS (SELECT *, count(*) OVER wh AS nw, regr_slope(ds, l) OVER ({PD} 124 PRECEDING AND 1 PRECEDING) AS th, regr_slope(y, x) OVER wh AS b, regr_intercept(y, x) OVER wh AS a, regr_r2(y, x) OVER wh AS r2,
  regr_sxx(ds, l) OVER wi AS sxx, regr_sxy(ds, l) OVER wi AS sxy, regr_syy(ds, l) OVER wi AS syy
  FROM dg1 WINDOW wh AS ({PD} 126 PRECEDING AND 1 PRECEDING), wi AS ({PD} 125 PRECEDING AND 1 PRECEDING)),
dg3 AS (SELECT *, CASE WHEN nw >= 126 THEN CASE WHEN th < 0 THEN least(greatest(-ln(2) / th, 5.0), 60.0) ELSE 60.0 END END AS half_life, CASE WHEN nw >= 126 THEN sxy / sxx / sqrt((syy - sxy * sxy / sxx) / 123 / sxx) END AS df_tau FROM dg2),
eg0 AS (SELECT o.pair, o.t, sum((i.y1 - o.a - o.b * i.x1) ^ 2) AS uu, sum((i.y1 - o.a - o.b * i.x1) * ((i.y - i.y1) - o.b * (i.x - i.x1))) AS ud, sum(((i.y - i.y1) - o.b * (i.x - i.x1)) ^ 2) AS dd
  FROM dg3 o JOIN dg3 i ON i.pair = o.pair AND i.t BETWEEN o.t - 125 AND o.t - 1 WHERE o.nw >= 126 GROUP BY 1, 2),
dg AS (SELECT dg3.*, CASE WHEN nw >= 126 THEN ud / uu / sqrt((dd - ud * ud / uu) / 124 / uu) END AS eg_tau FROM dg3 LEFT JOIN eg0 USING (pair, t))
"""


def _rolled(spark, sf_dir):
    return d.rolling_pairs(spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "spread"))


@query("r1_dickey_fuller", ROLL + f"SELECT pair, t, round(df_tau, 5) AS tau, round({p_sql('round(df_tau, 6)', 1)}, 4) AS p FROM dg WHERE df_tau IS NOT NULL")
def r1(spark, sf_dir):
    return _rolled(spark, sf_dir).filter("df_tau is not null").select("pair", "t", F.round("df_tau", 5).alias("tau"), F.round("df_p", 4).alias("p"))


@query("r2_engle_granger", ROLL + f"SELECT pair, t, round(eg_tau, 4) AS tau, round({p_sql('round(eg_tau, 6)', 2)}, 4) AS p FROM dg WHERE eg_tau IS NOT NULL")
def r2(spark, sf_dir):
    return _rolled(spark, sf_dir).filter("eg_tau is not null").select("pair", "t", F.round("eg_tau", 4).alias("tau"), F.round("eg_p", 4).alias("p"))


HURST = """,
hu0 AS (SELECT a.pair, i.i, k.k, (a.t - (i.i - 126)) // k.k AS block, a.t - (i.i - 126) AS pos, a.spread AS s FROM spine a JOIN (SELECT pair, t AS i FROM spine WHERE t % 5 = 0 AND t >= 126) i ON i.pair = a.pair AND a.t BETWEEN i.i - 126 AND i.i - 1
  CROSS JOIN (VALUES (8), (12), (18), (27), (40), (60)) k(k) WHERE (a.t - (i.i - 126)) // k.k < 126 // k.k),
hu1 AS (SELECT *, s - avg(s) OVER (PARTITION BY pair, i, k, block) AS dev FROM hu0),
hu2 AS (SELECT *, sum(dev) OVER (PARTITION BY pair, i, k, block ORDER BY pos ROWS UNBOUNDED PRECEDING) AS walk FROM hu1),
hu3 AS (SELECT pair, i, k, avg(r / sd) AS rs FROM (SELECT pair, i, k, block, max(walk) - min(walk) AS r, stddev_samp(s) AS sd FROM hu2 GROUP BY ALL) WHERE sd > 1e-10 GROUP BY ALL),
hu AS (SELECT pair, i AS t, CASE WHEN count(*) < 3 THEN 0.5 ELSE least(greatest(regr_slope(ln(rs), ln(k)), 0.0), 1.0) END AS hurst FROM hu3 GROUP BY 1, 2)
"""


@query("r3_hurst", HURST + "SELECT pair, t::INT AS t, round(hurst, 6) AS hurst FROM hu")
def r3(spark, sf_dir):
    return d.rolling_hurst(spine(spark, sf_dir)).select("pair", F.col("t").cast("int").alias("t"), r6("hurst").alias("hurst"))


@query("r4_half_life", ROLL + "SELECT pair, t, round(half_life, 4) AS half_life FROM dg WHERE half_life IS NOT NULL")
def r4(spark, sf_dir):
    return _rolled(spark, sf_dir).filter("half_life is not null").select("pair", "t", F.round("half_life", 4).alias("half_life"))


@query("r5_whole_half_life", "SELECT pair, round(CASE WHEN th < 0 THEN -ln(2) / th ELSE 999 END, 5) AS half_life FROM (SELECT pair, regr_slope(ds, l) AS th FROM (SELECT pair, lag(spread) OVER o AS l, spread - lag(spread) OVER o AS ds FROM spine WINDOW o AS (PARTITION BY pair ORDER BY t)) GROUP BY 1)")
def r5(spark, sf_dir):
    s = spine(spark, sf_dir).select("pair", F.lag("spread").over(x.pair_window()).alias("l"), x.diff("spread", x.pair_window()).alias("ds"))
    th = F.regr_slope("ds", "l")
    return s.groupBy("pair").agg(F.round(F.when(th < 0, -0.6931471805599453 / th).otherwise(999.0), 5).alias("half_life"))


@query("r6_rolling_hedge", ROLL + "SELECT pair, t, round(b, 6) AS hedge, round(r2, 6) AS r2 FROM dg WHERE nw >= 126")
def r6_(spark, sf_dir):
    return _rolled(spark, sf_dir).filter("hedge is not null").select("pair", "t", r6("hedge").alias("hedge"), r6("r2").alias("r2"))


@query("r7_hedge_drift", "SELECT pair, i::INT AS t, round(stddev_pop(b), 6) AS drift FROM (SELECT a.pair, i.i, j.j, regr_slope(a.y, a.x) AS b FROM spine a JOIN (SELECT pair, t AS i FROM spine WHERE t % 20 = 0 AND t >= 126) i ON i.pair = a.pair CROSS JOIN range(7) j(j) WHERE a.t BETWEEN i.i - 126 + 15 * j.j AND i.i - 126 + 15 * j.j + 30 AND 15 * j.j + 31 <= 126 GROUP BY ALL) GROUP BY 1, 2")
def r7(spark, sf_dir):
    """Spread of slopes over half-overlapping parts of the window (31 rows, every 15)."""
    s = spine(spark, sf_dir).select("pair", "t", "y", "x", F.max("t").over(Window.partitionBy("pair")).alias("last"))
    ends = F.filter(F.sequence(F.col("t") + 1, F.col("t") + 126), lambda i: (i % 20 == 0) & (i >= 126) & (i <= F.col("last")))
    s = s.withColumn("i", F.explode(ends)).withColumn("pos", F.col("t") - (F.col("i") - 126))
    s = s.withColumn("part", F.explode(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: (F.col("pos") >= k * 15) & (F.col("pos") <= k * 15 + 30) & (k * 15 + 31 <= 126))))
    slopes = s.groupBy("pair", "i", "part").agg(F.regr_slope("y", "x").alias("b"))
    return slopes.groupBy("pair", F.col("i").cast("int").alias("t")).agg(r6(F.stddev_pop("b")).alias("drift"))


SCORE = f""",
sc0 AS (SELECT pair, sector, y, x, count(*) OVER q AS n, regr_slope(y, x) OVER q AS b, regr_intercept(y, x) OVER q AS a, corr(y, x) OVER q AS r, t FROM panel WINDOW q AS (PARTITION BY pair)),
sc1 AS (SELECT *, y - b * x AS s, y - a - b * x AS u, lag(y - b * x) OVER o AS s1, lag(y - a - b * x) OVER o AS u1 FROM sc0 WINDOW o AS (PARTITION BY pair ORDER BY t)),
sc2 AS (SELECT pair, sector, max(n) AS n, max(r) AS r, regr_slope(s - s1, s1) AS th, regr_sxx(s - s1, s1) AS sxx, regr_sxy(s - s1, s1) AS sxy, regr_syy(s - s1, s1) AS syy, sum(u1 * u1) AS uu, sum(u1 * (u - u1)) AS ud, sum((u - u1) ^ 2) AS dd, count(s1) AS m FROM sc1 GROUP BY 1, 2),
sc3 AS (SELECT *, round(sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (m - 2) / sxx), 6) AS dt, round(ud / uu / sqrt((dd - ud * ud / uu) / (m - 1) / uu), 6) AS et, CASE WHEN th < 0 THEN -ln(2) / th ELSE 999 END AS hl FROM sc2),
sc4 AS (SELECT *, {p_sql('dt', 1)} AS dp, {p_sql('et', 2)} AS ep FROM sc3),
score AS (SELECT pair, sector, n, CASE WHEN n < 252 THEN 0 ELSE CASE WHEN ep < 0.01 THEN 50 WHEN ep < 0.05 THEN 35 WHEN ep < 0.10 THEN 15 ELSE 0 END + CASE WHEN abs(r) > 0.8 THEN 20 WHEN abs(r) > 0.6 THEN 12 WHEN abs(r) > 0.4 THEN 5 ELSE 0 END
  + CASE WHEN dp < 0.01 THEN 30 WHEN dp < 0.05 THEN 20 WHEN dp < 0.10 THEN 10 ELSE 0 END + CASE WHEN th >= 0 THEN -15 WHEN hl BETWEEN 5 AND 30 THEN 10 WHEN hl > 100 THEN -10 ELSE 0 END END AS score, hl, r FROM sc4)
"""


def pair_scores(panel, min_rows: int = 252, lagged: bool = False):
    """(pair, sector, n, score, hl, r, dp, ep): one window over the pair for the hedge, one aggregate for all the rest. lagged: tests choose their lags, at most one for the spread."""
    q = Window.partitionBy("pair")
    s = panel.withColumn("n", F.count(F.lit(1)).over(q)).withColumn("b", F.regr_slope("y", "x").over(q)).withColumn("a", F.regr_intercept("y", "x").over(q)).withColumn("r", F.corr("y", "x").over(q))
    s = s.withColumn("s", F.col("y") - F.col("b") * F.col("x")).withColumn("u", F.col("y") - F.col("a") - F.col("b") * F.col("x")).withColumn("s1", F.lag("s").over(x.pair_window())).withColumn("u1", F.lag("u").over(x.pair_window()))
    ds, du = F.col("s") - F.col("s1"), F.col("u") - F.col("u1")
    s = s.withColumn("ds", ds).withColumn("ds1", F.lag("ds").over(x.pair_window()))
    g = s.groupBy("pair", "sector").agg(*(u.one_lag_sums(F.col("s1"), F.col("ds"), F.col("ds1")) if lagged else []), F.max("n").alias("n"), F.max("r").alias("r"), F.regr_slope(ds, F.col("s1")).alias("th"), F.regr_sxx(ds, F.col("s1")).alias("sxx"), F.regr_sxy(ds, F.col("s1")).alias("sxy"), F.regr_syy(ds, F.col("s1")).alias("syy"), F.sum(F.col("u1") * F.col("u1")).alias("uu"), F.sum(F.col("u1") * du).alias("ud"), F.sum(du * du).alias("dd"), F.count("s1").alias("m"))
    g = g.withColumn("dt", F.round(F.expr("sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (m - 2) / sxx)"), 6)).withColumn("et", F.round(F.expr("ud / uu / sqrt((dd - ud * ud / uu) / (m - 1) / uu)"), 6))
    if lagged:
        g = g.withColumn("dt", F.round(u.one_lag()[0], 6)).join(u.whole_lagged(panel).select("pair", "eg_tau"), "pair", "left").withColumn("et", F.round("eg_tau", 6))
    g = g.withColumn("dp", x.unit_root_p("dt", 1)).withColumn("ep", x.unit_root_p("et", 2)).withColumn("hl", F.when(F.col("th") < 0, -0.6931471805599453 / F.col("th")).otherwise(999.0))
    bands = lambda c, levels, below=True: F.coalesce(*[F.when((c < v) if below else (c > v), pts) for v, pts in levels], F.lit(0))
    score = bands(F.col("ep"), [(0.01, 50), (0.05, 35), (0.10, 15)]) + bands(F.abs("r"), [(0.8, 20), (0.6, 12), (0.4, 5)], False) + bands(F.col("dp"), [(0.01, 30), (0.05, 20), (0.10, 10)])
    score = score + F.when(F.col("th") >= 0, -15).when(F.col("hl").between(5, 30), 10).when(F.col("hl") > 100, -10).otherwise(0)
    return g.select("pair", "sector", "n", F.when(F.col("n") < min_rows, 0).otherwise(score).alias("score"), "hl", "r", "dp", "ep")


@query("d2_pair_score", SCORE + "SELECT pair, sector, n::BIGINT AS n, score::INT AS score, round(hl, 5) AS half_life, round(r, 6) AS r FROM score")
def d2(spark, sf_dir):
    return pair_scores(p.week_panel(spark, sf_dir)).select("pair", "sector", "n", "score", F.round("hl", 5).alias("half_life"), r6("r").alias("r"))


@query("d3_sector_scan", SCORE + "SELECT sector, pair, score::INT AS score FROM score WHERE score >= 50 QUALIFY row_number() OVER (PARTITION BY sector ORDER BY score DESC, pair) <= 3")
def d3(spark, sf_dir):
    """All sectors in one job: candidates, scores, floor, the best of each sector."""
    best = Window.partitionBy("sector").orderBy(F.desc("score"), "pair")
    return pair_scores(p.week_panel(spark, sf_dir)).filter("score >= 50").withColumn("k", F.row_number().over(best)).filter("k <= 3").select("sector", "pair", "score")


HEALTH = (
    ROLL
    + HURST
    + f""", he AS (SELECT dg.pair, dg.date, dg.t, hurst, {p_sql('round(df_tau, 6)', 1)} AS df_p, {p_sql('round(eg_tau, 6)', 2)} AS eg_p FROM dg LEFT JOIN hu ON hu.pair = dg.pair AND hu.t = dg.t WHERE dg.t % 5 = 0),
health AS (SELECT *, CASE WHEN t < 126 THEN 3 ELSE coalesce(df_p < 0.05, false)::INT + coalesce(hurst < 0.5, false)::INT + coalesce(eg_p < 0.05, false)::INT END AS checks_passed,
  CASE WHEN t < 126 THEN 1.0 ELSE (greatest(0.0, 1 - df_p / 0.10) + least(greatest(1 - 2 * hurst, 0.0), 1.0) + greatest(0.0, 1 - eg_p / 0.10)) / 3 END AS score FROM he)
"""
)


def _health(spark, sf_dir):
    return d.rolling_health(spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "spread"))


@query("d4_rolling_health", HEALTH + "SELECT pair, t, checks_passed, round(score, 4) AS health_score, checks_passed >= 2 AS healthy FROM health")
def d4(spark, sf_dir):
    return _health(spark, sf_dir).select("pair", "t", "checks_passed", F.round("health_score", 4).alias("health_score"), "healthy")


@query("d6_select_pairs", HEALTH + "SELECT pair, round(score, 4) AS health_score FROM (SELECT pair, arg_max(score, t) AS score, arg_max(checks_passed, t) AS c FROM health WHERE date <= DATE '2000-06-30' GROUP BY 1) WHERE c >= 2 AND score >= 0.6 ORDER BY round(score, 4) DESC, pair LIMIT 5")
def d6(spark, sf_dir):
    """The best healthy pairs as of a date."""
    last = _health(spark, sf_dir).filter("date <= '2000-06-30'").groupBy("pair").agg(F.max_by(F.struct("health_score", "healthy"), "t").alias("v"))
    return last.filter("v.healthy and v.health_score >= 0.6").select("pair", F.round("v.health_score", 4).alias("health_score")).orderBy(F.desc("health_score"), "pair").limit(5)


@query("d7_rotation", HEALTH + "SELECT t, list(pair ORDER BY round(score, 4) DESC, pair)[:5] AS active, least(count(*), 5)::INT AS n FROM health WHERE t % 60 = 0 AND checks_passed >= 2 AND score >= 0.5 GROUP BY 1")
def d7(spark, sf_dir):
    """Rebalanced every 60 rows: the five best healthy pairs as a list."""
    h = _health(spark, sf_dir).filter("t % 60 = 0 and healthy and health_score >= 0.5")
    ranked = h.withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy(F.round("health_score", 4).desc(), "pair"))).filter("k <= 5")
    return ranked.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pair"))), lambda v: v["pair"]).alias("active"), F.count(F.lit(1)).cast("int").alias("n"))


@query("d13_latest_signal", BT + "SELECT pair, max(date) AS date, arg_max(signal, t)::INT AS signal, arg_max(z, t) AS z, arg_max(regime, t)::INT AS regime FROM bt WHERE z IS NOT NULL GROUP BY 1")
def d13(spark, sf_dir):
    last = backtest(spark, sf_dir).filter("z is not null").groupBy("pair").agg(F.max_by(F.struct("date", "signal", "z", "regime"), "t").alias("v"))
    return last.select("pair", "v.date", "v.signal", "v.z", "v.regime")


@query("d14_order_intents", BT + """SELECT pair, signal, CASE WHEN signal = 0 AND pos <> 0 THEN 'close' WHEN signal = 0 OR inc < 100 THEN 'none' ELSE 'open' END AS intent, CASE WHEN signal <> 0 AND inc >= 100 THEN trunc(inc / y)::INT ELSE 0 END AS qty_y FROM (
  SELECT pair, arg_max(signal, t)::INT AS signal, arg_max(y, t) AS y, arg_max(signal, t)::INT * 0 + (hash_pos) AS pos, least(1e6 * 0.2 * 0.5 * least(greatest(least(1.0, abs(arg_max(z, t)) / 1.5), 0.5), 1.0), 2e5) AS inc FROM (SELECT *, length(pair) % 2 AS hash_pos FROM bt WHERE z IS NOT NULL) GROUP BY pair, hash_pos)""")
def d14(spark, sf_dir):
    """What to do with each pair: close, nothing, or an increment by confidence, in whole units."""
    last = backtest(spark, sf_dir).filter("z is not null").groupBy("pair").agg(F.max_by(F.struct("signal", "y", "z"), "t").alias("v")).select("pair", "v.*", (F.length("pair") % 2).alias("pos"))
    inc = F.least(1e6 * 0.2 * 0.5 * x.clip(x.confidence("z"), 0.5, 1.0), F.lit(2e5))
    intent = F.when((F.col("signal") == 0) & (F.col("pos") != 0), "close").when((F.col("signal") == 0) | (inc < 100), "none").otherwise("open")
    return last.select("pair", "signal", intent.alias("intent"), F.when((F.col("signal") != 0) & (inc >= 100), (inc / F.col("y")).cast("int")).otherwise(0).alias("qty_y"))


# inference -----------------------------------------------------------------------------------------------------------

_PV = "(SELECT pair AS label, round(dp, 6) AS p FROM sc4 WHERE dp IS NOT NULL)"


def _p_values(spark, sf_dir):
    """Every pair's p of a unit root in its spread, over all rows."""
    return pair_scores(p.week_panel(spark, sf_dir)).filter("dp is not null").select(F.col("pair").alias("label"), r6("dp").alias("p"))


@query("t8_t11_corrections", SCORE + f"""SELECT label, p, k::INT AS k, least(1.0, p * m / k) AS simple_adjusted, p <= 0.05 * k / m AS simple_pass, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS bh_adjusted, k <= coalesce(max(CASE WHEN p <= 0.05 * k / m THEN k END) OVER (), 0) AS bh_pass,
  least(1.0, p * m) AS bonferroni, least(1.0, max(p * (m - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS holm_adjusted, min((p <= 0.05 / (m - k + 1))::INT) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) = 1 AS holm_pass FROM (SELECT *, row_number() OVER (ORDER BY p, label) AS k, count(*) OVER () AS m FROM {_PV})""")
def t8(spark, sf_dir):
    """Benjamini-Hochberg (row by row, and step-up with monotone adjustment), Bonferroni and Holm over a table of p-values."""
    by_p, back = Window.orderBy("p", "label"), Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    up, every = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    t = _p_values(spark, sf_dir).withColumn("k", F.row_number().over(by_p)).withColumn("m", F.count(F.lit(1)).over(every))
    one = F.lit(1.0)
    raw, left = F.col("p") * F.col("m") / F.col("k"), F.col("m") - F.col("k") + 1
    simple = F.col("p") <= 0.05 * F.col("k") / F.col("m")
    return t.select(
        "label", "p", "k", F.least(one, raw).alias("simple_adjusted"), simple.alias("simple_pass"), F.least(one, F.min(raw).over(back)).alias("bh_adjusted"), (F.col("k") <= F.coalesce(F.max(F.when(simple, F.col("k"))).over(every), F.lit(0))).alias("bh_pass"),
        F.least(one, F.col("p") * F.col("m")).alias("bonferroni"), F.least(one, F.max(F.col("p") * left).over(up)).alias("holm_adjusted"), (F.min((F.col("p") <= 0.05 / left).cast("int")).over(up) == 1).alias("holm_pass"),
    )


@query("t1_bootstrap", "SELECT pair, round(avg(sr), 5) AS mean_sharpe, round(stddev_samp(sr), 5) AS se, round(quantile_cont(sr, 0.025), 5) AS low, round(quantile_cont(sr, 0.975), 5) AS high FROM (SELECT d.pair, sim, avg(s.rm) / stddev_pop(s.rm) * sqrt(252) AS sr FROM (SELECT r.pair, sim, ('0x' || substr(md5('7:' || sim || ':' || i), 1, 8))::BIGINT % n AS pick FROM (SELECT pair, count(rm) AS n FROM spine GROUP BY 1) r CROSS JOIN range(40) q(sim) JOIN (SELECT pair, t - 1 AS i FROM spine WHERE rm IS NOT NULL) e ON e.pair = r.pair) d JOIN spine s ON s.pair = d.pair AND s.t = d.pick + 1 GROUP BY 1, 2) GROUP BY 1")
def t1(spark, sf_dir):
    """Resampled Sharpe ratios: draws by a hash of simulation and position, joined to the returns by number."""
    s = spine(spark, sf_dir).filter("rm is not null").select("pair", (F.col("t") - 1).alias("i"), "rm")
    n = Window.partitionBy("pair")
    draws = s.withColumn("n", F.count(F.lit(1)).over(n)).select("pair", "i", "n").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(39))))
    draws = draws.withColumn("pick", x.hash_draw(7, "sim", "i") % F.col("n"))
    sims = draws.select("pair", "sim", "pick").join(s.withColumnRenamed("i", "pick"), ["pair", "pick"]).groupBy("pair", "sim").agg((F.avg("rm") / F.stddev_pop("rm") * 252**0.5).alias("sr"))
    return sims.groupBy("pair").agg(F.round(F.avg("sr"), 5).alias("mean_sharpe"), F.round(F.stddev_samp("sr"), 5).alias("se"), F.round(F.percentile("sr", 0.025), 5).alias("low"), F.round(F.percentile("sr", 0.975), 5).alias("high"))


@query("t5_diebold_mariano", "SELECT pair, round(avg(d) / sqrt(var_pop(d) / count(d)), 5) AS stat FROM (SELECT pair, ry * ry - rx * rx AS d FROM spine WHERE ry IS NOT NULL) GROUP BY 1")
def t5(spark, sf_dir):
    dd = spine(spark, sf_dir).filter("ry is not null").select("pair", (F.col("ry") * F.col("ry") - F.col("rx") * F.col("rx")).alias("d"))
    return dd.groupBy("pair").agg(F.round(F.avg("d") / F.sqrt(F.var_pop("d") / F.count("d")), 5).alias("stat"))


@query("t6_return_tests", """SELECT pair, round(max(jb), 4) AS jarque_bera, round(max(n) * (max(n) + 2) * sum(rho * rho / (n - k)), 4) AS ljung_box, round(max(ts), 5) AS t_stat FROM (
  SELECT a.pair, k, max(n) AS n, max(jb) AS jb, max(ts) AS ts, sum((a.rm - mu) * (b.rm - mu)) / max(ss) AS rho FROM spine a JOIN (SELECT pair, count(rm) AS n, avg(rm) AS mu, var_pop(rm) * count(rm) AS ss, count(rm) / 6.0 * (skew_pop ^ 2 + kp ^ 2 / 4) AS jb, avg(rm) / (stddev_samp(rm) / sqrt(count(rm))) AS ts
    FROM (SELECT *, avg(((rm - m1) / s1) ^ 3) OVER (PARTITION BY pair) AS skew_pop, avg(((rm - m1) / s1) ^ 4) OVER (PARTITION BY pair) - 3 AS kp FROM (SELECT *, avg(rm) OVER (PARTITION BY pair) AS m1, stddev_pop(rm) OVER (PARTITION BY pair) AS s1 FROM spine WHERE rm IS NOT NULL)) GROUP BY pair, skew_pop, kp) g USING (pair)
  CROSS JOIN range(1, 11) q(k) JOIN spine b ON b.pair = a.pair AND b.t = a.t - k WHERE a.rm IS NOT NULL AND b.rm IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def t6(spark, sf_dir):
    """Jarque-Bera, Ljung-Box over ten lags, and t of the mean."""
    s = spine(spark, sf_dir).filter("rm is not null").select("pair", "t", "rm")
    q = Window.partitionBy("pair")
    s = s.withColumn("dev", F.col("rm") - F.avg("rm").over(q))
    for k in range(1, 11):
        s = s.withColumn(f"v{k}", F.col("dev") * F.lag("dev", k).over(x.pair_window()))
    lags = [F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("v")) for k in range(1, 11)]
    g = s.groupBy("pair").agg(F.count("rm").alias("n"), F.sum(F.col("dev") * F.col("dev")).alias("ss"), F.skewness("rm").alias("sk"), F.kurtosis("rm").alias("ku"), (F.avg("rm") / (F.stddev_samp("rm") / F.sqrt(F.count("rm")))).alias("ts"))
    rho = s.select("pair", F.explode(F.array(*lags)).alias("v")).groupBy("pair", F.col("v.k").alias("k")).agg(F.sum("v.v").alias("c"))
    out = rho.join(g, "pair").groupBy("pair").agg(F.max("n").alias("n"), F.sum((F.col("c") / F.col("ss")) ** 2 / (F.col("n") - F.col("k"))).alias("q"), F.max("sk").alias("sk"), F.max("ku").alias("ku"), F.max("ts").alias("ts"))
    return out.select("pair", F.round(F.col("n") / 6.0 * (F.col("sk") ** 2 + F.col("ku") ** 2 / 4), 4).alias("jarque_bera"), F.round(F.col("n") * (F.col("n") + 2) * F.col("q"), 4).alias("ljung_box"), F.round("ts", 5).alias("t_stat"))


@query("t14_sharpe_interval", "SELECT pair, round(sr, 5) AS sharpe, round(sr - 1.96 * sqrt((1 + sr * sr / 2) / n), 5) AS low, round(sr + 1.96 * sqrt((1 + sr * sr / 2) / n), 5) AS high FROM (SELECT pair, avg(ry) / stddev_samp(ry) AS sr, count(ry) AS n FROM spine GROUP BY 1)")
def t14(spark, sf_dir):
    g = spine(spark, sf_dir).groupBy("pair").agg((F.avg("ry") / F.stddev_samp("ry")).alias("sr"), F.count("ry").alias("n"))
    half = 1.96 * F.sqrt((1 + F.col("sr") * F.col("sr") / 2) / F.col("n"))
    return g.select("pair", F.round("sr", 5).alias("sharpe"), F.round(F.col("sr") - half, 5).alias("low"), F.round(F.col("sr") + half, 5).alias("high"))


@query("t13_signed_rank", "SELECT sector, sum(CASE WHEN d > 0 THEN rk ELSE 0 END)::DOUBLE AS stat, count(*)::BIGINT AS n FROM (SELECT *, rank() OVER (PARTITION BY sector ORDER BY abs(d)) + (count(*) OVER (PARTITION BY sector, abs(d)) - 1) / 2.0 AS rk FROM (SELECT sector, pair, round(avg(ry) - avg(rx), 8) AS d FROM spine GROUP BY ALL) WHERE d <> 0) GROUP BY 1")
def t13(spark, sf_dir):
    dd = spine(spark, sf_dir).groupBy("sector", "pair").agg(F.round(F.avg("ry") - F.avg("rx"), 8).alias("d")).filter("d <> 0").withColumn("a", F.abs("d"))
    rank = F.rank().over(Window.partitionBy("sector").orderBy("a")) + (F.count(F.lit(1)).over(Window.partitionBy("sector", "a")) - 1) / 2.0
    return dd.withColumn("rk", rank).groupBy("sector").agg(F.sum(F.when(F.col("d") > 0, F.col("rk")).otherwise(0.0)).alias("stat"), F.count(F.lit(1)).alias("n"))


# regimes -------------------------------------------------------------------------------------------------------------

_columns("m3_simple_regimes", {"simple": (lambda: F.when(F.col("vol") > 0.35, 0).when(F.col("vol") > 0.22, 1).otherwise(2), "CASE WHEN vol > 0.35 THEN 0 WHEN vol > 0.22 THEN 1 ELSE 2 END")})


@query("m4_quantile_regimes", f"SELECT pair, t, CASE WHEN vol IS NULL THEN 2 WHEN vol > hi THEN 0 WHEN vol > lo THEN 1 ELSE 2 END AS regime FROM spine JOIN (SELECT pair, quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.66) AS hi FROM spine WHERE date <= DATE '{p.SPLIT}' GROUP BY 1) USING (pair)")
def m4(spark, sf_dir):
    s = spine(spark, sf_dir)
    cuts = s.filter(x.mark_period("date", p.SPLIT) == "train").groupBy("pair").agg(F.percentile("vol", 0.33).alias("lo"), F.percentile("vol", 0.66).alias("hi"))
    return s.join(cuts, "pair").select("pair", "t", F.when(F.col("vol").isNull(), 2).when(F.col("vol") > F.col("hi"), 0).when(F.col("vol") > F.col("lo"), 1).otherwise(2).alias("regime"))


_TWO = "(SELECT pair, t, regime AS truth, CASE WHEN vol IS NULL THEN 2 WHEN vol > 0.3 THEN 0 WHEN vol > 0.2 THEN 1 ELSE 2 END AS pred FROM spine)"


@query("m9_confusion", f"SELECT truth, pred, count(*)::BIGINT AS n FROM {_TWO} GROUP BY ALL")
def m9(spark, sf_dir):
    pred = F.when(F.col("vol").isNull(), 2).when(F.col("vol") > 0.3, 0).when(F.col("vol") > 0.2, 1).otherwise(2)
    return spine(spark, sf_dir).groupBy(F.col("regime").alias("truth"), pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("m9_kappa", f", q AS (SELECT truth, pred, count(*)::BIGINT AS n FROM {_TWO} GROUP BY ALL) SELECT round(po, 6) AS accuracy, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT sum((truth = pred)::INT * n) / sum(n) AS po, sum((truth = pred)::INT * r * c) / (max(total) * max(total)) AS pe FROM (SELECT *, sum(n) OVER (PARTITION BY truth) AS r, (SELECT sum(n) FROM q j WHERE j.pred = q.truth) AS c, sum(n) OVER () AS total FROM q))")
def m9k(spark, sf_dir):
    n = m9(spark, sf_dir)
    rows, columns = n.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("r")), n.groupBy(F.col("pred").alias("k")).agg(F.sum("n").alias("c"))
    expected = rows.join(columns, "k").agg(F.sum(F.col("r") * F.col("c")).alias("e"))
    hit = n.agg(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("h"), F.sum("n").alias("total"))
    po, pe = F.col("h") / F.col("total"), F.col("e") / (F.col("total") * F.col("total"))
    # where all rows are of one class, chance agrees as well as the prediction does: 0 / 0, which is NaN in SQL too
    kappa = F.when(pe == 1, float("nan")).otherwise(F.try_divide(po - pe, 1 - pe))
    return hit.join(F.broadcast(expected)).select(r6(po).alias("accuracy"), r6(kappa).alias("kappa"))


@query("m10_transitions", "SELECT *, round(n / sum(n) OVER (PARTITION BY pair, from_regime), 6) AS prob FROM (SELECT pair, before AS from_regime, regime AS to_regime, count(*)::BIGINT AS n FROM (SELECT pair, regime, lag(regime) OVER (PARTITION BY pair ORDER BY t) AS before FROM spine) WHERE before IS NOT NULL GROUP BY 1, 2, 3)")
def m10(spark, sf_dir):
    n = spine(spark, sf_dir).select("pair", "regime", F.lag("regime").over(x.pair_window()).alias("before")).filter("before is not null").groupBy("pair", F.col("before").alias("from_regime"), F.col("regime").alias("to_regime")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("prob", r6(F.col("n") / F.sum("n").over(Window.partitionBy("pair", "from_regime"))))


_columns("m1_features", {
    **{f"vol_{n}": (lambda n=n: r6(x.annualise(x.rolling(F.stddev_samp, "rm", x.pair_window(), n))), f"round(CASE WHEN count(rm) OVER ({PD} {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN stddev_samp(rm) OVER ({PD} {n - 1} PRECEDING AND CURRENT ROW) * sqrt(252) END, 6)") for n in (5, 10, 20, 40, 60)},
    **{f"dd_{n}": (lambda n=n: r6((F.col("m") - x.rolling(F.max, "m", x.pair_window(), n, 1)) / x.rolling(F.max, "m", x.pair_window(), n, 1)), f"round((m - max(m) OVER ({PD} {n - 1} PRECEDING AND CURRENT ROW)) / max(m) OVER ({PD} {n - 1} PRECEDING AND CURRENT ROW), 6)") for n in (10, 20, 40, 60)},
    **{f"ret_{k}": (lambda k=k: r6(x.pct_change("m", x.pair_window(), k)), f"round(m / lag(m, {k}) OVER (PARTITION BY pair ORDER BY t) - 1, 6)") for k in (5, 10, 20)},
    "trend": (lambda: r6(F.col("m") / x.rolling(F.avg, "m", x.pair_window(), 20) - 1), f"round(CASE WHEN count(m) OVER ({PD} 19 PRECEDING AND CURRENT ROW) >= 20 THEN m / avg(m) OVER ({PD} 19 PRECEDING AND CURRENT ROW) - 1 END, 6)"),
    "pair_corr": (lambda: r6(x.rolling(F.corr, ["y", "x"], x.pair_window(), 30)), f"round(CASE WHEN count(y) OVER ({PD} 29 PRECEDING AND CURRENT ROW) >= 30 THEN corr(y, x) OVER ({PD} 29 PRECEDING AND CURRENT ROW) END, 6)"),
})
