"""Joins, aggregates, windows, ranking and set operations over the weekly panel (S, J, A, W, O, U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.operators import joins as j
from covary.operators import monitor as mo
from covary.operators.hedge import naive_spread
from covary.plans.base import query, spine
from covary.plans.scalar import _columns, r6
from covary.sources import panel as p
from covary.sources import tradelog as log

O = "(PARTITION BY pair ORDER BY t)"  # noqa: E741


def R(n, before=False):
    return f"(PARTITION BY pair ORDER BY t ROWS BETWEEN {n if before else n - 1} PRECEDING AND {'1 PRECEDING' if before else 'CURRENT ROW'})"


# sources -------------------------------------------------------------------------------------------------------------


@query("s1_prices", "SELECT date, ticker, sector, close FROM prices")
def s1(spark, sf_dir):
    return p.week_prices(spark, sf_dir)


@query("s2_some_tickers", "SELECT date, ticker, close FROM prices WHERE ticker IN ('NATION_1', 'NATION_7', 'NO SUCH')")
def s2(spark, sf_dir):
    """A ticker without data is simply absent."""
    return p.week_prices(spark, sf_dir).filter(F.col("ticker").isin("NATION_1", "NATION_7", "NO SUCH")).select("date", "ticker", "close")


@query("s3_readiness", "SELECT sector, ticker, count(*)::BIGINT AS days, min(date) AS first_date, max(date) AS last_date, count(*) >= 350 AS sufficient FROM prices GROUP BY ALL")
def s3(spark, sf_dir):
    n = F.count(F.lit(1))
    return p.week_prices(spark, sf_dir).groupBy("sector", "ticker").agg(n.alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), (n >= 350).alias("sufficient"))


@query("s4_universe", "SELECT pair, ticker_y, ticker_x, CASE WHEN ticker_y < 'NATION_2' THEN sector ELSE 'Unknown' END AS sector FROM pairs")
def s4(spark, sf_dir):
    """The catalogue of pairs with its sector lookup; pairs that the lookup lacks are 'Unknown'."""
    prices = p.week_prices(spark, sf_dir)
    known = prices.filter("ticker < 'NATION_2'").select(F.col("ticker").alias("ticker_y"), F.col("sector").alias("found")).distinct()
    return p.sector_pairs(prices).drop("sector").join(known, "ticker_y", "left").select("pair", "ticker_y", "ticker_x", F.coalesce("found", F.lit("Unknown")).alias("sector"))


@query("s5_read_log", log.READ_SQL, ctes="")
def s5(spark, sf_dir):
    return log.read_log(log.raw_lines(p.table(spark, sf_dir, "events")))


@query("s6_repair_log", log.REPAIR_SQL, ctes="")
def s6(spark, sf_dir):
    return log.repair_log(log.raw_lines(p.table(spark, sf_dir, "events")))


@query("s8_save_results", "SELECT pair, date, z FROM spine WHERE z > 2")
def s8(spark, sf_dir):
    """Saved by pair, appended to, and read back."""
    from covary.sources.sinks import append_table, results_dir

    found = spine(spark, sf_dir).filter("z > 2").select("pair", "date", "z")
    path = results_dir(spark, "extremes")
    append_table(found.filter("date < '1998-01-01'"), path, ["pair"])
    append_table(found.filter("date >= '1998-01-01'"), path, ["pair"])
    return spark.read.parquet(path).select("pair", "date", "z")


@query("s9_state_json", "SELECT sector, max(date) AS as_of, list_sort(list(DISTINCT ticker)) AS active FROM prices GROUP BY 1")
def s9(spark, sf_dir):
    state = p.week_prices(spark, sf_dir).groupBy("sector").agg(F.max("date").alias("as_of"), F.array_sort(F.collect_set("ticker")).alias("active"))
    text = state.select("sector", F.to_json(F.struct("as_of", "active")).alias("state"))
    back = F.from_json("state", "as_of date, active array<string>")
    return text.select("sector", back["as_of"].alias("as_of"), back["active"].alias("active"))


@query("s10_json_export", "SELECT pair, '{\"sector\":\"' || sector || '\",\"n\":' || count(*) || '}' AS record FROM panel GROUP BY pair, sector")
def s10(spark, sf_dir):
    n = p.week_panel(spark, sf_dir).groupBy("pair", "sector").agg(F.count(F.lit(1)).alias("n"))
    return n.select("pair", F.to_json(F.struct("sector", "n")).alias("record"))


# joins ---------------------------------------------------------------------------------------------------------------


@query("j1_align", "SELECT pair, date, t, y, x, m FROM panel")
def j1(spark, sf_dir):
    return p.week_panel(spark, sf_dir).select("pair", "date", "t", "y", "x", "m")


@query("j2_sector_pairs", "SELECT * FROM pairs")
def j2(spark, sf_dir):
    return p.sector_pairs(p.week_prices(spark, sf_dir))


GRID = [(e, q) for e in (1.0, 1.5, 2.0) for q in (0.3, 0.5, 1.5)]
_GRID_SQL = ", ".join(f"({e}, {q})" for e, q in GRID)


@query("j3_parameter_grid", f"SELECT pair, e::DOUBLE AS entry_z, q::DOUBLE AS exit_z FROM pairs CROSS JOIN (VALUES {_GRID_SQL}) g(e, q) WHERE q < e")
def j3(spark, sf_dir):
    """Every pair with every setting whose exit lies below its entry; the grid is small and broadcast."""
    grid = spark.createDataFrame(GRID, "entry_z double, exit_z double").filter("exit_z < entry_z")
    return p.sector_pairs(p.week_prices(spark, sf_dir)).select("pair").join(F.broadcast(grid))


@query("f6_sweep_prune", f"SELECT e::DOUBLE AS entry_z, q::DOUBLE AS exit_z, count(*)::BIGINT AS n FROM spine CROSS JOIN (VALUES {_GRID_SQL}) g(e, q) WHERE q < e AND abs(z) > e GROUP BY ALL")
def f6(spark, sf_dir):
    grid = spark.createDataFrame(GRID, "entry_z double, exit_z double").filter("exit_z < entry_z")
    return spine(spark, sf_dir).join(F.broadcast(grid), F.abs("z") > F.col("entry_z")).groupBy("entry_z", "exit_z").agg(F.count(F.lit(1)).alias("n"))


@query("j4_outer_merge", "SELECT pair, date, max(CASE WHEN t % 3 = 0 THEN z END) AS a, max(CASE WHEN t % 4 = 0 THEN vol END) AS b FROM spine WHERE t % 3 = 0 OR t % 4 = 0 GROUP BY ALL")
def j4(spark, sf_dir):
    s = spine(spark, sf_dir).select("pair", "date", "t", "z", "vol")
    return s.filter("t % 3 = 0").select("pair", "date", F.col("z").alias("a")).join(s.filter("t % 4 = 0").select("pair", "date", F.col("vol").alias("b")), ["pair", "date"], "full")


@query("j5_outer_fill", "SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(n, 0)::BIGINT AS n, coalesce(k, 0)::BIGINT AS k FROM (SELECT ticker, count(*) AS n FROM prices WHERE close > 60000 GROUP BY 1) a FULL JOIN (SELECT ticker, count(*) AS k FROM prices WHERE close < 15000 GROUP BY 1) b USING (ticker)")
def j5(spark, sf_dir):
    prices = p.week_prices(spark, sf_dir)
    high, low = prices.filter("close > 60000").groupBy("ticker").agg(F.count(F.lit(1)).alias("n")), prices.filter("close < 15000").groupBy("ticker").agg(F.count(F.lit(1)).alias("k"))
    return high.join(low, "ticker", "full").na.fill(0, ["n", "k"])


@query("j6_asof", "SELECT a.pair, a.t, b.z AS last_z FROM spine a ASOF LEFT JOIN (SELECT pair, t, z FROM spine WHERE t % 5 = 0) b ON a.pair = b.pair AND a.t >= b.t")
def j6(spark, sf_dir):
    s = spine(spark, sf_dir).select("pair", "t", "z")
    return j.asof_join(s.select("pair", "t"), s.filter("t % 5 = 0"), "t", ["pair"], ["z"]).withColumnRenamed("z", "last_z")


@query("j7_lookup_default", "SELECT ticker, CASE WHEN ticker LIKE '%1%' THEN sector ELSE 'Unknown' END AS sector, count(*)::BIGINT AS n FROM prices GROUP BY ALL")
def j7(spark, sf_dir):
    prices = p.week_prices(spark, sf_dir)
    known = prices.filter(F.col("ticker").contains("1")).select("ticker", F.col("sector").alias("found")).distinct()
    return prices.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).join(known, "ticker", "left").select("ticker", F.coalesce("found", F.lit("Unknown")).alias("sector"), "n")


@query("j8_semi", "SELECT pair, count(*)::BIGINT AS n FROM panel WHERE pair IN (SELECT pair FROM spine WHERE z > 2.9) GROUP BY 1")
def j8(spark, sf_dir):
    hot = spine(spark, sf_dir).filter("z > 2.9").select("pair").distinct()
    return p.week_panel(spark, sf_dir).join(hot, "pair", "left_semi").groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


_OLD, _NEW = "SELECT pair FROM spine WHERE t < 100 AND z > 2.8", "SELECT pair FROM spine WHERE t >= 250 AND z > 2.8"


@query("j9_rotated", f"SELECT DISTINCT pair, 'out' AS side FROM ({_OLD}) WHERE pair NOT IN ({_NEW}) UNION ALL SELECT DISTINCT pair, 'in' FROM ({_NEW}) WHERE pair NOT IN ({_OLD})")
def j9(spark, sf_dir):
    s = spine(spark, sf_dir).filter("z > 2.8")
    old, new = s.filter("t < 100").select("pair").distinct(), s.filter("t >= 250").select("pair").distinct()
    return old.join(new, "pair", "left_anti").withColumn("side", F.lit("out")).unionByName(new.join(old, "pair", "left_anti").withColumn("side", F.lit("in")))


_PERIODS_SQL = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in j.PERIODS)


@query("j11_periods", f"SELECT name, pair, count(*)::BIGINT AS days, round(avg(ry), 6) AS mean_ry FROM spine JOIN (VALUES {_PERIODS_SQL}) c(name, a, b) ON date BETWEEN a AND b GROUP BY ALL")
def j11(spark, sf_dir):
    return j.in_periods(spine(spark, sf_dir), j.periods(spark)).groupBy("name", "pair").agg(F.count(F.lit(1)).alias("days"), r6(F.avg("ry")).alias("mean_ry"))


@query("j12_folds", "SELECT f::INT AS fold, pair, count(*) FILTER (t < 504 + 63 * f)::BIGINT AS train_rows, count(*) FILTER (t >= 504 + 63 * f)::BIGINT AS test_rows FROM dpanel JOIN range(32) r(f) ON t <= 504 + 63 * f + 125 WHERE 504 + 63 * f + 126 <= 2600 GROUP BY ALL", ctes=None)
def j12(spark, sf_dir):
    """Rows fan out to every fold that holds them; the folds are few and broadcast."""
    folds = j.walk_forward_folds(spark, 2600)
    rows = p.day_panel(spark, sf_dir).select("pair", "t").join(F.broadcast(folds), F.col("t") <= F.col("test_end_t"))
    return rows.groupBy("fold", "pair").agg(F.count_if(F.col("t") <= F.col("train_end_t")).alias("train_rows"), F.count_if(F.col("t") >= F.col("test_start_t")).alias("test_rows"))


@query("j14_zip", "SELECT a.t, round(a.ry - b.ry, 6) AS d FROM spine a JOIN spine b ON a.t = b.t WHERE a.pair = (SELECT min(pair) FROM pairs) AND b.pair = (SELECT max(pair) FROM pairs)")
def j14(spark, sf_dir):
    """Two series zipped by position, cut to the shorter."""
    s = spine(spark, sf_dir)
    ends = s.agg(F.min("pair").alias("lo"), F.max("pair").alias("hi"))
    a = s.join(F.broadcast(ends), F.col("pair") == F.col("lo")).select("t", F.col("ry").alias("a"))
    b = s.join(F.broadcast(ends), F.col("pair") == F.col("hi")).select("t", F.col("ry").alias("b"))
    return a.join(b, "t").select("t", r6(F.col("a") - F.col("b")).alias("d"))


# aggregates ----------------------------------------------------------------------------------------------------------


@query("a1_summary", "SELECT pair, count(z)::BIGINT AS n, round(sum(z), 4) AS total, round(avg(z), 8) AS mean, round(stddev_samp(z), 5) AS std, min(z) AS low, max(z) AS high, round(median(z), 8) AS middle FROM spine GROUP BY 1")
def a1(spark, sf_dir):
    return spine(spark, sf_dir).groupBy("pair").agg(F.count("z").alias("n"), F.round(F.sum("z"), 4).alias("total"), F.round(F.avg("z"), 8).alias("mean"), F.round(F.stddev_samp("z"), 5).alias("std"), F.min("z").alias("low"), F.max("z").alias("high"), F.round(F.median("z"), 8).alias("middle"))


@query("a2_multi_agg", "SELECT sector, round(avg(z), 5) AS z_mean, round(stddev_samp(z), 5) AS z_std, round(avg(vol), 5) AS vol_mean, round(max(vol), 5) AS vol_max FROM spine GROUP BY 1")
def a2(spark, sf_dir):
    return spine(spark, sf_dir).groupBy("sector").agg(F.round(F.avg("z"), 5).alias("z_mean"), F.round(F.stddev_samp("z"), 5).alias("z_std"), F.round(F.avg("vol"), 5).alias("vol_mean"), F.round(F.max("vol"), 5).alias("vol_max"))


@query("a3_compound", "SELECT pair, round(product(1 + ry / 100) - 1, 6) AS total FROM spine GROUP BY 1")
def a3(spark, sf_dir):
    return spine(spark, sf_dir).groupBy("pair").agg(r6(x.compound(F.col("ry") / 100)).alias("total"))


@query("a4_value_counts", "SELECT pair, regime, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pair), 6) AS share FROM spine GROUP BY 1, 2")
def a4(spark, sf_dir):
    n = spine(spark, sf_dir).groupBy("pair", "regime").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("pair"))))


@query("a5_rates", "SELECT pair, count(*) FILTER (ry > 0)::BIGINT AS ups, round(avg((z > 0)::INT), 6) AS above, round(avg((abs(z) > 1.5)::INT), 6) AS wide FROM spine GROUP BY 1")
def a5(spark, sf_dir):
    return spine(spark, sf_dir).groupBy("pair").agg(F.count_if(F.col("ry") > 0).alias("ups"), r6(F.avg((F.col("z") > 0).cast("int"))).alias("above"), r6(F.avg((F.abs("z") > 1.5).cast("int"))).alias("wide"))


@query("a6_distinct", "SELECT sector, count(DISTINCT date)::BIGINT AS dates, count(DISTINCT pair)::BIGINT AS pairs FROM panel GROUP BY 1")
def a6(spark, sf_dir):
    return p.week_panel(spark, sf_dir).groupBy("sector").agg(F.countDistinct("date").alias("dates"), F.countDistinct("pair").alias("pairs"))


@query("a7_arg_extremes", "SELECT sector, arg_max(pair, (z, pair)) AS best, arg_min(pair, (z, pair)) AS worst FROM spine WHERE z IS NOT NULL GROUP BY 1")
def a7(spark, sf_dir):
    key = F.struct("z", "pair")
    return spine(spark, sf_dir).filter("z is not null").groupBy("sector").agg(F.max_by("pair", key).alias("best"), F.min_by("pair", key).alias("worst"))


@query("a8_percentiles", "SELECT pair, round(quantile_cont(z, 0.025), 9) AS low, round(quantile_cont(z, 0.975), 9) AS high FROM spine GROUP BY 1")
def a8(spark, sf_dir):
    return spine(spark, sf_dir).groupBy("pair").agg(F.round(F.percentile("z", 0.025), 9).alias("low"), F.round(F.percentile("z", 0.975), 9).alias("high"))


@query("a9_correlation", "SELECT pair, round(corr(y, x), 6) AS r FROM panel GROUP BY 1")
def a9(spark, sf_dir):
    return p.week_panel(spark, sf_dir).groupBy("pair").agg(r6(F.corr("y", "x")).alias("r"))


@query("a10_spearman", "SELECT pair, round(corr(a, b), 6) AS rho FROM (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0 AS b FROM panel) GROUP BY 1")
def a10(spark, sf_dir):
    rank = lambda c: F.rank().over(Window.partitionBy("pair").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("pair", c)) - 1) / 2.0
    return p.week_panel(spark, sf_dir).select("pair", rank("y").alias("a"), rank("x").alias("b")).groupBy("pair").agg(r6(F.corr("a", "b")).alias("rho"))


@query("a11_shape", "SELECT pair, round(skewness(ry), 5) AS skew, round(kurtosis(ry), 5) AS kurt FROM spine GROUP BY 1")
def a11(spark, sf_dir):
    n = F.count("ry")
    skew = F.skewness("ry") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("ry") + 6)
    return spine(spark, sf_dir).groupBy("pair").agg(F.round(skew, 5).alias("skew"), F.round(kurt, 5).alias("kurt"))


@query("a12_least_squares", "SELECT pair, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 3) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM panel GROUP BY 1")
def a12(spark, sf_dir):
    return p.week_panel(spark, sf_dir).groupBy("pair").agg(r6(F.regr_slope("y", "x")).alias("slope"), F.round(F.regr_intercept("y", "x"), 3).alias("intercept"), r6(F.regr_r2("y", "x")).alias("r2"))


@query("a13_daily_activity", "SELECT date, count(*) FILTER (abs(z) > 1.5)::BIGINT AS active, round(avg(abs(z)), 9) AS mean_z FROM spine GROUP BY 1")
def a13(spark, sf_dir):
    return spine(spark, sf_dir).groupBy("date").agg(F.count_if(F.abs("z") > 1.5).alias("active"), F.round(F.avg(F.abs("z")), 9).alias("mean_z"))


_SIG = "CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 ELSE 0 END"


@query("a14_pair_monitor", f"SELECT pair, count(*)::BIGINT AS n, count(*) FILTER (s <> 0)::BIGINT AS active, round(avg(abs(z)), 6) AS mean_z, round(max(abs(z)), 6) AS max_z, max(date) AS last_date, arg_max(s, date)::INT AS last_signal FROM (SELECT *, {_SIG} AS s FROM spine WHERE z IS NOT NULL) GROUP BY 1")
def a14(spark, sf_dir):
    s = spine(spark, sf_dir).filter("z is not null").withColumn("s", F.expr(_SIG))
    return s.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") != 0).alias("active"), r6(F.avg(F.abs("z"))).alias("mean_z"), r6(F.max(F.abs("z"))).alias("max_z"), F.max("date").alias("last_date"), F.max_by("s", "date").alias("last_signal"))


_MONITOR = "count(*)::BIGINT AS n, count(DISTINCT date)::BIGINT AS days, round(100 * avg((s = 1)::INT), 4) AS long_pct, round(100 * avg((s = -1)::INT), 4) AS short_pct, round(100 * avg((s = 0)::INT), 4) AS flat_pct, round(avg(abs(z)), 6) AS mean_z, round(100 * avg((abs(z) > 2)::INT), 4) AS sure_pct"


def _monitor(df):
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 4)
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("days"), share(F.col("s") == 1).alias("long_pct"), share(F.col("s") == -1).alias("short_pct"), share(F.col("s") == 0).alias("flat_pct"), r6(F.avg(F.abs("z"))).alias("mean_z"), share(F.abs("z") > 2).alias("sure_pct"))


@query("a15_log_monitor", f"SELECT {_MONITOR} FROM (SELECT *, {_SIG} AS s FROM spine WHERE z IS NOT NULL)")
def a15(spark, sf_dir):
    return _monitor(spine(spark, sf_dir).filter("z is not null").withColumn("s", F.expr(_SIG)))


@query("a16_alerts", f"SELECT sector, {mo.alerts_sql()} AS alerts FROM (SELECT *, round(n / greatest(days, 1), 4) AS per_day FROM (SELECT sector, {mo.MEASURES_SQL} FROM (SELECT *, {_SIG} AS signal FROM spine WHERE z IS NOT NULL) GROUP BY 1))")
def a16(spark, sf_dir):
    """The alerts of all eight rules by sector."""
    s = spine(spark, sf_dir).filter("z is not null").withColumn("signal", F.expr(_SIG))
    return s.groupBy("sector").agg(*mo.measures()).withColumn("per_day", mo.per_day()).select("sector", mo.alerts().alias("alerts"))


@query("a17_pivot", "SELECT sector, count(*) FILTER (regime = 0)::BIGINT AS r0, count(*) FILTER (regime = 1)::BIGINT AS r1, count(*) FILTER (regime = 2)::BIGINT AS r2 FROM spine GROUP BY 1")
def a17(spark, sf_dir):
    made = spine(spark, sf_dir).groupBy("sector").pivot("regime", [0, 1, 2]).agg(F.count(F.lit(1)))
    return made.select("sector", *[F.coalesce(str(k), F.lit(0)).cast("bigint").alias(f"r{k}") for k in range(3)])


@query("a18_win_rate", "SELECT a.sector, round(avg((a.v > b.v)::INT), 6) AS rate FROM (SELECT sector, pair, avg(ry) v FROM spine GROUP BY ALL) a JOIN (SELECT pair, avg(rx) v FROM spine GROUP BY 1) b USING (pair) GROUP BY 1")
def a18(spark, sf_dir):
    s = spine(spark, sf_dir)
    a, b = s.groupBy("sector", "pair").agg(F.avg("ry").alias("v")), s.groupBy("pair").agg(F.avg("rx").alias("u"))
    return a.join(b, "pair").groupBy("sector").agg(r6(F.avg((F.col("v") > F.col("u")).cast("int"))).alias("rate"))


@query("a20_stability", "SELECT pair, round(0.3 * avg((abs(z) < 2)::INT) + 0.3 * (1 - avg((abs(z) > 1)::INT)) + 0.2 * avg((z > 0)::INT) + 0.2 * avg((regime = 2)::INT), 6) AS score FROM spine WHERE z IS NOT NULL GROUP BY 1")
def a20(spark, sf_dir):
    share = lambda c: F.avg(c.cast("int"))
    z = F.col("z")
    score = 0.3 * share(F.abs(z) < 2) + 0.3 * (1 - share(F.abs(z) > 1)) + 0.2 * share(z > 0) + 0.2 * share(F.col("regime") == 2)
    return spine(spark, sf_dir).filter("z is not null").groupBy("pair").agg(r6(score).alias("score"))


@query("a21_rollup", "SELECT sector, pair, count(*)::BIGINT AS n, round(avg(z), 5) AS mean_z FROM spine GROUP BY ROLLUP (sector, pair)")
def a21(spark, sf_dir):
    return spine(spark, sf_dir).rollup("sector", "pair").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z"), 5).alias("mean_z"))


# windows -------------------------------------------------------------------------------------------------------------


def _rolled(agg, col, n, least=None):
    least = n if least is None else least
    return f"CASE WHEN count({col}) OVER {R(n)} >= {least} THEN {agg}({col}) OVER {R(n)} END"


_columns("w1_rolling_std", {f"sd_{n}": (lambda n=n: r6(x.rolling(F.stddev_samp, "rm", x.pair_window(), n)), f"round({_rolled('stddev_samp', 'rm', n)}, 6)") for n in (5, 10, 20, 40, 60)})
_columns("w2_rolling_mean", {f"mean_{n}": (lambda n=n: F.round(x.rolling(F.avg, "m", x.pair_window(), n), 7), f"round({_rolled('avg', 'm', n)}, 7)") for n in (20, 50, 60)})
_columns("w3_rolling_extremes", {"high": (lambda: x.rolling(F.max, "m", x.pair_window(), 20, 1), f"max(m) OVER {R(20)}"), "low": (lambda: x.rolling(F.min, "m", x.pair_window(), 20), _rolled("min", "m", 20))})
_columns("w4_rolling_corr", {"r": (lambda: r6(x.rolling(F.corr, ["y", "x"], x.pair_window(), 30)), f"round(CASE WHEN count(*) OVER {R(30)} >= 30 THEN corr(y, x) OVER {R(30)} END, 6)")})
_columns("w5_rolling_sum", {"total": (lambda: r6(x.rolling(F.sum, "rm", x.pair_window(), 20)), f"round({_rolled('sum', 'rm', 20)}, 6)")})
_E = "(PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING)"
_columns("w6_expanding", {"high": (lambda: x.expanding(F.max, "y", x.pair_window()), f"max(y) OVER {_E}"), "mean": (lambda: F.round(x.expanding(F.avg, "rm", x.pair_window(), 10), 8), f"round(CASE WHEN count(rm) OVER {_E} >= 10 THEN avg(rm) OVER {_E} END, 8)")})
_columns("w7_equity", {"equity": (lambda: r6(F.product(1 + F.col("ry") / 100).over(x.pair_window().rowsBetween(Window.unboundedPreceding, 0))), f"round(product(1 + ry / 100) OVER {_E}, 6)")})
_columns("w10_zscore", {"z40": (lambda: F.round(x.zscore("spread", x.pair_window(), 40), 5), f"round(CASE WHEN count(*) OVER (PARTITION BY pair) < 40 THEN CASE WHEN count(*) OVER {_E} >= 10 THEN (spread - avg(spread) OVER {_E}) / (stddev_samp(spread) OVER {_E} + 1e-8) END WHEN count(*) OVER {R(40)} >= 40 THEN (spread - avg(spread) OVER {R(40)}) / (stddev_samp(spread) OVER {R(40)} + 1e-8) END, 5)")})
_columns("w11_multi_zscore", {f"z{n}": (lambda n=n: F.round(x.zscore("spread", x.pair_window(), n), 5), f"round(CASE WHEN count(*) OVER {R(n)} >= {n} THEN (spread - avg(spread) OVER {R(n)}) / (stddev_samp(spread) OVER {R(n)} + 1e-8) END, 5)") for n in (30, 60, 90)})
_columns("w13_mean_before", {"mean5": (lambda: r6(x.rolling(F.avg, "z", x.pair_window(), 5, before=True)), f"round(CASE WHEN count(z) OVER {R(5, True)} >= 5 THEN avg(z) OVER {R(5, True)} END, 6)")})
_columns("w15_sampled", {"every5": (lambda: x.ffill(F.when(F.col("t") % 5 == 0, F.col("z")), x.pair_window()), f"last_value(CASE WHEN t % 5 = 0 THEN z END IGNORE NULLS) OVER {_E}")})


@query("w8_average_rank", "SELECT sector, pair, rank() OVER (PARTITION BY sector ORDER BY n DESC) + (count(*) OVER (PARTITION BY sector, n) - 1) / 2.0 AS rank FROM (SELECT sector, pair, count(*) AS n FROM panel GROUP BY ALL)")
def w8(spark, sf_dir):
    n = p.week_panel(spark, sf_dir).groupBy("sector", "pair").agg(F.count(F.lit(1)).alias("n"))
    rank = F.rank().over(Window.partitionBy("sector").orderBy(F.desc("n"))) + (F.count(F.lit(1)).over(Window.partitionBy("sector", "n")) - 1) / 2.0
    return n.select("sector", "pair", rank.alias("rank"))


@query("w9_row_rank", "SELECT pair, row_number() OVER (ORDER BY n DESC, pair)::INT AS place FROM (SELECT pair, count(*) AS n FROM panel GROUP BY 1)")
def w9(spark, sf_dir):
    n = p.week_panel(spark, sf_dir).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return n.select("pair", F.row_number().over(Window.orderBy(F.desc("n"), "pair")).alias("place"))


@query("w12_drawdown", f"SELECT pair, round(min(e / pk - 1), 5) AS max_drawdown FROM (SELECT pair, e, max(e) OVER {_E} AS pk FROM (SELECT pair, t, product(1 + ry / 100) OVER {_E} AS e FROM spine)) GROUP BY 1")
def w12(spark, sf_dir):
    grow = x.pair_window().rowsBetween(Window.unboundedPreceding, 0)
    s = spine(spark, sf_dir).withColumn("e", F.product(1 + F.col("ry") / 100).over(grow)).withColumn("pk", F.max("e").over(grow))
    return s.groupBy("pair").agg(F.round(F.min(F.col("e") / F.col("pk") - 1), 5).alias("max_drawdown"))


@query("w16_recent_share", "SELECT pair, round(avg((abs(z) < 1)::INT), 6) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t DESC) AS k FROM spine) WHERE k <= 63 GROUP BY 1")
def w16(spark, sf_dir):
    s = spine(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("t")))).filter("k <= 63")
    return s.groupBy("pair").agg(r6(F.avg((F.abs("z") < 1).cast("int"))).alias("recent"))


# order and sets ------------------------------------------------------------------------------------------------------

_R2 = "(SELECT sector, pair, round(corr(y, x), 6) AS score FROM panel GROUP BY ALL)"


def _scores(spark, sf_dir):
    return p.week_panel(spark, sf_dir).groupBy("sector", "pair").agg(r6(F.corr("y", "x")).alias("score"))


@query("o1_top_per_group", f"SELECT sector, pair, score FROM {_R2} QUALIFY row_number() OVER (PARTITION BY sector ORDER BY score DESC, pair) <= 3")
def o1(spark, sf_dir):
    best = Window.partitionBy("sector").orderBy(F.desc("score"), "pair")
    return _scores(spark, sf_dir).withColumn("k", F.row_number().over(best)).filter("k <= 3").drop("k")


@query("o2_top_n", f"SELECT pair, score FROM {_R2} ORDER BY score DESC, pair LIMIT 10")
def o2(spark, sf_dir):
    return _scores(spark, sf_dir).select("pair", "score").orderBy(F.desc("score"), "pair").limit(10)


@query("o3_two_key_rank", f"SELECT pair, row_number() OVER (ORDER BY abs(score) < 0.1 DESC, score DESC, pair)::INT AS place FROM {_R2}")
def o3(spark, sf_dir):
    return _scores(spark, sf_dir).select("pair", F.row_number().over(Window.orderBy((F.abs("score") < 0.1).desc(), F.desc("score"), "pair")).alias("place"))


@query("o4_top_with_fallback", f"SELECT pair, score, strict FROM (SELECT *, score > 0.9 AS strict, max(score) OVER () > 0.9 AS any_strict FROM {_R2}) WHERE CASE WHEN any_strict THEN strict ELSE score > 0 END QUALIFY row_number() OVER (ORDER BY score DESC, pair) <= 5")
def o4(spark, sf_dir):
    """The best of those that meet the strict rule; the relaxed rule where none does."""
    s = _scores(spark, sf_dir).withColumn("strict", F.col("score") > 0.9)
    any_strict = s.agg(F.max("strict").alias("any_strict"))
    held = s.join(F.broadcast(any_strict)).filter(F.when(F.col("any_strict"), F.col("strict")).otherwise(F.col("score") > 0))
    return held.orderBy(F.desc("score"), "pair").limit(5).select("pair", "score", "strict")


@query("o5_tiers", f"SELECT CASE WHEN score >= 0.1 THEN 'high' WHEN score >= 0 THEN 'middle' ELSE 'low' END AS tier, count(*)::BIGINT AS n FROM {_R2} GROUP BY 1")
def o5(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy(F.when(F.col("score") >= 0.1, "high").when(F.col("score") >= 0, "middle").otherwise("low").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("u1_union", "SELECT pair, 'wide' AS kind, count(*)::BIGINT AS n FROM spine WHERE abs(z) > 2 GROUP BY 1 UNION ALL SELECT pair, 'near', count(*)::BIGINT FROM spine WHERE abs(z) < 0.5 GROUP BY 1")
def u1(spark, sf_dir):
    s = spine(spark, sf_dir)
    part = lambda c, k: s.filter(c).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k))
    return part(F.abs("z") > 2, "wide").unionByName(part(F.abs("z") < 0.5, "near"))


@query("u2_difference", "SELECT pair, date FROM spine WHERE z > 1 EXCEPT SELECT pair, date FROM spine WHERE vol > 0.25")
def u2(spark, sf_dir):
    s = spine(spark, sf_dir)
    return s.filter("z > 1").select("pair", "date").exceptAll(s.filter("vol > 0.25").select("pair", "date"))


@query("u3_intersection", "SELECT date FROM prices WHERE ticker = 'NATION_1' INTERSECT SELECT date FROM prices WHERE ticker = 'NATION_2'")
def u3(spark, sf_dir):
    prices = p.week_prices(spark, sf_dir)
    return prices.filter("ticker = 'NATION_1'").select("date").intersect(prices.filter("ticker = 'NATION_2'").select("date"))


@query("u4_distinct", "SELECT DISTINCT sector, regime FROM spine")
def u4(spark, sf_dir):
    return spine(spark, sf_dir).select("sector", "regime").distinct()


@query("r10_naive_spread", "SELECT pair, t, round(y - first_value(y) OVER (PARTITION BY pair ORDER BY t) / first_value(x) OVER (PARTITION BY pair ORDER BY t) * x, 4) AS naive FROM panel")
def r10(spark, sf_dir):
    return naive_spread(p.week_panel(spark, sf_dir)).select("pair", "t", F.round("naive", 4).alias("naive"))
