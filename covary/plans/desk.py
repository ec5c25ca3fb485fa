"""The desk: order intents and positions, logs on disk, lag-selected tests, signed ranks and loss comparisons over the systems."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from covary.operators import diagnostics as d
from covary.operators import orders as o
from covary.operators import ranks
from covary.operators import unitroot as u
from covary.operators.systems import System
from covary.plans.base import query, spine
from covary.plans.research import pair_scores
from covary.plans.scalar import r6
from covary.plans.systems import b19, run_systems, systems_sql
from covary.sources import panel as p
from covary.sources import tradelog as log
from covary.sources.sinks import results_dir, written

FULL, ACCOUNT = System("full"), o.Account()

# order intents -------------------------------------------------------------------------------------------------------------

_ORDERS = systems_sql([FULL]) + f""", ord AS (SELECT m.pair, m.t, m.pos AS signal, z.z, s.date, s.y, s.x, z.hedge, abs(z.z) / 1.5 AS confidence FROM m_0 m JOIN z_0 z USING (pair, t) JOIN spine s USING (pair, t)),
{o.intents_sql("ol", "ord", ACCOUNT)}
"""


def order_log(spark, sf_dir):
    """Every row's intent of the full system: what it orders of both legs and what is held after it."""
    s = run_systems(spark, sf_dir, [FULL]).select("pair", "date", "t", "y", "x", "signal", "z", "hedge", "regime", o.confidence(F.col("z")).alias("confidence"))
    return o.intents(s, ACCOUNT)


@query("d14_order_log", _ORDERS + "SELECT pair, t, action, oy AS order_y, ox AS order_x, qy AS qty_y, qx AS qty_x FROM ol WHERE t >= 0")
def d14(spark, sf_dir):
    """Order intents of every pair and row: exits close both legs, entries add a step by confidence within what is left of the pair's share, in whole units."""
    return order_log(spark, sf_dir).select("pair", "t", "action", "order_y", "order_x", "qty_y", "qty_x")


@query("j13_desk", _ORDERS + f""", lst AS (SELECT pair, arg_max(l.t, l.t) AS t, arg_max(action, l.t) AS action, arg_max(signal, l.t)::INT AS signal, arg_max(ord.z, l.t) AS z, arg_max(qy, l.t) AS qy, arg_max(qx, l.t) AS qx FROM ol l JOIN ord USING (pair, t) WHERE ord.z IS NOT NULL GROUP BY 1),
legs AS (SELECT symbol, sum(q)::BIGINT AS held FROM (SELECT string_split(pair, '/')[1] AS symbol, qy AS q FROM lst UNION ALL SELECT string_split(pair, '/')[2], qx FROM lst) GROUP BY 1 HAVING sum(q) <> 0),
px AS (SELECT ticker AS symbol, arg_max(close, date) AS price FROM prices GROUP BY 1)
SELECT pair, action, signal, z, coalesce(a.held, 0) AS held_y, coalesce(b.held, 0) AS held_x, round(p.price, 4) AS price_y, round(q.price, 4) AS price_x, round(abs(qy * p.price) + abs(qx * q.price), 2) AS value, round((abs(qy * p.price) + abs(qx * q.price)) / {ACCOUNT.value}, 8) AS share
FROM lst LEFT JOIN legs a ON a.symbol = string_split(pair, '/')[1] LEFT JOIN legs b ON b.symbol = string_split(pair, '/')[2] JOIN px p ON p.symbol = string_split(pair, '/')[1] JOIN px q ON q.symbol = string_split(pair, '/')[2]""")
def j13(spark, sf_dir):
    """Latest signals with the account's positions by symbol (a symbol without one: 0), the latest price of each symbol, and the pair's share of the account."""
    last = order_log(spark, sf_dir).filter("z is not null").groupBy("pair").agg(F.max_by(F.struct("action", "signal", "z", "qty_y", "qty_x"), "t").alias("v")).select("pair", "v.*")
    last = written(last.withColumn("ticker_y", F.split_part("pair", F.lit("/"), F.lit(1))).withColumn("ticker_x", F.split_part("pair", F.lit("/"), F.lit(2))), "latest")
    legs = last.select(F.explode(F.array(F.struct(F.col("ticker_y").alias("symbol"), F.col("qty_y").alias("q")), F.struct(F.col("ticker_x").alias("symbol"), F.col("qty_x").alias("q")))).alias("v"))
    held = legs.groupBy("v.symbol").agg(F.sum("v.q").alias("held")).filter("held <> 0")
    price = p.week_prices(spark, sf_dir).groupBy(F.col("ticker").alias("symbol")).agg(F.max_by("close", "date").alias("price"))
    side = lambda df, c, leg: df.select(F.col("symbol").alias(f"ticker_{leg}"), F.col(c).alias(f"{c}_{leg}"))
    out = last
    for leg in ("y", "x"):
        out = out.join(side(held, "held", leg), f"ticker_{leg}", "left").join(side(price, "price", leg), f"ticker_{leg}")
    value = o.held_value("qty_y", "price_y", "qty_x", "price_x")
    return out.select(
        "pair", "action", "signal", "z", *[F.coalesce(f"held_{k}", F.lit(0)).alias(f"held_{k}") for k in "yx"], *[F.round(f"price_{k}", 4).alias(f"price_{k}") for k in "yx"],
        F.round(value, 2).alias("value"), F.round(value / ACCOUNT.value, 8).alias("share"),
    )


# logs on disk --------------------------------------------------------------------------------------------------------------

_PLAIN = "{ts} || ',' || event_type || ',' || CAST(event_id % 3 - 1 AS {s}) || ',' || CAST(event_id % 40 AS {s}) || ',calm,' || CAST(event_id % 10 AS {s}) || ',' || CAST(event_id % 100 AS {s}) || ',' || CAST(-(event_id % 50) AS {s}) || ',' || CAST(event_id % 1000 AS {s}) || ',' || CAST(event_id % 900 AS {s}) || ',' || CAST(event_id % 7 AS {s})"
_QUOTED = _PLAIN.replace("{ts}", "'\"' || {ts} || '\"'").replace("',' || event_type || ','", "', \" ' || event_type || ' \",'").replace("',calm,'", "',\"calm, or so\",'") + " || ',1,2,3,\"four, five\",6'"
# every sort of line that such logs have: repeated headers, unreadable times, short lines, quoted ones of 16 fields, unreadable numbers
_DISK = f"""CASE WHEN event_id % 50 = 0 THEN '{",".join(n for n, _ in log.FIELDS)}' WHEN event_id % 17 = 0 THEN 'soon,' || event_type || ',1,2,calm,1,1,1,1,1,1' WHEN event_id % 13 = 0 THEN {{ts}} || ',' || event_type || ',1,2,calm,3'
  WHEN event_id % 7 = 0 THEN {_QUOTED} WHEN event_id % 11 = 0 THEN {{ts}} || ',' || event_type || ',1,oops,calm,1,1,1,1,1,1' ELSE {_PLAIN} END"""
_GOOD = "event_id % 50 <> 0 AND event_id % 17 <> 0 AND event_id % 13 <> 0 AND (event_id % 7 = 0 OR event_id % 11 <> 0)"


def log_on_disk(spark, sf_dir) -> str:
    """The path of a log's text files, made from the events."""
    line = _DISK.replace("{ts}", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')").replace("{s}", "STRING")
    path = results_dir(spark, "log")
    p.table(spark, sf_dir, "events").select(F.expr(line).alias("value")).write.text(path)
    return path


@query("s5_log_from_disk", f"SELECT date_trunc('second', ts)::TIMESTAMP AS timestamp, event_type AS pair, (event_id % 3 - 1)::INT AS signal, (event_id % 40)::DOUBLE AS z_score, CASE WHEN event_id % 7 = 0 THEN 'calm, or so' ELSE 'calm' END AS regime, (event_id % 10)::DOUBLE AS confidence, (event_id % 100)::DOUBLE AS qty_y, (-(event_id % 50))::DOUBLE AS qty_x, (event_id % 1000)::DOUBLE AS price_y, (event_id % 900)::DOUBLE AS price_x, (event_id % 7)::DOUBLE AS hedge_ratio FROM events WHERE {_GOOD}", ctes="")
def s5(spark, sf_dir):
    """All eleven columns of a log's good lines, read from its files."""
    return log.load_log(spark, log_on_disk(spark, sf_dir)).drop("date").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("s6_log_rewritten", f"SELECT count(*) FILTER ({_GOOD})::BIGINT AS good, count(*) FILTER (event_id % 50 <> 0 AND NOT ({_GOOD}))::BIGINT AS corrupt FROM events", ctes="")
def s6(spark, sf_dir):
    """A log rewritten to a new place, its corrupt lines beside it; the old files stay."""
    path = log_on_disk(spark, sf_dir)
    return log.rewrite_log(spark, path, path + "-clean")


# lag-selected tests --------------------------------------------------------------------------------------------------------

_ONE = """, ol0 AS (SELECT pair, t, spread - lag(spread) OVER o AS d, lag(spread) OVER o AS l FROM spine WINDOW o AS (PARTITION BY pair ORDER BY t)),
ol1 AS (SELECT *, lag(d) OVER (PARTITION BY pair ORDER BY t) AS p FROM ol0),
ol2 AS (SELECT pair, t, 124 * covar_pop(l, l) OVER w AS ll, 124 * covar_pop(p, p) OVER w AS pp, 124 * covar_pop(d, d) OVER w AS dd, 124 * covar_pop(l, p) OVER w AS lp, 124 * covar_pop(l, d) OVER w AS ld, 124 * covar_pop(p, d) OVER w AS pd,
  regr_sxx(d, l) OVER v AS sxx, regr_sxy(d, l) OVER v AS sxy, regr_syy(d, l) OVER v AS syy FROM ol1 WINDOW w AS (PARTITION BY pair ORDER BY t ROWS BETWEEN 124 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY pair ORDER BY t ROWS BETWEEN 125 PRECEDING AND 1 PRECEDING)),
ol3 AS (SELECT *, ll * pp - lp * lp AS det, (ld * pp - pd * lp) / (ll * pp - lp * lp) AS bl, (pd * ll - ld * lp) / (ll * pp - lp * lp) AS bp, dd - ld * ld / ll AS rss0 FROM ol2 WHERE t >= 126 AND t % 5 = 0),
ol4 AS (SELECT *, dd - bl * ld - bp * pd AS rss1 FROM ol3),
ol5 AS (SELECT *, 124 * ln(rss1 / 124) + 6 < 124 * ln(rss0 / 124) + 4 AS more FROM ol4)
SELECT pair, t, more::INT AS lags, round(CASE WHEN more THEN bl / sqrt(rss1 / 121 * pp / det) ELSE sxy / sxx / sqrt((syy - sxy * sxy / sxx) / 123 / sxx) END, 5) AS tau FROM ol5"""


@query("r1_rolling_one_lag", _ONE)
def r1_one(spark, sf_dir):
    """Rolling test with one lagged difference where the criterion wants it, in closed form over moments of the window; no Python runs."""
    s = u.rolling_one_lag(spine(spark, sf_dir).select("pair", "t", "spread"))
    return s.filter("t >= 126 and t % 5 = 0").select("pair", "t", "lags", F.round("tau", 5).alias("tau"))


@query("r1_r2_rolling_lagged")
def r1_r2(spark, sf_dir):
    """Rolling stationarity of the spread (up to 15 lags) and cointegration of the legs (up to 12), window 126, every fifth row."""
    got = u.rolling_lagged(spine(spark, sf_dir))
    return got.select("pair", "t", "df_lags", F.round("df_tau", 5).alias("df_tau"), F.round("df_p", 4).alias("df_p"), "eg_lags", F.round("eg_tau", 5).alias("eg_tau"), F.round("eg_p", 4).alias("eg_p"))


@query("d2_pair_score_lagged")
def d2(spark, sf_dir):
    """The pair score with lag-selected tests: one lag at most for the spread, as many as the series' length suggests for the legs."""
    return pair_scores(p.week_panel(spark, sf_dir), lagged=True).select("pair", "sector", "n", "score", F.round("hl", 5).alias("half_life"), r6("r").alias("r"))


@query("d4_rolling_health_lagged")
def d4(spark, sf_dir):
    """Rolling health with lag-selected tests in place of the unlagged ones."""
    got = d.rolling_health(spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "spread"), lagged=True)
    return got.select("pair", "t", "checks_passed", F.round("health_score", 4).alias("health_score"), "healthy")


# ranks and losses ----------------------------------------------------------------------------------------------------------


@query("t13_signed_rank_p")
def t13(spark, sf_dir):
    """Does the health gate help over all pairs? Signed ranks of shallower drawdowns and higher Sharpe ratios, gated against not."""
    g = b19(spark, sf_dir)
    kinds = F.array(F.struct(F.lit("drawdown").alias("measure"), (F.abs("unfiltered_drawdown") - F.abs("filtered_drawdown")).alias("d")), F.struct(F.lit("sharpe").alias("measure"), (F.col("filtered_sharpe") - F.col("unfiltered_sharpe")).alias("d")))
    got = ranks.signed_ranks(g.select(F.explode(kinds).alias("v")).select("v.*").withColumn("d", r6("d")), ["measure"], "d")
    return got.select("measure", "n", "stat", r6("p").alias("p"), r6("median").alias("median"))


HORIZONS = (1, 5, 10)
_DM = systems_sql([FULL]) + ", dm AS (SELECT pair, t, net * net - rm * rm AS d FROM sysbt WHERE period = 'oos' AND net IS NOT NULL AND rm IS NOT NULL), dl AS (SELECT pair, d" + "".join(f", lag(d, {k}) OVER w AS d{k}" for k in range(1, max(HORIZONS))) + " FROM dm WINDOW w AS (PARTITION BY pair ORDER BY t)), dg AS (SELECT pair, count(d) AS n, avg(d) AS m, var_samp(d) AS g0" + "".join(f", coalesce(covar_samp(d, d{k}), 0) AS g{k}" for k in range(1, max(HORIZONS))) + " FROM dl GROUP BY 1)"
_LRV = {h: ("g0" + "".join(f" + 2 * g{k}" for k in range(1, h)), "g0" + "".join(f" + 2 * {1 - k / h} * g{k}" for k in range(1, h))) for h in HORIZONS}


@query("t5_diebold_mariano_lags", _DM + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT pair, {h} AS h, n, round(m / sqrt(greatest(({a}) / n, 1e-12)), 5) AS stat, round(m / sqrt(greatest(({b_}) / n, 1e-12)), 5) AS stat_bartlett FROM dg" for h, (a, b_) in _LRV.items()) + ") WHERE n >= 10")
def t5(spark, sf_dir):
    """Squared returns of the system against the market's at several horizons: long-run variances over h - 1 lags, plain and with Bartlett's weights (which cannot turn negative)."""
    s = run_systems(spark, sf_dir, [FULL]).filter("period = 'oos' and net is not null and rm is not null").select("pair", "t", (F.col("net") * F.col("net") - F.col("rm") * F.col("rm")).alias("d"))
    return loss_comparison(s, HORIZONS).select("pair", "h", "n", F.round("stat", 5).alias("stat"), F.round("stat_bartlett", 5).alias("stat_bartlett"))


def loss_comparison(df, horizons=HORIZONS, least: int = 10):
    """(pair, h, n, stat, stat_bartlett) of a column d of loss differences, for every horizon; lags are one window, sums one aggregate."""
    w, ks = Window.partitionBy("pair").orderBy("t"), range(1, max(horizons))
    s = df.select("pair", "d", *[F.lag("d", k).over(w).alias(f"d{k}") for k in ks])
    g = s.groupBy("pair").agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.var_samp("d").alias("g0"), *[F.coalesce(F.covar_samp("d", f"d{k}"), F.lit(0.0)).alias(f"g{k}") for k in ks]).filter(F.col("n") >= least)

    def stat(h, weight):
        total = sum((2 * weight(k, h) * F.col(f"g{k}") for k in range(1, h)), F.col("g0"))
        return F.col("m") / F.sqrt(F.greatest(total / F.col("n"), F.lit(1e-12)))

    each = F.array(*[F.struct(F.lit(h).alias("h"), stat(h, lambda k, h: 1.0).alias("stat"), stat(h, lambda k, h: 1 - k / h).alias("stat_bartlett")) for h in horizons])
    return g.select("pair", "n", F.explode(each).alias("v")).select("pair", "v.h", "n", "v.stat", "v.stat_bartlett")
