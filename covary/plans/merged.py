"""Tables put together: rolling diagnostics merged and filled forward, sweeps as pivots, equity curves, zips by position, catalogues with fallbacks, snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.operators import diagnostics as d
from covary.operators.systems import System
from covary.plans.base import query, spine
from covary.plans.research import HEALTH, SCORE, pair_scores
from covary.plans.scalar import r6
from covary.plans.systems import _FILTERED, digits, digits_sql, gated_system, run_systems, systems_sql
from covary.plans.trading import SWEEP, _SWEPT, _SWEPT_ALL
from covary.plans.trading import b15 as swept
from covary.sources import panel as p
from covary.sources.sinks import written

FULL = System("full")

_LAST = "OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING)"
_MERGED = ("eg_p", "hurst", "half_life", "hedge", "df_p")


@query("j4_rolling_merge", HEALTH + f""", five AS (SELECT coalesce(a.pair, b.pair, c.pair, e.pair, f.pair) AS pair, coalesce(a.t, b.t, c.t, e.t, f.t) AS t, eg_p, hurst, half_life, hedge, df_p
  FROM (SELECT pair, t, eg_p FROM he WHERE t >= 126) a FULL JOIN (SELECT pair, t::INT AS t, hurst FROM hu) b ON b.pair = a.pair AND b.t = a.t
  FULL JOIN (SELECT pair, t, half_life FROM dg WHERE nw >= 126 AND t % 4 = 0) c ON c.pair = coalesce(a.pair, b.pair) AND c.t = coalesce(a.t, b.t)
  FULL JOIN (SELECT pair, t, b AS hedge FROM dg WHERE nw >= 126 AND t % 2 = 0) e ON e.pair = coalesce(a.pair, b.pair, c.pair) AND e.t = coalesce(a.t, b.t, c.t)
  FULL JOIN (SELECT pair, t, df_p FROM he WHERE t >= 126) f ON f.pair = coalesce(a.pair, b.pair, c.pair, e.pair) AND f.t = coalesce(a.t, b.t, c.t, e.t))
SELECT five.pair, five.t, {", ".join(f"round(last_value({c} IGNORE NULLS) {_LAST.replace('pair', 'five.pair').replace('BY t', 'BY five.t')}, 4) AS {c}" for c in _MERGED)}, CASE WHEN date <= DATE '{p.SPLIT}' THEN 'train' ELSE 'oos' END AS period FROM five JOIN spine s ON s.pair = five.pair AND s.t = five.t""")
def j4(spark, sf_dir):
    """Five rolling tables of their own steps (tests and Hurst exponents every fifth row, half-lives every fourth, hedges every second), merged on all their rows and filled forward."""
    s = written(spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "spread"), "panel")
    rolled = written(d.rolling_pairs(s).filter("t >= 126").select("pair", "t", "eg_p", "half_life", "hedge", "df_p"), "rolled")
    tables = [rolled.filter("t % 5 = 0").select("pair", "t", "eg_p"), d.rolling_hurst(s), rolled.filter("t % 4 = 0").select("pair", "t", "half_life"), rolled.filter("t % 2 = 0").select("pair", "t", "hedge"), rolled.filter("t % 5 = 0").select("pair", "t", "df_p")]
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, ["pair", "t"], "full")
    w = x.pair_window()
    out = out.withColumns({c: F.round(x.ffill(c, w), 4) for c in _MERGED})
    return out.join(s.select("pair", "t", x.mark_period("date", p.SPLIT).alias("period")), ["pair", "t"])


_ENTRIES = sorted({e for _, e, _ in SWEEP})


@query("a17_sweep_pivot", f", {_SWEPT}, every AS ({_SWEPT_ALL}), gr AS (SELECT config_id, e.pair, round(sum(r), 5) AS gross FROM (SELECT config_id, e.pair, lag(pos) OVER (PARTITION BY config_id, e.pair ORDER BY e.t) * 0.05 * (ry - beta * rx) AS r FROM every e JOIN spine s ON s.pair = e.pair AND s.t = e.t) e GROUP BY ALL), st(config_id, entry, leave) AS (VALUES {', '.join(f'({i}, {e}, {q})' for i, e, q in SWEEP)}) SELECT pair, leave::DOUBLE AS leave, " + ", ".join(f'max(gross) FILTER (entry = {e}) AS "entry_{e}"' for e in _ENTRIES) + " FROM gr JOIN st USING (config_id) GROUP BY 1, 2")
def a17(spark, sf_dir):
    """Each pair's sweep as a table: a row per exit level, a column per entry level, the result of their setting in the cell."""
    settings = F.explode(F.array(*[F.struct(F.lit(i).alias("config_id"), F.lit(e).alias("entry"), F.lit(q).alias("leave")) for i, e, q in SWEEP]))
    got = swept(spark, sf_dir)
    levels = spark.range(1).select(settings.alias("v")).select("v.*")  # a row per setting
    made = got.join(F.broadcast(levels), "config_id").groupBy("pair", "leave").pivot("entry", _ENTRIES).agg(F.first("gross"))
    return made.select("pair", "leave", *[F.col(f"`{e}`").alias(f"entry_{e}") for e in _ENTRIES])


@query("b4_equity_curves", systems_sql([FULL]) + digits_sql("SELECT pair, t, period, round(product(1 + coalesce(net, 0)) OVER w, 6) AS strategy, round(product(1 + coalesce(rm, 0)) OVER w, 6) AS market FROM sysbt WINDOW w AS (PARTITION BY pair, period ORDER BY t ROWS UNBOUNDED PRECEDING)", ("strategy", "market")))
def b4(spark, sf_dir):
    """What one unit becomes in the system and in the market, from the first row of each period."""
    w = Window.partitionBy("pair", "period").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    grown = lambda c: F.round(F.product(1 + F.coalesce(c, F.lit(0.0))).over(w), 6)
    got = run_systems(spark, sf_dir, [FULL]).select("pair", "t", "period", grown("net").alias("strategy"), grown("rm").alias("market"))
    return digits(got, ("strategy", "market"))


_ZIP = ", zn AS (SELECT pair, sector, ry, row_number() OVER (PARTITION BY pair ORDER BY t) AS i FROM spine WHERE ry IS NOT NULL), zf AS (SELECT sector, min(pair) AS lead FROM pairs WHERE pair IN (SELECT pair FROM zn) GROUP BY 1)"


@query("j14_sector_zip", _ZIP + " SELECT a.pair, lead, count(*)::BIGINT AS n, round(avg(a.ry - b.ry), 8) AS mean_diff, round(corr(a.ry, b.ry), 6) AS corr FROM zn a JOIN zf USING (sector) JOIN zn b ON b.pair = lead AND b.i = a.i WHERE a.pair <> lead GROUP BY 1, 2")
def j14(spark, sf_dir):
    """Every pair's returns zipped by position with those of its sector's first pair, each pair cut to the shorter of the two."""
    s = spine(spark, sf_dir).filter("ry is not null").select("pair", "sector", "ry", F.row_number().over(x.pair_window()).alias("i"))
    s = written(s, "numbered")
    lead = s.groupBy("sector").agg(F.min("pair").alias("lead"))
    first = s.join(lead, (s["sector"] == lead["sector"]) & (s["pair"] == lead["lead"]), "left_semi").select("sector", F.col("pair").alias("lead"), "i", F.col("ry").alias("theirs"))
    both = s.join(first, ["sector", "i"]).filter("pair <> lead")
    return both.groupBy("pair", "lead").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ry") - F.col("theirs")), 8).alias("mean_diff"), r6(F.corr("ry", "theirs")).alias("corr"))


LEVELS = (("success", 60), ("expanded", 40), ("static", None))
_CAT = SCORE + """, cat AS (SELECT sector, pair, score, CASE WHEN score >= 60 THEN 1 WHEN score >= 40 THEN 2 ELSE 3 END AS lv FROM score)"""


@query("s4_universe_fallback", _CAT + """ SELECT pair, string_split(pair, '/')[1] AS ticker_y, string_split(pair, '/')[2] AS ticker_x, CASE WHEN lv < 3 THEN sector ELSE 'Unknown' END AS sector, CASE best WHEN 1 THEN 'success' WHEN 2 THEN 'expanded' ELSE 'static' END AS source
  FROM (SELECT *, min(lv) OVER (PARTITION BY sector) AS best FROM cat) WHERE lv <= best""")
def s4(spark, sf_dir):
    """The catalogue of each sector from the best source that has any of its pairs: high scores, middling ones, else all; sectors are known from the scored sources alone."""
    s = pair_scores(p.week_panel(spark, sf_dir)).withColumn("lv", F.when(F.col("score") >= LEVELS[0][1], 1).when(F.col("score") >= LEVELS[1][1], 2).otherwise(3))
    s = s.withColumn("best", F.min("lv").over(Window.partitionBy("sector"))).filter("lv <= best")
    leg = lambda i: F.split_part("pair", F.lit("/"), F.lit(i))
    return s.select("pair", leg(1).alias("ticker_y"), leg(2).alias("ticker_x"), F.when(F.col("lv") < 3, F.col("sector")).otherwise("Unknown").alias("sector"), F.element_at(F.array(*[F.lit(n) for n, _ in LEVELS]), F.col("best")).alias("source"))


YEAR = 52  # rows


@query("d8_scan_whole", HEALTH + f""", ls AS (SELECT *, max(t) OVER (PARTITION BY pair) AS last FROM spine), yr AS (SELECT pair, round(regr_slope(y, x), 6) AS hedge, round(stddev_samp(spread), 4) AS spread_sd, max(date) AS date FROM ls WHERE t > last - {YEAR} GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t DESC) AS k FROM health)
SELECT pair, yr.date, hedge, spread_sd, round(arg_max(score, t), 4) AS health_score, arg_max(checks_passed, t)::INT AS checks_passed, round(100.0 * avg((checks_passed >= 2)::INT), 4) AS healthy_pct FROM rk JOIN yr USING (pair) WHERE k <= 13 GROUP BY pair, yr.date, hedge, spread_sd""")
def d8(spark, sf_dir):
    """A scan's row per pair: least-squares hedge and the spread's deviation over the last year, latest health, and the share of healthy readings among the last thirteen."""
    s = written(spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "spread"), "panel")
    year = s.withColumn("last", F.max("t").over(Window.partitionBy("pair"))).filter(F.col("t") > F.col("last") - YEAR)
    year = year.groupBy("pair").agg(r6(F.regr_slope("y", "x")).alias("hedge"), F.round(F.stddev_samp("spread"), 4).alias("spread_sd"), F.max("date").alias("date"))
    h = d.rolling_health(s).withColumn("k", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("t")))).filter("k <= 13")
    got = h.groupBy("pair").agg(F.round(F.max_by("health_score", "t"), 4).alias("health_score"), F.max_by("checks_passed", "t").alias("checks_passed"), F.round(100.0 * F.avg(F.col("healthy").cast("int")), 4).alias("healthy_pct"))
    return got.join(year, "pair")


@query("d13_latest_whole", _FILTERED + " SELECT h.pair, arg_max(s.date, h.t) AS date, arg_max(h.raw, h.t)::INT AS signal, arg_max(g.pos, h.t)::INT AS gated, round(arg_max(h.hedge, h.t), 6) AS hedge, arg_max(h.healthy, h.t) AS healthy, arg_max(s.z, h.t) AS z, round(least(1.0, abs(arg_max(s.z, h.t)) / 1.5), 6) AS confidence FROM fh h JOIN fgate g ON g.pair = h.pair AND g.t = h.t JOIN (SELECT spine.pair, spine.t, spine.date, z_0.z FROM spine JOIN z_0 ON z_0.pair = spine.pair AND z_0.t = spine.t) s ON s.pair = h.pair AND s.t = h.t WHERE s.z IS NOT NULL GROUP BY 1")
def d13(spark, sf_dir):
    """Each pair's latest signal with its adaptive hedge, health, what the health gate makes of it, and confidence."""
    s = gated_system(spark, sf_dir).filter("z is not null")
    last = s.groupBy("pair").agg(F.max_by(F.struct("date", "signal", "gated", "hedge", "healthy", "z"), "t").alias("v")).select("pair", "v.*")
    return last.withColumn("hedge", r6("hedge")).withColumn("confidence", r6(x.confidence("z")))


@query("d7_rotation_average", HEALTH + ", rt AS (SELECT t, count(*) AS n, avg(score) AS s FROM (SELECT t, pair, score, row_number() OVER (PARTITION BY t ORDER BY round(score, 4) DESC, pair) AS k FROM health WHERE t % 60 = 0 AND checks_passed >= 2 AND score >= 0.5) WHERE k <= 5 GROUP BY 1) SELECT count(*)::BIGINT AS rotations, round(avg(n), 6) AS mean_active, round(avg(s), 6) AS mean_health FROM rt")
def d7(spark, sf_dir):
    """Over all rotations that found a pair: how many were active and how healthy they were, on average."""
    h = d.rolling_health(spine(spark, sf_dir).select("pair", "date", "t", "y", "x", "spread")).filter("t % 60 = 0 and healthy and health_score >= 0.5")
    best = h.withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy(F.round("health_score", 4).desc(), "pair"))).filter("k <= 5")
    g = best.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("health_score").alias("s"))
    return g.agg(F.count(F.lit(1)).alias("rotations"), r6(F.avg("n")).alias("mean_active"), r6(F.avg("s")).alias("mean_health"))
