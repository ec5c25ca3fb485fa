"""Summaries over the backtest and health tables, distance baseline, further resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.plans.base import query, spine
from covary.plans.research import HEALTH, _health
from covary.plans.scalar import r6
from covary.plans.trading import BT, WALK, backtest, fold_metrics, metric_sql
from covary.sources import panel as p



@query("a19_universe_summary", BT + "SELECT count(*)::BIGINT AS pairs, round(avg((oos > 0)::INT), 6) AS hit_rate, round(avg(train), 6) AS mean_train, round(avg(oos), 6) AS mean_oos, round(median(oos), 8) AS median_oos, arg_max(pair, (oos, pair)) AS best FROM (SELECT pair, round(coalesce(sum(net) FILTER (period = 'train'), 0), 8) AS train, round(coalesce(sum(net) FILTER (period = 'oos'), 0), 8) AS oos FROM bt GROUP BY 1)")
def a19(spark, sf_dir):
    part = lambda k: F.round(F.coalesce(F.sum(F.when(F.col("period") == k, F.col("net"))), F.lit(0.0)), 8).alias(k)
    by_pair = backtest(spark, sf_dir).groupBy("pair").agg(part("train"), part("oos"))
    return by_pair.agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg((F.col("oos") > 0).cast("int"))).alias("hit_rate"), r6(F.avg("train")).alias("mean_train"), r6(F.avg("oos")).alias("mean_oos"), F.round(F.median("oos"), 8).alias("median_oos"), F.max_by("pair", F.struct("oos", "pair")).alias("best"))


@query("b17_fold_trend", BT + "SELECT pair, round(corr(f, rk), 6) AS trend, round(avg((v > 0)::INT), 6) AS consistency FROM (SELECT pair, f, v, rank() OVER (PARTITION BY pair ORDER BY v) + (count(*) OVER (PARTITION BY pair, v) - 1) / 2.0 AS rk FROM (SELECT pair, f, round(avg(z), 8) AS v FROM bt JOIN range(5) r(f) ON t BETWEEN 150 + 30 * f AND 150 + 30 * f + 49 GROUP BY ALL)) GROUP BY 1")
def b17(spark, sf_dir):
    """Rank correlation of a fold's measure with its number; folds fan out in the row, without a join."""
    number = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("t").between(150 + 30 * k, 150 + 30 * k + 49))
    v = backtest(spark, sf_dir).withColumn("f", F.explode(number)).groupBy("pair", "f").agg(F.round(F.avg("z"), 8).alias("v"))
    rank = F.rank().over(Window.partitionBy("pair").orderBy("v")) + (F.count(F.lit(1)).over(Window.partitionBy("pair", "v")) - 1) / 2.0
    return v.withColumn("rk", rank).groupBy("pair").agg(r6(F.corr("f", "rk")).alias("trend"), r6(F.avg((F.col("v") > 0).cast("int"))).alias("consistency"))


_TREND = WALK + f""", fm AS ({metric_sql('walk', 'pair, fold', places=10, of_ratio=10)}),
fr AS (SELECT *, rank() OVER (PARTITION BY pair ORDER BY sharpe) + (count(*) OVER (PARTITION BY pair, sharpe) - 1) / 2.0 AS a, rank() OVER (PARTITION BY pair ORDER BY total) + (count(*) OVER (PARTITION BY pair, total) - 1) / 2.0 AS b FROM fm),
ft AS (SELECT pair, count(*) AS folds, CASE WHEN count(*) >= 4 THEN round(covar_pop(fold, a) / nullif(stddev_pop(fold) * stddev_pop(a), 0), 6) END AS sharpe_trend, CASE WHEN count(*) >= 4 THEN round(covar_pop(fold, b) / nullif(stddev_pop(fold) * stddev_pop(b), 0), 6) END AS return_trend,
  round(avg((total > 0)::INT), 6) AS consistency, round(avg(total), 6) AS mean_return, round(avg(sharpe), 6) AS mean_sharpe FROM fr GROUP BY 1)
SELECT *, CASE WHEN mean_return > 0 AND consistency >= 0.6 AND mean_sharpe > 0.3 THEN 'pass' WHEN mean_return > 0 AND consistency >= 0.5 THEN 'marginal' ELSE 'fail' END AS verdict FROM ft"""


@query("b17_fold_trend_whole", _TREND)
def b17_whole(spark, sf_dir):
    """Rank correlation of Sharpe and return with the number of the fold, over all folds of each pair (null below four, or where they are all alike), and the verdict on them."""
    v = fold_metrics(spark, sf_dir).withColumns({c: F.round(c, 10) for c in ("sharpe", "total")})
    rank = lambda c: F.rank().over(Window.partitionBy("pair").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("pair", c)) - 1) / 2.0
    v = v.withColumn("by_sharpe", rank("sharpe")).withColumn("by_total", rank("total"))
    trend = lambda c: F.when(F.count(F.lit(1)) >= 4, r6(F.try_divide(F.covar_pop("fold", c), F.stddev_pop("fold") * F.stddev_pop(c))))
    got = v.groupBy("pair").agg(
        F.count(F.lit(1)).alias("folds"), trend("by_sharpe").alias("sharpe_trend"), trend("by_total").alias("return_trend"),
        r6(F.avg((F.col("total") > 0).cast("int"))).alias("consistency"), r6(F.avg("total")).alias("mean_return"), r6(F.avg("sharpe")).alias("mean_sharpe"),
    )
    good = (F.col("mean_return") > 0) & (F.col("consistency") >= 0.6) & (F.col("mean_sharpe") > 0.3)
    return got.withColumn("verdict", F.when(good, "pass").when((F.col("mean_return") > 0) & (F.col("consistency") >= 0.5), "marginal").otherwise("fail"))


_SNAP = HEALTH + ", snap AS (SELECT pair, arg_max(round(score, 4), t) AS score, arg_max(checks_passed, t) >= 2 AS healthy, round(100 * avg((checks_passed >= 2)::INT) FILTER (k <= 13), 4) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t DESC) AS k FROM health) GROUP BY 1)"


def _snapshot(spark, sf_dir):
    h = _health(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("t"))))
    last = F.max_by(F.struct(F.round("health_score", 4).alias("s"), "healthy"), "t")
    got = h.groupBy("pair").agg(last.alias("v"), F.round(100 * F.avg(F.when(F.col("k") <= 13, F.col("healthy").cast("int"))), 4).alias("recent"))
    return got.select("pair", F.col("v.s").alias("score"), "v.healthy", "recent")


@query("d8_scan_snapshot", _SNAP + " SELECT * FROM snap")
def d8(spark, sf_dir):
    """Every pair's latest health and its share of healthy readings among the last 13."""
    return _snapshot(spark, sf_dir)


@query("d9_ranked_scan", _SNAP + " SELECT pair, healthy AND score >= 0.5 AND recent >= 7 AS eligible, row_number() OVER (ORDER BY healthy AND score >= 0.5 AND recent >= 7 DESC, score DESC, pair)::INT AS place FROM snap")
def d9(spark, sf_dir):
    s = _snapshot(spark, sf_dir).withColumn("eligible", F.col("healthy") & (F.col("score") >= 0.5) & (F.col("recent") >= 7))
    return s.select("pair", "eligible", F.row_number().over(Window.orderBy(F.desc("eligible"), F.desc("score"), "pair")).alias("place"))


_ACTIVE = "SELECT pair FROM health WHERE t = {t} AND checks_passed >= 2 AND score >= 0.5 ORDER BY round(score, 4) DESC, pair LIMIT 5"


@query("d10_apply_rotation", HEALTH + f", o AS ({_ACTIVE.format(t=240)}), n AS ({_ACTIVE.format(t=285)}) SELECT pair, 'in' AS side, least(0.2, 1.0 / (SELECT count(*) FROM n)) AS size FROM n WHERE pair NOT IN (SELECT pair FROM o) UNION ALL SELECT pair, 'out', 0.0 FROM o WHERE pair NOT IN (SELECT pair FROM n) UNION ALL SELECT pair, 'kept', least(0.2, 1.0 / (SELECT count(*) FROM n)) FROM n WHERE pair IN (SELECT pair FROM o)")
def d10(spark, sf_dir):
    """From one active set to the next: pairs in, out and kept, and the size that each gets."""
    h = _health(spark, sf_dir).filter("healthy and health_score >= 0.5 and t in (240, 285)")
    best = Window.partitionBy("t").orderBy(F.round("health_score", 4).desc(), "pair")
    held = h.withColumn("k", F.row_number().over(best)).filter("k <= 5").groupBy("pair").agg(F.max((F.col("t") == 240).cast("int")).alias("old"), F.max((F.col("t") == 285).cast("int")).alias("new"))
    n = F.sum("new").over(Window.partitionBy())
    side = F.when(F.col("new") == 0, "out").when(F.col("old") == 1, "kept").otherwise("in")
    return held.select("pair", side.alias("side"), F.when(F.col("new") == 1, F.least(F.lit(0.2), 1.0 / n)).otherwise(0.0).alias("size"))


@query("k7_distance_spread", f"SELECT pair, t, round((d - mu) / sd, 5) AS z FROM (SELECT pair, t, date, y / first_value(y) OVER o - x / first_value(x) OVER o AS d FROM panel WINDOW o AS (PARTITION BY pair ORDER BY t)) JOIN (SELECT pair, avg(d) AS mu, stddev_samp(d) AS sd FROM (SELECT pair, date, y / first_value(y) OVER o - x / first_value(x) OVER o AS d FROM panel WINDOW o AS (PARTITION BY pair ORDER BY t)) WHERE date <= DATE '{p.SPLIT}' GROUP BY 1) USING (pair)")
def k7(spark, sf_dir):
    """Distance of normalised prices, scaled by the train rows."""
    first = lambda c: F.first(c).over(x.pair_window().rowsBetween(Window.unboundedPreceding, 0))
    s = p.week_panel(spark, sf_dir).withColumn("d", F.col("y") / first("y") - F.col("x") / first("x"))
    early = F.when(F.col("date") <= F.lit(p.SPLIT).cast("date"), F.col("d"))
    every = Window.partitionBy("pair")
    return s.select("pair", "t", F.round((F.col("d") - F.avg(early).over(every)) / F.stddev_samp(early).over(every), 5).alias("z"))


_DRAW = "SELECT r.pair, sim, ('0x' || substr(md5('11:' || sim || ':' || i), 1, 8))::BIGINT % n AS pick FROM (SELECT pair, count(rm) AS n FROM spine GROUP BY 1) r CROSS JOIN range(30) q(sim) JOIN (SELECT pair, t - 1 AS i FROM spine WHERE rm IS NOT NULL) e ON e.pair = r.pair"


@query("t4_paired_bootstrap", f"SELECT pair, round(avg(dd), 5) AS mean_diff, round(stddev_samp(dd), 5) AS se, round(avg((dd <= 0)::INT), 6) AS share_below FROM (SELECT d.pair, sim, avg(s.ry) / stddev_pop(s.ry) - avg(s.rx) / stddev_pop(s.rx) AS dd FROM ({_DRAW}) d JOIN spine s ON s.pair = d.pair AND s.t = d.pick + 1 GROUP BY 1, 2) GROUP BY 1")
def t4(spark, sf_dir):
    """Difference of two Sharpe ratios under the same draws."""
    s = spine(spark, sf_dir).filter("rm is not null").select("pair", (F.col("t") - 1).alias("i"), "ry", "rx")
    draws = s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pair"))).select("pair", "i", "n").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("pick", x.hash_draw(11, "sim", "i") % F.col("n"))
    sims = draws.select("pair", "sim", "pick").join(s.withColumnRenamed("i", "pick"), ["pair", "pick"]).groupBy("pair", "sim").agg((F.avg("ry") / F.stddev_pop("ry") - F.avg("rx") / F.stddev_pop("rx")).alias("dd"))
    return sims.groupBy("pair").agg(F.round(F.avg("dd"), 5).alias("mean_diff"), F.round(F.stddev_samp("dd"), 5).alias("se"), r6(F.avg((F.col("dd") <= 0).cast("int"))).alias("share_below"))


@query("t2_block_bootstrap", "SELECT pair, round(avg(sr), 5) AS mean_sharpe, round(stddev_samp(sr), 5) AS se FROM (SELECT d.pair, sim, avg(s.rm) / stddev_pop(s.rm) AS sr FROM (SELECT r.pair, sim, (('0x' || substr(md5('13:' || sim || ':' || b), 1, 8))::BIGINT % n + o) % n AS pick FROM (SELECT pair, count(rm) AS n FROM spine GROUP BY 1) r CROSS JOIN range(30) q(sim) CROSS JOIN range(1000) e(b) CROSS JOIN range(5) f(o) WHERE b < n // 5) d JOIN spine s ON s.pair = d.pair AND s.t = d.pick + 1 GROUP BY 1, 2) GROUP BY 1")
def t2(spark, sf_dir):
    """Circular blocks of five returns, drawn by a hash per block."""
    s = spine(spark, sf_dir).filter("rm is not null").select("pair", (F.col("t") - 1).alias("pick"), "rm")
    n = s.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.expr("int(n div 5) - 1"))))
    draws = n.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("pick", (x.hash_draw(13, "sim", "b") % F.col("n") + F.col("o")) % F.col("n"))
    sims = draws.select("pair", "sim", "pick").join(s, ["pair", "pick"]).groupBy("pair", "sim").agg((F.avg("rm") / F.stddev_pop("rm")).alias("sr"))
    return sims.groupBy("pair").agg(F.round(F.avg("sr"), 5).alias("mean_sharpe"), F.round(F.stddev_samp("sr"), 5).alias("se"))
