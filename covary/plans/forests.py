"""Regime forests, their importances and ablations, feature tables, and the SQL surface."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.functions import udfs
from covary.operators import regimes as rg
from covary.plans.base import query, spine
from covary.plans.research import HEALTH, PD, _health
from covary.plans.scalar import r6
from covary.plans.trading import BT, backtest
from covary.sources import panel as p
from covary.sources.sinks import written

PARTITIONS = 32  # of the rows that a forest is fitted on: part of the forest's definition, as its seed is


def feature_table(spark, sf_dir):
    """The weekly panel's features with label (by rule) and period."""
    f = rg.features(p.week_panel(spark, sf_dir))
    return f.withColumn("label", rg.labels(f)).withColumn("period", x.mark_period("date", p.SPLIT))


def _roll(agg: str, n: int, least: int | None = None, c: str = "m") -> str:
    w = f"OVER ({PD} {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {w} >= {n if least is None else least} THEN {agg}({c}) {w} END"


def _features_sql(last: str | None = None) -> str:
    o = "OVER (PARTITION BY pair ORDER BY t)"
    first = {f"vol_{n}": f"{_roll('stddev_samp', n, c='rm_')} * sqrt(252)" for n in rg.VOL} | {f"dd_{n}": f"m / ({_roll('max', n, 1)}) - 1" for n in rg.DOWN} | {f"ret_{n}": f"m / lag(m, {n}) {o} - 1" for n in rg.RET}
    first |= {"s20": _roll("avg", 20), "s50": _roll("avg", 50), "rr": f"ratio / lag(ratio) {o} - 1", "pair_corr": f"CASE WHEN count(y) OVER ({PD} 29 PRECEDING AND CURRENT ROW) >= 30 THEN corr(y, x) OVER ({PD} 29 PRECEDING AND CURRENT ROW) END", "rng": f"({_roll('max', 20)} - {_roll('min', 20)}) / ({_roll('avg', 60)})"}
    filled = ", ".join(f"round(coalesce(last_value({c} IGNORE NULLS) OVER ({PD} UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 5) AS {c}" for c in rg.FEATURES)
    filled = filled if last is None else ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER ({PD} UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS {c}" for c in rg.FEATURES)
    return f""",
f0 AS (SELECT *, m / lag(m) {o} - 1 AS rm_, y / x AS ratio FROM panel),
f1 AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in first.items())} FROM f0),
f2 AS (SELECT *, vol_5 - vol_60 AS vol_trend, vol_5 / (vol_20 + 1e-8) AS vol_accel, m / s20 - 1 AS trend, s20 / s50 - 1 AS trend_strength, rng AS range_expansion, pair_corr - lag(pair_corr, 10) {o} AS corr_change, {_roll('stddev_samp', 20, c='rr')} * sqrt(252) AS pair_vol FROM f1),
f3 AS (SELECT *, pair_vol / nullif({_roll('avg', 60, c='pair_vol')}, 0) AS pair_vol_spike FROM f2){"" if last is None else ","}
{"" if last is None else "f4 AS ("}SELECT pair, t, {filled} FROM f3{"" if last is None else ")" + last}"""


@query("m1_features_whole", _features_sql())
def m1(spark, sf_dir):
    """All 21 features, filled forward and then with 0."""
    return rg.features(p.week_panel(spark, sf_dir)).select("pair", "t", *[F.round(c, 5).alias(c) for c in rg.FEATURES])


def _ran(spark, sf_dir, forest=None, columns=None):
    f = written(feature_table(spark, sf_dir), "features")
    model = (forest or rg.Forest()).fit(in_order(f.filter("period = 'train'")), columns)
    return model, f


def in_order(f):
    """The rows dealt by pair and in order of time, so that a forest draws the same rows however its input was partitioned."""
    return f.repartition(PARTITIONS, "pair").sortWithinPartitions("pair", "t")


@query("m5_forest_regimes")
def m5(spark, sf_dir):
    """Classes and gated classes of a forest fitted on the train rows (the gate: probability of normal below 0.6 means crisis)."""
    model, f = _ran(spark, sf_dir)
    return rg.predict(model, f).select("pair", "t", "label", "predicted", "gated", F.round("p_normal", 6).alias("p_normal"))


m6 = query("m6_gated_scores")(lambda spark, sf_dir: _scored(spark, sf_dir))


def _scored(spark, sf_dir):
    """Accuracy, F1 and kappa of the forest and of the gated forest on the rows after the split."""
    model, f = _ran(spark, sf_dir)
    got = rg.predict(model, f.filter("period = 'oos'"))
    both = got.withColumn("v", F.explode(F.array(F.struct(F.lit("forest").alias("source"), F.col("predicted").alias("said")), F.struct(F.lit("gated").alias("source"), F.col("gated").alias("said"))))).select("label", "v.*")
    return _rounded(rg.scores(both, ["source"], said="said"))


def _rounded(df, d=6):
    return df.select(*[F.round(c, d).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def importances(spark, sf_dir, repeats: int = 10):
    """(feature, impurity, permutation)."""
    model, f = _ran(spark, sf_dir, rg.Forest())
    built_in = spark.createDataFrame([(c, float(v)) for c, v in zip(rg.FEATURES, model.stages[-1].featureImportances.toArray(), strict=True)], "feature string, impurity double")
    moved = rg.permutation_importance(model, f.filter("period = 'oos'"), repeats=repeats).withColumnRenamed("importance", "permutation")
    return built_in.join(moved, "feature", "full").na.fill(0.0)


@query("m7_importances")
def m7(spark, sf_dir):
    """Impurity importance and loss of accuracy under ten shuffles, for every feature."""
    return _rounded(importances(spark, sf_dir))


@query("m7_shapley")
def m7_shapley(spark, sf_dir):
    """What each feature adds to the forest's probability of a normal regime after the split: mean and mean size over 500 rows, ten random orders each."""
    model, f = _ran(spark, sf_dir)
    got = rg.shapley(f.filter("period = 'oos'"), rg.FEATURES, lambda df: rg.predict(model, df).withColumnRenamed("p_normal", "value"))
    return got.groupBy("feature").agg(r6(F.avg("shapley")).alias("mean"), r6(F.avg(F.abs("shapley"))).alias("mean_size"))


@query("m11_consensus_rank")
def m11(spark, sf_dir):
    """Features by the mean of their ranks under both importances and their correlation with the label (21 rows)."""
    f = feature_table(spark, sf_dir).filter("period = 'oos'")
    linked = f.agg(*[F.abs(F.try_divide(F.covar_pop(c, "label"), F.stddev_pop(c) * F.stddev_pop("label"))).alias(c) for c in rg.FEATURES])
    linked = linked.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("linear")) for c in rg.FEATURES])).alias("v")).select("v.*")
    t = importances(spark, sf_dir).join(linked, "feature", "full").na.fill(0.0)
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c))) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0
    t = t.withColumns({f"{c}_rank": rank(c) for c in ("impurity", "permutation", "linear")})
    mean = (F.col("impurity_rank") + F.col("permutation_rank") + F.col("linear_rank")) / 3
    return _rounded(t.withColumn("mean_rank", mean).withColumn("consensus", F.row_number().over(Window.orderBy("mean_rank", "feature"))))


@query("m8_group_ablation")
def m8(spark, sf_dir):
    """What the forest loses without each group of features: nine fits, one for every list of columns."""
    f = written(feature_table(spark, sf_dir), "features")
    out = None
    for name, gone in {"all": [], **rg.GROUPS}.items():
        model = rg.Forest().fit(in_order(f.filter("period = 'train'")), [c for c in rg.FEATURES if c not in gone])
        got = rg.scores(rg.predict(model, f.filter("period = 'oos'")).withColumn("without", F.lit(name)), ["without"])
        out = got if out is None else out.unionByName(got)
    full = F.max(F.when(F.col("without") == "all", F.col("accuracy"))).over(Window.partitionBy())  # nine rows
    return _rounded(out.withColumn("loss", full - F.col("accuracy")))


_LABELLED = _features_sql(""", lb AS (SELECT CASE WHEN vol_20 > 0.35 OR dd_60 < -0.20 OR vol_accel > 2.5 OR pair_corr < -0.1 THEN 0 WHEN vol_20 > 0.22 OR dd_60 < -0.10 OR vol_accel > 1.8 OR pair_vol_spike > 1.5 THEN 1 ELSE 2 END AS label,
  CASE WHEN vol_20 > 0.35 THEN 0 WHEN vol_20 > 0.22 THEN 1 ELSE 2 END AS said FROM f4),
ck AS (SELECT k::INT AS regime, count(*) FILTER (label = k AND said = k) AS hit, count(*) FILTER (label = k) AS support, count(*) FILTER (said = k) AS n FROM lb CROSS JOIN range(3) r(k) GROUP BY 1)
SELECT regime, support::BIGINT AS support, round(coalesce(hit / nullif(n, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2.0 * hit / nullif(n + support, 0), 0), 6) AS f1 FROM ck""")


@query("m9_class_scores", _LABELLED)
def m9(spark, sf_dir):
    """Precision, recall and F1 of each class of the simple rule against the labels by all features."""
    f = feature_table(spark, sf_dir).withColumn("said", F.when(F.col("vol_20") > 0.35, 0).when(F.col("vol_20") > 0.22, 1).otherwise(2))
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    g = f.select("label", "said").groupBy("label", "said").agg(F.count(F.lit(1)).alias("n")).withColumn("k", k)
    g = g.groupBy("k").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for a, c in (("hit", (F.col("label") == F.col("k")) & (F.col("said") == F.col("k"))), ("support", F.col("label") == F.col("k")), ("said_n", F.col("said") == F.col("k")))])
    precision, recall = F.coalesce(F.try_divide(F.col("hit"), F.col("said_n")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("said_n") + F.col("support")), F.lit(0.0))
    return g.select(F.col("k").alias("regime"), "support", r6(precision).alias("precision"), r6(recall).alias("recall"), r6(f1).alias("f1"))


_STATE = HEALTH + f"{BT} , sv AS (SELECT b.*, coalesce(last_value(h.score IGNORE NULLS) OVER w, 1.0) AS hs, coalesce(last_value(g.half_life IGNORE NULLS) OVER w, 20.0) AS hl, b.z - lag(b.z) OVER o AS dz, CASE WHEN count(b.spread) OVER r >= 20 THEN stddev_samp(b.spread) OVER r END AS sd20, stddev_samp(b.spread) OVER (PARTITION BY b.pair) AS sd, " + """
  last_value(CASE WHEN b.signal <> coalesce(b.before, 0) THEN b.t END IGNORE NULLS) OVER w AS since, sum(b.net) OVER (PARTITION BY b.pair ORDER BY b.t ROWS 125 PRECEDING) AS profit
  FROM bt b LEFT JOIN health h ON h.pair = b.pair AND h.t = b.t LEFT JOIN (SELECT pair, t, half_life FROM dg WHERE t % 5 = 0) g ON g.pair = b.pair AND g.t = b.t
  WINDOW w AS (PARTITION BY b.pair ORDER BY b.t ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY b.pair ORDER BY b.t), r AS (PARTITION BY b.pair ORDER BY b.t ROWS 19 PRECEDING))
SELECT pair, t, round(least(greatest(coalesce(z, 0.0), -5.0), 5.0) / 5, 6) AS z, round(least(greatest(coalesce(dz, 0.0), -2.0), 2.0) / 2, 7) AS dz, round(least(greatest(coalesce(sd20 / nullif(sd, 0), 1.0), 0.0), 3.0) / 3, 6) AS spread_vol, round(hs, 6) AS health, round(least(greatest(hl, 0.0), 60.0) / 60, 6) AS half_life,
  signal::DOUBLE AS position, round(least(greatest(CASE WHEN signal = 0 THEN 0 ELSE t - coalesce(since, t) END, 0), 30) / 30.0, 6)::DOUBLE AS held, round(least(greatest(coalesce(profit, 0.0), -0.5), 0.5) * 2, 6) AS profit, regime / 2.0::DOUBLE AS regime FROM sv"""


@query("m13_state_vectors", _STATE)
def m13(spark, sf_dir):
    """Clipped state features of every row: z, its change, volatility of the spread, health, half-life, position, rows held, recent profit, regime."""
    w = x.pair_window()
    s = backtest(spark, sf_dir).join(_health(spark, sf_dir).select("pair", "t", "health_score", F.col("half_life").alias("hl")), ["pair", "t"], "left")
    s = s.withColumn("health_score", x.ffill("health_score", w, 1.0)).withColumn("hl", x.ffill("hl", w, 20.0))
    change = F.col("signal") != F.coalesce(F.lag("signal").over(w), F.lit(0))
    s = s.withColumn("since", F.last(F.when(change, F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.when(F.col("signal") == 0, 0).otherwise(F.col("t") - F.coalesce("since", F.col("t")))
    return s.select(
        "pair", "t", r6(x.clip(F.coalesce("z", F.lit(0.0)), -5.0, 5.0) / 5).alias("z"), F.round(x.clip(F.coalesce(x.diff("z", w), F.lit(0.0)), -2.0, 2.0) / 2, 7).alias("dz"),
        r6(x.clip(F.coalesce(F.try_divide(x.rolling(F.stddev_samp, "spread", w, 20), F.stddev_samp("spread").over(Window.partitionBy("pair"))), F.lit(1.0)), 0.0, 3.0) / 3).alias("spread_vol"), r6("health_score").alias("health"),
        r6(x.clip("hl", 0.0, 60.0) / 60).alias("half_life"), F.col("signal").cast("double").alias("position"), r6(x.clip(held, 0, 30) / 30.0).alias("held"),
        r6(x.clip(F.coalesce(x.rolling(F.sum, "net", w, 126, 1), F.lit(0.0)), -0.5, 0.5) * 2).alias("profit"), (F.col("regime") / 2.0).alias("regime"),
    )


@query("l5_sql_functions", "SELECT pair, t, least(1.0, abs(z) / 1.5) AS confidence, CASE regime WHEN 0 THEN 'crisis' WHEN 1 THEN 'volatile' ELSE 'normal' END AS regime_name, CASE WHEN abs(z) / 3 < 0.4 THEN 0.0 WHEN abs(z) / 3 < 0.6 THEN 0.5 WHEN abs(z) / 3 < 0.8 THEN 0.75 WHEN z IS NOT NULL THEN 1.0 ELSE 1.0 END::DOUBLE AS size FROM spine")
def l5(spark, sf_dir):
    """The library's expressions called by name from SQL."""
    udfs.register(spark)
    return spark.sql("SELECT pair, t, covary_confidence(z, 1.5D) AS confidence, covary_regime_name(regime) AS regime_name, covary_health_size(abs(z) / 3) AS size FROM {s}", s=spine(spark, sf_dir))


@query("l4_table_functions", "SELECT pair, f::INT AS fold, (150 + 30 * f - 1)::INT AS train_end_t, (150 + 30 * f)::INT AS test_start_t, (150 + 30 * f + 49)::INT AS test_end_t FROM (SELECT pair, count(*) AS n FROM spine GROUP BY 1) JOIN range(0, 10000) r(f) ON 150 + 30 * f + 50 <= n")
def l4(spark, sf_dir):
    """Folds of every pair's own walk by a table function in a lateral join."""
    udfs.register(spark)
    rows = spine(spark, sf_dir).groupBy("pair").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return spark.sql("SELECT pair, f.* FROM {rows}, LATERAL walk_forward_folds(n, 150, 30, 50) f", rows=rows)
