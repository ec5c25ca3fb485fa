"""Projections, filters and scalar functions over the weekly panel (P, F, X)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.plans.base import query, spine
from covary.sources import panel as p

O = "(PARTITION BY pair ORDER BY t)"  # noqa: E741


def _columns(name: str, made: dict):
    """A query of (pair, t) and columns, each given as a Spark column, made when the query runs, and a DuckDB expression."""
    sql = "SELECT pair, t, " + ", ".join(f"{q} AS {k}" for k, (_, q) in made.items()) + " FROM spine"

    @query(name, sql)
    def run(spark, sf_dir):
        return spine(spark, sf_dir).select("pair", "t", *[col().alias(k) for k, (col, _) in made.items()])


def r6(col):
    return F.round(col, 6)


_columns("p1_pct_change", {f"ret_{k}": (lambda k=k: r6(x.pct_change("m", x.pair_window(), k)), f"round(m / lag(m, {k}) OVER {O} - 1, 6)") for k in (1, 5, 10, 20)})
_columns("p2_diff", {f"d_{k}": (lambda k=k: x.diff("y", x.pair_window(), k), f"y - lag(y, {k}) OVER {O}") for k in (1, 10)})
_columns("p3_lag", {"z_before": (lambda: F.lag("z", 1).over(x.pair_window()), f"lag(z) OVER {O}")})
_columns("p4_annualise", {"vol_year": (lambda: F.round(x.annualise(F.col("vol") / 10), 5), "round(vol / 10 * sqrt(252), 5)"), "year": (lambda: r6(x.annual_return(F.col("ry") / 100, F.lit(126))), "round((1 + ry / 100) ^ (252.0 / 126) - 1, 6)")})
_columns("p5_safe_ratio", {"ratio": (lambda: r6(x.safe_ratio("y", "x")), "round(y / (x + 1e-8), 6)"), "sharpe": (lambda: r6(F.when(F.col("vol") > 0, F.col("rm") / F.col("vol")).otherwise(0.0)), "round(CASE WHEN vol > 0 THEN rm / vol ELSE 0.0 END, 6)")})
_columns("p6_clip", {"clipped": (lambda: x.clip("z", -2.0, 2.0), "CASE WHEN z IS NOT NULL THEN least(greatest(z, -2.0), 2.0) END"), "positive": (lambda: F.when(F.col("z").isNotNull(), F.greatest("z", F.lit(0.0))), "CASE WHEN z IS NOT NULL THEN greatest(z, 0.0) END")})
_columns("p7_health_size", {"size": (lambda: x.size_by_health(F.abs(F.col("z")) / 2), "CASE WHEN abs(z) / 2 < 0.4 THEN 0.0 WHEN abs(z) / 2 < 0.6 THEN 0.5 WHEN abs(z) / 2 < 0.8 THEN 0.75 ELSE 1.0 END::DOUBLE")})
_columns("p8_position_size", {"size": (lambda: F.round(x.position_size("z", "vol"), 4), "round(CASE WHEN z IS NOT NULL AND vol IS NOT NULL THEN least(greatest((least(greatest((abs(z) - 2) / 2, 0.0), 0.5) + 1) * least(greatest(1 - (vol - 0.15) / 0.15, 0.5), 1.0), 0.5), 1.5) END, 4)")})
_columns("p9_regime_name", {"name": (lambda: x.regime_name("regime"), "['crisis', 'volatile', 'normal'][regime + 1]")})
_columns("p10_mark_period", {"period": (lambda: x.mark_period("date", p.SPLIT), f"CASE WHEN date <= DATE '{p.SPLIT}' THEN 'train' ELSE 'oos' END")})
_columns("p11_split_three", {"period": (lambda: x.mark_three("date", "1998-06-30", p.SPLIT), f"CASE WHEN date <= DATE '1998-06-30' THEN 'train' WHEN date <= DATE '{p.SPLIT}' THEN 'val' ELSE 'test' END")})
_columns("p12_confidence", {"confidence": (lambda: r6(F.when(F.col("z").isNotNull(), x.confidence("z"))), "round(CASE WHEN z IS NOT NULL THEN least(1.0, abs(z) / 1.5) END, 6)")})
_columns("p13_finite", {"filled": (lambda: r6(x.finite(F.col("rm") / F.nullif(F.col("t") - 3, F.lit(0)), 0.5)), "round(coalesce(rm / nullif(t - 3, 0), 0.5), 6)")})
_columns("p14_percent", {"pct": (lambda: F.round(F.col("rm") * 100, 3), "round(rm * 100, 3)")})
_columns("p15_cohens_band", {"band": (lambda: x.cohens_band("z"), "CASE WHEN abs(z) < 0.2 THEN 'negligible' WHEN abs(z) < 0.5 THEN 'small' WHEN abs(z) < 0.8 THEN 'medium' ELSE 'large' END")})
_columns("x10_math", {"a": (lambda: r6(F.log("y")), "round(ln(y), 6)"), "b": (lambda: r6(F.exp("rm")), "round(exp(rm), 6)"), "s": (lambda: r6(F.sqrt("x")), "round(sqrt(x), 6)"), "g": (lambda: F.signum("z"), "sign(z)::DOUBLE"), "p": (lambda: r6(F.pow("vol", F.lit(1.5))), "round(vol ^ 1.5, 6)")})
_K = "(1 / (1 + 0.2316419 * abs(z)))"
_TAIL = f"(exp(-abs(z) * abs(z) / 2) / sqrt(2 * pi()) * {_K} * (0.319381530 + {_K} * (-0.356563782 + {_K} * (1.781477937 + {_K} * (-1.821255978 + {_K} * 1.330274429)))))"
_columns("x9_distributions", {"normal": (lambda: F.round(x.norm_cdf("z"), 5), f"round(CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END, 5)"),
                               "chi2_2": (lambda: r6(x.chi2_sf(F.col("z") * F.col("z"), 2)), "round(exp(-z * z / 2), 6)"), "chi2_10": (lambda: r6(x.chi2_sf(F.col("z") * F.col("z"), 10)), "round(exp(-z * z / 2) * (1 + (z*z/2) + (z*z/2)^2 / 2 + (z*z/2)^3 / 6 + (z*z/2)^4 / 24), 6)")})


@query("p16_scores", "SELECT pair, round(avg(score), 4) AS overall FROM (SELECT pair, CASE WHEN abs(z) >= 2 THEN 100.0 WHEN abs(z) >= 1 THEN 60.0 ELSE 20.0 END AS score FROM spine WHERE z IS NOT NULL) GROUP BY 1")
def p16(spark, sf_dir):
    a = F.abs("z")
    scored = spine(spark, sf_dir).filter("z is not null").select("pair", F.when(a >= 2, 100.0).when(a >= 1, 60.0).otherwise(20.0).alias("score"))
    return scored.groupBy("pair").agg(F.round(F.avg("score"), 4).alias("overall"))


@query("p17_verdict", "SELECT pair, CASE WHEN s >= 75 THEN 'robust' WHEN s >= 60 THEN 'moderate' WHEN s >= 30 THEN 'fragile' ELSE 'weak' END AS verdict, good FROM (SELECT pair, 100.0 * avg((abs(z) < 1)::INT) AS s, ((avg(z) > 0)::INT + (max(z) > 2)::INT + (min(z) < -2)::INT)::INT AS good FROM spine WHERE z IS NOT NULL GROUP BY 1)")
def p17(spark, sf_dir):
    got = spine(spark, sf_dir).filter("z is not null").groupBy("pair").agg((100.0 * F.avg((F.abs("z") < 1).cast("int"))).alias("s"), ((F.avg("z") > 0).cast("int") + (F.max("z") > 2).cast("int") + (F.min("z") < -2).cast("int")).alias("good"))
    return got.select("pair", F.when(F.col("s") >= 75, "robust").when(F.col("s") >= 60, "moderate").when(F.col("s") >= 30, "fragile").otherwise("weak").alias("verdict"), "good")


@query("f1_date_range", "SELECT date, ticker, sector, close FROM prices WHERE date BETWEEN DATE '1997-01-06' AND DATE '1998-12-28'")
def f1(spark, sf_dir):
    return p.week_prices(spark, sf_dir, "1997-01-06", "1999-01-03").filter(F.col("date").between(F.lit("1997-01-06").cast("date"), F.lit("1998-12-28").cast("date")))


@query("f2_period", f"SELECT pair, t, z FROM spine WHERE date > DATE '{p.SPLIT}'")
def f2(spark, sf_dir):
    return spine(spark, sf_dir).filter(x.mark_period("date", p.SPLIT) == "oos").select("pair", "t", "z")


@query("f3_drop_null", "SELECT pair, t, z, vol FROM spine WHERE z IS NOT NULL AND vol IS NOT NULL")
def f3(spark, sf_dir):
    return spine(spark, sf_dir).select("pair", "t", "z", "vol").na.drop(how="any", subset=["z", "vol"])


_columns("f4_regime_rule", {"regime_by_rule": (lambda: x.regime_rule("vol", "rm"), "CASE WHEN coalesce(vol > 0.35, false) OR coalesce(rm < -0.2, false) THEN 0 WHEN coalesce(vol > 0.22, false) OR coalesce(rm < -0.1, false) THEN 1 ELSE 2 END")})


@query("f5_score_floor", "SELECT pair, t, z FROM spine WHERE z >= 1.5")
def f5(spark, sf_dir):
    return spine(spark, sf_dir).filter("z >= 1.5").select("pair", "t", "z")


@query("f7_label_match", "SELECT DISTINCT ticker, contains(ticker, 'IN') AS has_in, regexp_matches(ticker, 'UNITED|CHINA|RAN') AS any_of FROM prices")
def f7(spark, sf_dir):
    return p.week_prices(spark, sf_dir).select("ticker", F.contains("ticker", F.lit("IN")).alias("has_in"), F.col("ticker").rlike("UNITED|CHINA|RAN").alias("any_of")).distinct()


_columns("f9_forward_fill", {"filled": (lambda: x.ffill(F.when(F.col("t") % 7 == 0, F.col("z")), x.pair_window(), 0.0), "coalesce(last_value(CASE WHEN t % 7 = 0 THEN z END IGNORE NULLS) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING), 0.0)")})


@query("f10_fill_default", "SELECT pair, t, coalesce(last_value(CASE WHEN t % 5 = 0 AND z IS NOT NULL THEN abs(z) < 1 END IGNORE NULLS) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING), true) AS healthy FROM spine")
def f10(spark, sf_dir):
    return spine(spark, sf_dir).select("pair", "t", x.ffill(F.when((F.col("t") % 5 == 0) & F.col("z").isNotNull(), F.abs("z") < 1), x.pair_window(), True).alias("healthy"))


@query("f11_min_rows", "SELECT pair, count(*)::BIGINT AS n, count(*) < 330 AS rejected, CASE WHEN count(*) < 330 THEN 'fewer than 330 rows' END AS reason FROM panel GROUP BY 1")
def f11(spark, sf_dir):
    """Pairs with too few rows are reported with a reason, not raised as errors."""
    few = F.count(F.lit(1)) < 330
    return p.week_panel(spark, sf_dir).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), few.alias("rejected"), F.when(few, "fewer than 330 rows").alias("reason"))


@query("x1_split_pair", "SELECT pair, split_part(pair, '/', 1) AS left_name, split_part(pair, '/', 2) AS right_name, replace(pair, '/', '_') AS joined FROM pairs")
def x1(spark, sf_dir):
    parts = F.split("pair", "/")
    return p.sector_pairs(p.week_prices(spark, sf_dir)).select("pair", parts[0].alias("left_name"), parts[1].alias("right_name"), F.concat_ws("_", parts[0], parts[1]).alias("joined"))


@query("x2_join_list", "SELECT sector, string_agg(pair, '|' ORDER BY pair) AS pairs FROM pairs GROUP BY 1")
def x2(spark, sf_dir):
    return p.sector_pairs(p.week_prices(spark, sf_dir)).groupBy("sector").agg(F.array_join(F.array_sort(F.collect_list("pair")), "|").alias("pairs"))


_E = "CASE WHEN event_id % 7 = 0 THEN ' \"' || event_type || '\" ' ELSE event_type END"


@query("x3_trim_quotes", f"SELECT event_id, trim(trim({_E}), '\"') AS name FROM events", ctes="")
def x3(spark, sf_dir):
    e = p.table(spark, sf_dir, "events")
    return e.select("event_id", F.regexp_replace(F.trim(F.expr(_E)), '^"+|"+$', "").alias("name"))


@query("x4_parse_time", "SELECT event_id, try_cast(s AS TIMESTAMP)::DATE AS day FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS s FROM events)", ctes="")
def x4(spark, sf_dir):
    text = F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return p.table(spark, sf_dir, "events").select("event_id", F.to_date(F.try_to_timestamp(text)).alias("day"))


@query("x5_parse_number", "SELECT event_id, try_cast(CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE round(value, 3)::VARCHAR END AS DOUBLE) AS number FROM events", ctes="")
def x5(spark, sf_dir):
    text = F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.round("value", 3).cast("string"))
    return p.table(spark, sf_dir, "events").select("event_id", text.try_cast("double").alias("number"))


@query("x6_days", f"SELECT pair, t, (date - lag(date) OVER {O})::INT AS days FROM panel")
def x6(spark, sf_dir):
    return p.week_panel(spark, sf_dir).select("pair", "t", F.datediff("date", F.lag("date").over(x.pair_window())).alias("days"))


@query("x7_lookback", "SELECT DISTINCT date, (date - 365)::DATE AS since, strftime(date, '%Y%m%d') AS stamp FROM prices")
def x7(spark, sf_dir):
    return p.week_prices(spark, sf_dir).select("date", F.date_sub("date", 365).alias("since"), F.date_format("date", "yyyyMMdd").alias("stamp")).distinct()


@query("x8_json", "SELECT sector, list_aggregate(list_sort(list(pair)), 'string_agg', ',') AS back, count(*)::BIGINT AS n FROM pairs GROUP BY 1")
def x8(spark, sf_dir):
    """Scores as a map go to JSON and back."""
    got = p.sector_pairs(p.week_prices(spark, sf_dir)).groupBy("sector").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("pair", F.length("pair").cast("double"))))).alias("text"))
    back = F.from_json("text", "map<string,double>")
    return got.select("sector", F.array_join(F.array_sort(F.map_keys(back)), ",").alias("back"), F.size(back).cast("bigint").alias("n"))


@query("x11_relabel", "SELECT pair, list_transform(range(3), lambda i: list_position(list_sort([v0, v1, v2]), [v0, v1, v2][(i + 1)::INT])::INT - 1) AS labels FROM (SELECT pair, round(coalesce(avg(abs(z)) FILTER (regime = 0), 9), 6) AS v0, round(coalesce(avg(abs(z)) FILTER (regime = 1), 8), 6) AS v1, round(coalesce(avg(abs(z)) FILTER (regime = 2), 7), 6) AS v2 FROM spine GROUP BY 1)")
def x11(spark, sf_dir):
    """States renamed by the order of their means."""
    mean = lambda k: F.round(F.coalesce(F.avg(F.when(F.col("regime") == k, F.abs("z"))), F.lit(9.0 - k)), 6)
    got = spine(spark, sf_dir).groupBy("pair").agg(F.array(mean(0), mean(1), mean(2)).alias("v"))
    return got.select("pair", F.transform("v", lambda v: (F.array_position(F.array_sort("v"), v) - 1).cast("int")).alias("labels"))
