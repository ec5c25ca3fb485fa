"""Frames that several queries start from, the same as DuckDB common table expressions, and the registry's decorator."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.operators.hedge import fixed_hedge
from covary.sources import panel as p

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str | None = None):
    """Registers a function of (spark, sf_dir); sql is its DuckDB form after the common table expressions."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (CTES if ctes is None else ctes) + sql
        return f

    return put


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly pair panel with the train hedge's spread, its z-score (20 rows), leg and market returns, volatility and regime."""
    out = fixed_hedge(p.week_panel(spark, sf_dir), p.SPLIT)
    w = x.pair_window()
    out = out.withColumn("z", F.round(x.zscore("spread", w, 20), 6)).withColumn("ry", x.pct_change("y", w)).withColumn("rx", x.pct_change("x", w)).withColumn("rm", x.pct_change("m", w))
    out = out.withColumn("vol", F.round(x.rolling(F.stddev_samp, "rm", w, 20) * math.sqrt(52), 6))
    return out.withColumn("regime", F.when(F.col("vol") > 0.35, 0).when(F.col("vol") > 0.22, 1).otherwise(2))


CTES = f"""WITH RECURSIVE prices AS (
  SELECT date_trunc('week', l_shipdate)::DATE AS date, n_name AS ticker, r_name AS sector, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / count(l_extendedprice) / 100.0 AS close
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
market AS (SELECT date, round(sum(round(close * 1e6)::BIGINT)::BIGINT / count(close) / 1e6, 4) AS m FROM prices GROUP BY 1),
pairs AS (SELECT a.ticker || '/' || b.ticker AS pair, a.ticker AS ticker_y, b.ticker AS ticker_x, a.sector FROM (SELECT DISTINCT ticker, sector FROM prices) a
  JOIN (SELECT DISTINCT ticker, sector FROM prices) b ON a.sector = b.sector AND a.ticker < b.ticker),
panel AS (SELECT pair, s.sector, a.date, (row_number() OVER (PARTITION BY pair ORDER BY a.date) - 1)::INT AS t, a.close AS y, b.close AS x, m
  FROM pairs s JOIN prices a ON a.ticker = ticker_y JOIN prices b ON b.ticker = ticker_x AND a.date = b.date JOIN market k ON k.date = a.date),
ols AS (SELECT pair, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM panel WHERE date <= DATE '{p.SPLIT}' GROUP BY 1),
spread0 AS (SELECT panel.*, beta, alpha, y - beta * x - alpha AS spread FROM panel JOIN ols USING (pair)),
roll0 AS (SELECT *, avg(spread) OVER w AS mu, stddev_samp(spread) OVER w AS sd, count(spread) OVER w AS nw, count(*) OVER (PARTITION BY pair) AS total,
    avg(spread) OVER e AS mu_e, stddev_samp(spread) OVER e AS sd_e, count(spread) OVER e AS ne,
    y / lag(y) OVER o - 1 AS ry, x / lag(x) OVER o - 1 AS rx, m / lag(m) OVER o - 1 AS rm
  FROM spread0 WINDOW o AS (PARTITION BY pair ORDER BY t), w AS (PARTITION BY pair ORDER BY t ROWS 19 PRECEDING), e AS (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING)),
spine0 AS (SELECT pair, sector, date, t, y, x, m, beta, alpha, spread, ry, rx, rm,
    round(CASE WHEN total < 20 THEN CASE WHEN ne >= 10 THEN (spread - mu_e) / (sd_e + 1e-8) END WHEN nw >= 20 THEN (spread - mu) / (sd + 1e-8) END, 6) AS z,
    CASE WHEN count(rm) OVER w >= 20 THEN round(stddev_samp(rm) OVER w * sqrt(52), 6) END AS vol
  FROM roll0 WINDOW w AS (PARTITION BY pair ORDER BY t ROWS 19 PRECEDING)),
spine AS (SELECT *, CASE WHEN vol > 0.35 THEN 0 WHEN vol > 0.22 THEN 1 ELSE 2 END AS regime FROM spine0),
dprices AS (SELECT l_shipdate::DATE AS date, r_name AS ticker, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / count(l_extendedprice) / 100.0 AS close
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
dpanel AS (SELECT a.ticker || '/' || b.ticker AS pair, a.date, (row_number() OVER (PARTITION BY a.ticker, b.ticker ORDER BY a.date) - 1)::INT AS t, a.close AS y, b.close AS x
  FROM dprices a JOIN dprices b ON a.date = b.date AND a.ticker < b.ticker)
"""
