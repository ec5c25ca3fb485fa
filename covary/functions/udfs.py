"""What has no built-in expression: Student's t distribution and the unit-root test with chosen lags; and the library's names for SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf



def incomplete_beta(a: np.ndarray, b: float, v: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    swap = v > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - v, v)
    log_beta = np.array([math.lgamma(i) + math.lgamma(j) - math.lgamma(i + j) for i, j in zip(p, q, strict=True)])
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - log_beta) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def t_cdf_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    good = np.isfinite(t) & (df > 0)
    tail = 0.5 * incomplete_beta(np.where(good, df, 1.0) / 2, 0.5, np.where(good, df / (df + np.where(good, t, 0) ** 2), 0.5))
    return np.where(good, np.where(t > 0, 1 - tail, tail), np.nan)


@pandas_udf(T.DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Student's t distribution function; null for a null or impossible argument."""
    return pd.Series(t_cdf_values(t.to_numpy(float), df.to_numpy(float))).where(lambda s: s.notna(), None)


def lagged_unit_root(s: np.ndarray, most: int, constant: bool = True) -> tuple[float, int]:
    """(Dickey-Fuller statistic, lags): the number of lagged differences by the information criterion of Akaike, all fitted on the same rows."""
    s = np.asarray(s, float)
    d = np.diff(s)
    most = max(0, min(most, len(d) // 2 - 2))

    def fit(lags, skip):
        y = d[skip:]
        parts = [s[skip:-1]] + [d[skip - k : len(d) - k] for k in range(1, lags + 1)]
        m = np.column_stack(parts + ([np.ones(len(y))] if constant else []))
        b, *_ = np.linalg.lstsq(m, y, rcond=None)
        rss = float(((y - m @ b) ** 2).sum())
        return m, b, rss, len(y)

    best = min(range(most + 1), key=lambda k: (lambda got: got[3] * math.log(max(got[2], 1e-300) / got[3]) + 2 * got[0].shape[1])(fit(k, most)))
    m, b, rss, n = fit(best, best)
    var = rss / max(1, n - m.shape[1]) * np.linalg.pinv(m.T @ m)[0, 0]
    return (float(b[0] / math.sqrt(var)) if var > 0 else float("nan")), best


@udtf(returnType=T.StructType([T.StructField(c, T.IntegerType()) for c in ("fold", "train_end_t", "test_start_t", "test_end_t")]))
class WalkForwardFolds:
    """walk_forward_folds(rows, least, step, test): the folds of an expanding walk."""

    def eval(self, rows: int, least: int, step: int, test: int):
        for fold, end in enumerate(range(least, rows - test + 1, step)):
            yield fold, end - 1, end, end + test - 1


@udtf(returnType=T.StructType([T.StructField("config_id", T.IntegerType()), T.StructField("setting", T.MapType(T.StringType(), T.DoubleType()))]))
class ParamGrid:
    """param_grid(json): every combination of an object of lists of numbers, in order of its keys."""

    def eval(self, axes: str):
        import itertools
        import json

        got = json.loads(axes or "{}")
        for i, values in enumerate(itertools.product(*got.values())):
            yield i, dict(zip(got, map(float, values), strict=True))


SQL_FUNCTIONS = {
    "covary_confidence": ("z DOUBLE, entry DOUBLE", "DOUBLE", "least(1.0D, abs(z) / greatest(entry, 1e-6D))"),
    "covary_health_size": ("score DOUBLE", "DOUBLE", "CASE WHEN score < 0.4 THEN 0.0D WHEN score < 0.6 THEN 0.5D WHEN score < 0.8 THEN 0.75D ELSE 1.0D END"),
    "covary_regime_name": ("code INT", "STRING", "CASE code WHEN 0 THEN 'crisis' WHEN 1 THEN 'volatile' WHEN 2 THEN 'normal' END"),
    "covary_annual_return": ("total DOUBLE, n DOUBLE", "DOUBLE", "pow(1 + total, 252.0D / n) - 1"),
    "covary_safe_ratio": ("a DOUBLE, b DOUBLE", "DOUBLE", "a / (b + 1e-8D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the library callable from SQL: expressions as SQL functions, the distribution as a UDF, folds and grids as table functions."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udf.register("covary_t_cdf", t_cdf)
    spark.udtf.register("walk_forward_folds", WalkForwardFolds)
    spark.udtf.register("param_grid", ParamGrid)
    return [*SQL_FUNCTIONS, "covary_t_cdf", "walk_forward_folds", "param_grid"]


