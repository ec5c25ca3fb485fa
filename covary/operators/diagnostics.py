"""Rolling diagnostics over windows of the rows before the current one: closed forms of window sums, and for rescaled ranges strided views; no solver runs per window."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.functions import exprs as x
from covary.operators import unitroot

SIZES = (8, 12, 18, 27, 40, 60)
PART = 512  # windows that are held at once


def rolling_pairs(df: DataFrame, window: int = 126, s: str = "spread") -> DataFrame:
    """Adds what the last `window` rows before each row say: half_life, hedge, r2, df_tau, df_p, eg_tau, eg_p (null before that)."""
    w = x.pair_window()
    inner = w.rowsBetween(-(window - 1), -1)  # rows whose predecessor is in the window, too
    half = w.rowsBetween(-(window - 2), -1)
    whole = w.rowsBetween(-window, -1)
    full = F.count(F.col(s)).over(whole) >= window
    d = df.withColumn("_l", F.lag(s).over(w)).withColumn("_d", F.col(s) - F.col("_l"))
    for v in ("y", "x"):
        d = d.withColumn("_l" + v, F.lag(v).over(w)).withColumn("_d" + v, F.col(v) - F.col("_l" + v))
    theta = F.regr_slope("_d", "_l").over(half)
    hl = F.when(theta < 0, F.least(F.greatest(-math.log(2) / theta, F.lit(5.0)), F.lit(60.0))).otherwise(60.0)
    sxx, sxy, syy, n = (f.over(inner) for f in (F.regr_sxx("_d", "_l"), F.regr_sxy("_d", "_l"), F.regr_syy("_d", "_l"), F.regr_count("_d", "_l")))
    d = d.withColumn("half_life", F.when(full, hl)).withColumn("hedge", F.when(full, F.regr_slope("y", "x").over(whole))).withColumn("r2", F.when(full, F.regr_r2("y", "x").over(whole)))
    d = d.withColumn("_b", F.regr_slope("y", "x").over(whole)).withColumn("_a", F.regr_intercept("y", "x").over(whole))
    d = d.withColumn("df_tau", F.when(full, sxy / sxx / F.sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)))
    total = lambda e: F.sum(e).over(inner)
    ly, lx, dy, dx = (F.col(c) for c in ("_ly", "_lx", "_dy", "_dx"))
    sums = {"n": F.lit(1.0), "ly": ly, "lx": lx, "dy": dy, "dx": dx, "lyly": ly * ly, "lxlx": lx * lx, "lylx": ly * lx, "lydy": ly * dy, "lydx": ly * dx, "lxdy": lx * dy, "lxdx": lx * dx, "dydy": dy * dy, "dxdx": dx * dx, "dydx": dy * dx}
    for k, e in sums.items():
        d = d.withColumn("_s" + k, total(F.when(ly.isNotNull(), e)))
    v = lambda k: F.col("_s" + k)
    a, b = F.col("_a"), F.col("_b")
    uu = v("lyly") + a * a * v("n") + b * b * v("lxlx") - 2 * a * v("ly") - 2 * b * v("lylx") + 2 * a * b * v("lx")
    ud = v("lydy") - b * v("lydx") - a * v("dy") + a * b * v("dx") - b * v("lxdy") + b * b * v("lxdx")
    dd = v("dydy") - 2 * b * v("dydx") + b * b * v("dxdx")
    d = d.withColumn("eg_tau", F.when(full, ud / uu / F.sqrt((dd - ud * ud / uu) / (v("n") - 1) / uu)))
    d = d.withColumn("df_p", x.unit_root_p(F.round("df_tau", 6), 1)).withColumn("eg_p", x.unit_root_p(F.round("eg_tau", 6), 2))
    return d.drop(*[c for c in d.columns if c.startswith("_")])


def hurst_exponents(windows: np.ndarray, sizes=SIZES) -> np.ndarray:
    """The slope of log rescaled range over log block size of every row of windows; 0.5 where fewer than three sizes vary, within 0 and 1."""
    n, width = windows.shape
    logs = np.full((n, len(sizes)), np.nan)
    for j, k in enumerate(sizes):
        if width // k < 1:
            continue
        blocks = windows[:, : width // k * k].reshape(n, -1, k)
        walk = np.cumsum(blocks - blocks.mean(2, keepdims=True), 2)
        sd = blocks.std(2, ddof=1)
        moves = sd > 1e-10
        ratio = np.where(moves, (walk.max(2) - walk.min(2)) / np.where(moves, sd, 1), 0.0)
        some = moves.any(1)
        logs[some, j] = np.log(ratio[some].sum(1) / moves[some].sum(1))
    there = np.isfinite(logs)
    count = there.sum(1)
    x_, y = np.where(there, np.log(sizes), 0.0), np.where(there, logs, 0.0)
    safe = np.maximum(count, 1)[:, None]
    dx = np.where(there, x_ - x_.sum(1, keepdims=True) / safe, 0.0)
    slope = (dx * y).sum(1) / np.where(count >= 2, (dx * dx).sum(1), 1)
    return np.where(count < 3, 0.5, np.clip(slope, 0.0, 1.0))


def rolling_hurst(df: DataFrame, window: int = 126, step: int = 5, s: str = "spread") -> DataFrame:
    """(pair, t, hurst) at every step-th row with a full window before it; rows are numbered from 0.

    A pair's windows are strided views of its series within the pair's group, a part of them at a time, so a row is exchanged once.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values("t")["s"].to_numpy(float)
        ends = np.arange(-(-window // step) * step, len(v), step)
        views = np.lib.stride_tricks.sliding_window_view(v, window) if len(ends) else None
        got = [hurst_exponents(views[part - window]) for part in np.array_split(ends, -(-len(ends) // PART))] if len(ends) else [np.zeros(0)]
        return pd.DataFrame({"pair": frame["pair"].iloc[0], "t": ends, "hurst": np.concatenate(got)})

    return df.select("pair", "t", F.col(s).alias("s")).groupBy("pair").applyInPandas(run, "pair string, t int, hurst double")


def health_score(df_p: Column, hurst: Column, eg_p: Column) -> Column:
    return (F.greatest(F.lit(0.0), 1 - df_p / 0.10) + F.least(F.greatest(1 - 2 * hurst, F.lit(0.0)), F.lit(1.0)) + F.greatest(F.lit(0.0), 1 - eg_p / 0.10)) / 3


def rolling_health(df: DataFrame, window: int = 126, step: int = 5, lagged: bool = False) -> DataFrame:
    """(pair, date, t, df_p, hurst, eg_p, half_life, checks_passed, health_score, healthy) at every step-th row; healthy before a full window. lagged: tests choose their lags."""
    d = rolling_pairs(df, window).filter(F.col("t") % step == 0)
    if lagged:
        tests = unitroot.rolling_lagged(df, window, step).select("pair", "t", "df_p", "eg_p")
        d = d.drop("df_p", "eg_p").join(tests, ["pair", "t"], "left")
    h = rolling_hurst(df, window, step)
    out = d.join(h, ["pair", "t"], "left")
    early = F.col("t") < window
    checks = sum(((F.coalesce(c, F.lit(False))).cast("int") for c in (F.col("df_p") < 0.05, F.col("hurst") < 0.5, F.col("eg_p") < 0.05)), F.lit(0))
    out = out.withColumn("checks_passed", F.when(early, 3).otherwise(checks))
    out = out.withColumn("health_score", F.when(early, 1.0).otherwise(health_score(F.col("df_p"), F.col("hurst"), F.col("eg_p")))).withColumn("healthy", F.col("checks_passed") >= 2)
    return out.select("pair", "date", "t", "df_p", "hurst", "eg_p", "half_life", "checks_passed", "health_score", "healthy")
