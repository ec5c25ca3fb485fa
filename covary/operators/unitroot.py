"""Unit-root and cointegration tests whose number of lagged differences is chosen by the information criterion, per window.

Rolling tests solve all windows of a pair at once: windows are strided views of the series, one stacked orthogonal decomposition
gives the residual sums of all lag orders together (the models are nested), and the chosen order is fitted again on all its rows.
With one lag at most the normal equations have a closed form over six central moments, and no Python runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.functions import exprs as x

PART = 512  # windows that are solved at once


def _design(s: np.ndarray, lags: int, constant: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, lagged differences with the constant first, target) of every window (row of s) for a number of lags."""
    d = np.diff(s, axis=1)
    n = d.shape[1] - lags
    past = [d[:, lags - k : lags - k + n] for k in range(1, lags + 1)]
    if constant:
        past = [np.ones_like(d[:, :n]), *past]
    return s[:, lags:-1], np.stack(past, 2) if past else np.zeros((len(s), n, 0)), d[:, lags:]


def _chosen(s: np.ndarray, most: int, constant: bool) -> np.ndarray:
    """The number of lags of each window by Akaike's criterion, all orders fitted on the same rows."""
    level, past, y = _design(s, most, constant)
    c = int(constant)
    first = np.concatenate([level[:, :, None], past[:, :, :c]], 2)
    q, _ = np.linalg.qr(np.concatenate([first, past[:, :, c:]], 2))
    explained = np.cumsum(np.einsum("wnk,wn->wk", q, y) ** 2, 1)[:, c:]
    n = y.shape[1]
    rss = np.maximum((y**2).sum(1)[:, None] - explained, 1e-300)
    return np.argmin(n * np.log(rss / n) + 2 * (np.arange(most + 1) + 1 + c), 1)


def lagged_statistics(s: np.ndarray, most: int, constant: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(statistic, lags) of every row of s, each a window; nan where the series does not move."""
    s = s - s.mean(1, keepdims=True) if constant else s
    scale = np.abs(s).max(1, keepdims=True)
    s = s / np.where(scale > 0, scale, 1)
    most = max(0, min(most, (s.shape[1] - 1) // 2 - 2))
    lags, tau = _chosen(s, most, constant), np.full(len(s), np.nan)
    for k in np.unique(lags):
        mine = np.flatnonzero(lags == k)
        level, past, y = _design(s[mine], int(k), constant)
        q, r = np.linalg.qr(np.concatenate([past, level[:, :, None]], 2))  # the level last: its coefficient is the last projection over r
        along = np.einsum("wnk,wn->wk", q, y)
        rss = (y**2).sum(1) - (along**2).sum(1)
        sigma = np.sqrt(np.maximum(rss, 0) / max(1, y.shape[1] - q.shape[2]))
        last = r[:, -1, -1]
        good = (sigma > 1e-12) & (np.abs(last) > 1e-12)
        tau[mine[good]] = (np.sign(last) * along[:, -1])[good] / sigma[good]
    return tau, lags


def residuals(y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of every row's regression of y on v with a constant."""
    y, v = y - y.mean(1, keepdims=True), v - v.mean(1, keepdims=True)
    vv = (v * v).sum(1, keepdims=True)
    return y - np.where(vv > 0, (v * y).sum(1, keepdims=True) / np.where(vv > 0, vv, 1), 0) * v


def rolling_lagged(df: DataFrame, window: int = 126, step: int = 5, most: int = 15, most_pairs: int = 12, s: str = "spread") -> DataFrame:
    """(pair, t, df_tau, df_lags, df_p, eg_tau, eg_lags, eg_p) at every step-th row t, of the `window` rows before it. A pair is one series and fits a task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        ends = np.arange(window, len(frame) + 1)
        ends = ends[ends % step == 0]
        ends = ends[ends < len(frame)]
        got = []
        views = [np.lib.stride_tricks.sliding_window_view(frame[c].to_numpy(float), window) for c in ("s", "y", "x")] if len(ends) else []
        for i in range(0, len(ends), PART):
            spread, y, v = (w[ends[i : i + PART] - window] for w in views)
            got.append((*lagged_statistics(spread, most), *lagged_statistics(residuals(y, v), most_pairs, constant=False)))
        parts = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0)] * 4
        return pd.DataFrame({"pair": frame["pair"].iloc[0], "t": frame["t"].to_numpy()[ends], "df_tau": parts[0], "df_lags": parts[1].astype(int), "eg_tau": parts[2], "eg_lags": parts[3].astype(int)})

    rows = df.select("pair", "t", F.col(s).alias("s"), "y", "x")
    out = rows.groupBy("pair").applyInPandas(run, "pair string, t int, df_tau double, df_lags int, eg_tau double, eg_lags int")
    out = out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("df_tau", "eg_tau")})
    return out.withColumn("df_p", x.unit_root_p(F.round("df_tau", 6), 1)).withColumn("eg_p", x.unit_root_p(F.round("eg_tau", 6), 2))


def whole_lagged(df: DataFrame, y: str = "y", v: str = "x") -> DataFrame:
    """(pair, eg_tau, eg_lags, eg_p) over all rows of each pair; at most 12 (n / 100) ^ (1 / 4) lags."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        if len(frame) < 20:
            return pd.DataFrame([], columns=["pair", "eg_tau", "eg_lags"])
        u = residuals(frame["y"].to_numpy(float)[None], frame["v"].to_numpy(float)[None])
        tau, lags = lagged_statistics(u, int(np.ceil(12 * (len(frame) / 100) ** 0.25)), constant=False)
        return pd.DataFrame([(frame["pair"].iloc[0], tau[0], lags[0])], columns=["pair", "eg_tau", "eg_lags"])

    out = df.select("pair", "t", F.col(y).alias("y"), F.col(v).alias("v")).groupBy("pair").applyInPandas(run, "pair string, eg_tau double, eg_lags int")
    return out.withColumn("eg_tau", F.nanvl("eg_tau", F.lit(None).cast("double"))).withColumn("eg_p", x.unit_root_p(F.round("eg_tau", 6), 2))


def _moments(level: Column, step: Column, before: Column, cross, whole) -> dict[str, Column]:
    """What the closed form needs. cross puts aggregates over the rows with a step before, whole over those with a step."""
    both = step.isNotNull() & level.isNotNull() & before.isNotNull()
    some = lambda c: F.when(both, c)
    pairs = {"ll": (level, level), "pp": (before, before), "dd": (step, step), "lp": (level, before), "ld": (level, step), "pd": (before, step)}
    out = {k: cross(F.covar_pop(some(a), some(b))) for k, (a, b) in pairs.items()}
    out["n"] = cross(F.count(some(step))).cast("double")
    return out | {"m": whole(F.regr_count(step, level)).cast("double")} | {k: whole(f(step, level)) for k, f in (("sxx", F.regr_sxx), ("sxy", F.regr_sxy), ("syy", F.regr_syy))}


def _one_lag(v: dict[str, Column]) -> tuple[Column, Column]:
    ll, pp, dd, lp, ld, pd_ = (v["n"] * v[k] for k in ("ll", "pp", "dd", "lp", "ld", "pd"))
    n, sxx, sxy, syy, m = (v[k] for k in ("n", "sxx", "sxy", "syy", "m"))
    det = ll * pp - lp * lp
    bl, bp = (ld * pp - pd_ * lp) / det, (pd_ * ll - ld * lp) / det
    rss0, rss1 = dd - ld * ld / ll, dd - bl * ld - bp * pd_
    lags = F.when(n * F.log(rss1 / n) + 6 < n * F.log(rss0 / n) + 4, 1).otherwise(0)
    free = sxy / sxx / F.sqrt((syy - sxy * sxy / sxx) / (m - 2) / sxx)
    return F.when(lags == 1, bl / F.sqrt(rss1 / (n - 3) * pp / det)).otherwise(free), lags


def one_lag_sums(level: Column, step: Column, before: Column) -> list[Column]:
    """The aggregates that one_lag needs, of the regression of a step on the level before it and, where the criterion wants it, on the step before."""
    return [c.alias(f"_m_{k}") for k, c in _moments(level, step, before, lambda e: e, lambda e: e).items()]


def one_lag() -> tuple[Column, Column]:
    """(statistic, lags) from the columns of one_lag_sums."""
    return _one_lag({k: F.col(f"_m_{k}") for k in ("ll", "pp", "dd", "lp", "ld", "pd", "n", "m", "sxx", "sxy", "syy")})


def rolling_one_lag(df: DataFrame, window: int = 126, s: str = "spread", keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """df with tau and lags of the `window` rows before each row; the moments are one pass of window aggregates."""
    w = x.pair_window(*keys)
    d = df.withColumn("_l", F.lag(s).over(w)).withColumn("_d", F.col(s) - F.col("_l")).withColumn("_p", F.lag("_d").over(w))
    cross, whole = (lambda e, k=k: e.over(w.rowsBetween(-(window - k), -1)) for k in (2, 1))
    made = _moments(F.col("_l"), F.col("_d"), F.col("_p"), cross, whole)
    d = d.withColumns({f"_m_{k}": c for k, c in made.items()})
    tau, lags = one_lag()
    return d.withColumns({"tau": tau, "lags": lags}).drop("_l", "_d", "_p", *[f"_m_{k}" for k in made])
