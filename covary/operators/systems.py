"""Whole trading systems over a pair panel: hedge, z-score, machine and costs are settings, and all settings run in one job."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covary.functions import exprs as x
from covary.operators import folds

NO_STOP = 1e9


@dataclass(frozen=True)
class System:
    """hedge: kalman, plain (Kalman without damping), fixed (least squares of the train rows), distance (normalised prices). costs: all, slippage, none."""

    name: str
    hedge: str = "kalman"
    rules: folds.Rules = field(default_factory=folds.Rules)
    gated: bool = True
    z_rows: int = 20
    costs: str = "all"


def z_scores(s: np.ndarray, n: int) -> np.ndarray:
    """As exprs.zscore of a whole series: over the last n values, or over all so far (10 at least) of a series shorter than n."""
    out = np.full(len(s), np.nan)
    if len(s) >= n:
        w = np.lib.stride_tricks.sliding_window_view(s, n)
        out[n - 1 :] = (s[n - 1 :] - w.mean(1)) / (w.std(1, ddof=1) + 1e-8)
    else:
        for i in range(9, len(s)):
            out[i] = (s[i] - s[: i + 1].mean()) / (s[: i + 1].std(ddof=1) + 1e-8)
    return np.round(out, 6)


def distance_step(entry: float = 2.0, leave: float = 0.1):
    """Normalised-price distance: enter beyond `entry` deviations, leave near zero or beyond twice that on the side that lost its sense."""

    def step(state, z):
        (pos,) = state
        if not folds.missing(z):
            if pos == 0:
                pos = -1 if z > entry else 1 if z < -entry else 0
            elif abs(z) < leave or (pos == 1 and z > 2 * entry) or (pos == -1 and z < -2 * entry):
                pos = 0
        return (pos,), (pos,)

    return step


def distance_z(frame: pd.DataFrame, train_end: str) -> np.ndarray:
    """y and x over their first train prices, less each other, in deviations of the train rows."""
    train = (pd.to_datetime(frame["date"]) <= pd.Timestamp(train_end)).to_numpy()
    if not train.any():
        return np.full(len(frame), np.nan)
    y, v = frame["y"].to_numpy(float), frame["x"].to_numpy(float)
    s = y / y[train][0] - v / v[train][0]
    sd = s[train].std(ddof=1) if train.sum() > 1 else 0.0
    return np.round((s - s[train].mean()) / (sd if sd and sd == sd else 1e-8), 6)


def _walk(step, state, *columns) -> list:
    out = []
    for values in zip(*columns, strict=True):
        state, got = step(state, *values)
        out.append(got)
    return out


def run_systems(df: DataFrame, systems: list[System], train_end: str, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """df once for each system, with system, costs, z, hedge and signal. A group's rows are exchanged once for all systems.

    df has date, t, y, x, regime, spread and beta (the fixed hedge).
    """
    more = [("system", T.StringType()), ("costs", T.StringType()), ("z", T.DoubleType()), ("hedge", T.DoubleType()), ("signal", T.IntegerType())]
    kept = [c for c in df.columns if c not in dict(more)]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, t in more]])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t", kind="stable").reset_index(drop=True)
        regime, y, v, filtered, out = frame["regime"].tolist(), frame["y"].tolist(), frame["x"].tolist(), {}, []
        for s in systems:
            seen = regime if s.gated else [2] * len(frame)
            if s.hedge == "distance":
                z, hedge = distance_z(frame, train_end), np.ones(len(frame))
                signal = [p for (p,) in _walk(distance_step(), (0,), z.tolist())]
            else:
                if s.hedge == "fixed":
                    spread, hedge = frame["spread"].to_numpy(float), frame["beta"].to_numpy(float)
                else:
                    key = (s.hedge, s.gated)
                    if key not in filtered:
                        made = _walk(folds.kalman_step(s.hedge == "kalman"), (None, 0.0, deque(maxlen=50)), y, v, seen)
                        filtered[key] = np.array([m[0] for m in made], float), np.array([m[2] for m in made], float)
                    spread, hedge = filtered[key]
                z = z_scores(spread, s.z_rows)
                signal = [p for (p,) in _walk(folds.signal_step(s.rules), (0, 0, 0), z.tolist(), seen)]
            out.append(frame[kept].assign(system=s.name, costs=s.costs, z=np.where(np.isnan(z), None, z), hedge=hedge, signal=signal))
        return pd.concat(out)[schema.names]

    return df.select(*kept).groupBy(*keys).applyInPandas(run, schema)


def net_returns(df: DataFrame, keys: tuple[str, ...] = ("system", "pair"), size: float = 1.0, slippage_bps: float = 5.0, commission: float = 1.0, notional: float = 10_000.0) -> DataFrame:
    """Adds before, moved, gross and net; what each row pays is in its column costs."""
    w, every = x.pair_window(*keys), Window.partitionBy(*keys)
    out = df.withColumn("before", F.lag("signal").over(w)).withColumn("moved", F.coalesce(F.abs(F.col("signal") - F.col("before")), F.lit(0)))
    out = out.withColumn("gross", size * F.col("before") * (F.col("ry") - F.col("hedge") * F.col("rx")))
    traded = (F.col("moved") > 0).cast("int")
    sigma = F.coalesce(x.rolling(F.stddev_samp, "ry", w, 20), F.stddev_samp("ry").over(every))
    slippage = F.when(F.col("costs") == "none", 0.0).otherwise(F.col("moved") * slippage_bps / 1e4)
    rest = F.when(F.col("costs") == "all", traded * 2 * commission / notional + traded * 0.1 * sigma * math.sqrt(notional / 2e8)).otherwise(0.0)
    return out.withColumn("net", F.col("gross") - slippage - rest)


def legacy_step(entry=2.0, leave=0.5, entry_volatile=2.5, leave_volatile=0.3, min_hold=3, min_corr=0.5):
    """Machine with several confirmations: correlation of the legs, three time frames, the way of the z-score; holds at most three half-lives.

    State (position, row of entry, z at entry, row); inputs z, z30, z60, z90, mean of the last five z, regime, correlation, half-life.
    """
    over = lambda v, level: not folds.missing(v) and v > level

    def step(state, z, z30, z60, z90, trend, regime, corr, half_life):
        pos, since, at, row = state
        most = int(half_life * 3)

        def flat(p):
            return (p, since, at, row + 1), (p,)

        if folds.missing(z) or folds.missing(regime):
            return flat(pos)
        if not folds.missing(corr) and corr < min_corr or regime == 0:
            return flat(0)
        limit, near = (entry_volatile, leave_volatile) if regime == 1 else (entry, leave)
        if pos == 0:
            down = over(-z30, limit) and over(-z60, limit) and over(-z90, 0.8 * limit)
            up = over(z30, limit) and over(z60, limit) and over(z90, 0.8 * limit)
            early = row < 5
            if up and (early or over(z, trend if not folds.missing(trend) else math.inf)):
                pos, since, at = -1, row, z
            elif down and (early or over(-z, -trend if not folds.missing(trend) else math.inf)):
                pos, since, at = 1, row, z
            return (pos, since, at, row + 1), (pos,)
        held = row - since
        lost = -pos * z > 1.5 * limit or held > most
        back = over(near, abs(z30)) or over(near, abs(z60)) or (regime == 1 and abs(at) < entry_volatile)
        if lost or (held >= min_hold and back):
            pos = 0
        return (pos, since, at, row + 1), (pos,)

    return step


def legacy_signals(df: DataFrame, min_hold: int = 3, min_corr: float = 0.5, name: str = "signal") -> DataFrame:
    """df (z, z30, z60, z90, trend, regime, corr, half_life) with the legacy machine's position."""
    inputs = ["z", "z30", "z60", "z90", "trend", "regime", "corr", "half_life"]
    return folds.fold(df, ["pair"], "t", lambda: (0, 0, 0.0, 0), legacy_step(min_hold=min_hold, min_corr=min_corr), inputs, [(name, T.IntegerType())])


# resampling: a pair's returns are one array; draws are made within its group, nothing of their size is shuffled ----------------


def sharpe_of(draws: np.ndarray) -> np.ndarray:
    """Arithmetic Sharpe ratio of every row; 0 where it does not vary."""
    m, s = draws.mean(1), draws.std(1) * math.sqrt(252)
    return np.where(s > 0, ((1 + m) ** 252 - 1) / np.where(s > 0, s, 1), 0.0)


MEASURES = {
    "sharpe": sharpe_of,
    "total": lambda d: np.prod(1 + d, 1) - 1,
    "annual": lambda d: np.sign(np.prod(1 + d, 1)) * np.abs(np.prod(1 + d, 1)) ** (252 / d.shape[1]) - 1,
    "max_drawdown": lambda d: (np.cumprod(1 + d, 1) / np.maximum.accumulate(np.cumprod(1 + d, 1), 1) - 1).min(1),
    "win_rate": lambda d: (d > 0).mean(1),
}


def _draws(n: int, times: int, seed: list[int], block: int = 1):
    """Resampled positions by chunks of draws; blocks run on past the end to the beginning."""
    rng, left = np.random.default_rng(seed), times
    while left:
        k = min(left, max(1, 1_000_000 // n))
        starts = rng.integers(0, n, (k, -(-n // block)))
        yield ((starts[:, :, None] + np.arange(block)) % n).reshape(k, -1)[:, :n]
        left -= k


def _seed(seed: int, key) -> list[int]:
    import zlib

    return [seed, zlib.crc32(str(key).encode())]


def bootstrap(df: DataFrame, r: str = "net", times: int = 10_000, block: int = 5, seed: int = 42, least: int = 30) -> DataFrame:
    """(pair, measure, n, point, bias, se, low, high): five measures resampled, the Sharpe ratio in circular blocks. Pairs with fewer than `least` returns have no rows."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        v, out = frame["r"].to_numpy(float), []
        if len(v) >= least:
            for i, (name, f) in enumerate(MEASURES.items()):
                made = np.concatenate([f(v[at]) for at in _draws(len(v), times, [*_seed(seed, frame["pair"].iloc[0]), i], block if name == "sharpe" else 1)])
                point = float(f(v[None])[0])
                out.append((frame["pair"].iloc[0], name, len(v), point, made.mean() - point, made.std(), *np.percentile(made, [2.5, 97.5])))
        return pd.DataFrame(out, columns=["pair", "measure", "n", "point", "bias", "se", "low", "high"])

    rows = df.filter(F.col(r).isNotNull()).select("pair", "t", F.col(r).alias("r"))
    return rows.groupBy("pair").applyInPandas(run, "pair string, measure string, n long, point double, bias double, se double, low double, high double")


def paired_bootstrap(df: DataFrame, ours: str, theirs: str, times: int = 10_000, seed: int = 42, least: int = 30) -> DataFrame:
    """(pair, n, ours, theirs, diff, se, low, high, p, cohens_d): Sharpe ratios on the same positions; p of the centred differences, two-sided."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        a, b = frame["a"].to_numpy(float), frame["b"].to_numpy(float)
        if len(a) < least:
            return pd.DataFrame([], columns=names)
        made = np.concatenate([sharpe_of(a[at]) - sharpe_of(b[at]) for at in _draws(len(a), times, _seed(seed, frame["pair"].iloc[0]))])
        x_, y_ = float(sharpe_of(a[None])[0]), float(sharpe_of(b[None])[0])
        p = float((np.abs(made - made.mean()) >= abs(x_ - y_)).mean())
        return pd.DataFrame([(frame["pair"].iloc[0], len(a), x_, y_, x_ - y_, made.std(), *np.percentile(made, [2.5, 97.5]), p, (x_ - y_) / max(made.std(), 1e-8))], columns=names)

    names = ["pair", "n", "ours", "theirs", "diff", "se", "low", "high", "p", "cohens_d"]
    rows = df.filter(F.col(ours).isNotNull() & F.col(theirs).isNotNull()).select("pair", "t", F.col(ours).alias("a"), F.col(theirs).alias("b"))
    return rows.groupBy("pair").applyInPandas(run, "pair string, n long, ours double, theirs double, diff double, se double, low double, high double, p double, cohens_d double")
