"""Random trading schedules: is a result the timing's, or would any trades of that number and length have earned it?

All simulations of a pair are drawn together. A schedule is a row of entries, exits and directions; positions come from
differences at these rows, summed along time, and returns from one product with the series. Draws depend on the seed and the pair alone.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 21  # positions (simulations times rows) that are held at once


@dataclass(frozen=True)
class Habits:
    """What a schedule takes from the actual trades. shortest: rows a trade is held at least; rarest: least chance of an entry a row."""

    trades: int
    mean: float
    sd: float
    shortest: int = 2
    rarest: float = 0.0

    def chance(self, n: int) -> float:
        return min(1.0, max(self.trades / n, self.rarest))

    def gaps(self, rng: np.random.Generator, n: int, shape) -> np.ndarray:
        return rng.geometric(self.chance(n), shape)

    def holds(self, rng: np.random.Generator, shape) -> np.ndarray:
        return np.maximum(self.shortest, np.trunc(rng.normal(self.mean, self.sd, shape)).astype(np.int64))


def free_entries(rng: np.random.Generator, times: int, n: int, habits: Habits) -> tuple[np.ndarray, np.ndarray]:
    """(entries, exits) of all simulations: each entry follows the exit before it by a gap. Rows from n - 1 on mean no trade."""
    gaps, holds = habits.gaps(rng, n, (times, habits.trades)), habits.holds(rng, (times, habits.trades))
    entries = np.cumsum(gaps, 1) + np.cumsum(holds, 1) - holds
    return entries, entries + holds


def allowed_entries(rng: np.random.Generator, times: int, n: int, habits: Habits, allowed: np.ndarray, reach: int = 20, onward: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The same with entries on allowed rows alone: an entry moves to the next allowed row less than `reach` rows away, else the search goes `onward` rows on, by a new gap.

    Round by round, for all simulations at once: a round draws each one's next attempt.
    """
    rows = np.arange(n)
    following = np.minimum.accumulate(np.where(allowed[:n], rows, n + reach)[::-1])[::-1]
    entries = np.full((times, habits.trades), n)
    exits, at, placed = entries.copy(), np.zeros(times, np.int64), np.zeros(times, np.int64)
    live = np.arange(times)
    while len(live):
        at[live] += habits.gaps(rng, n, len(live))
        live = live[at[live] < n - 2]
        target = following[at[live]]
        found = target - at[live] < reach
        hit, miss = live[found], live[~found]
        holds = habits.holds(rng, len(hit))
        entries[hit, placed[hit]], exits[hit, placed[hit]] = target[found], target[found] + holds
        at[hit] = target[found] + np.minimum(holds, n - target[found] - 1)
        at[miss] += onward
        placed[hit] += 1
        live = live[(placed[live] < habits.trades) & (at[live] < n - 2)]
    return entries, exits


def positions(entries: np.ndarray, exits: np.ndarray, sides: np.ndarray, n: int) -> np.ndarray:
    """(simulation, row): the side held. A trade that would begin in the last two rows is none; one is closed by the last row."""
    times = len(entries)
    change = np.zeros((times, n + 1), np.int32)
    sim, trade = np.nonzero(entries < n - 2)
    begin = entries[sim, trade]
    end = np.minimum(exits[sim, trade], n - 1)
    side = sides[sim, trade]
    np.add.at(change, (sim, begin), side)
    np.add.at(change, (sim, end), -side)
    return np.cumsum(change[:, :n], 1)


def simulated(rng: np.random.Generator, spread: np.ndarray, habits: Habits, times: int, allowed: np.ndarray | None = None, slippage: float = 0.0):
    """Daily returns of the simulations, in parts: what is held the row before earns the row's spread return, less slippage on changes."""
    n = len(spread)
    part = max(1, CELLS // max(1, n))
    for start in range(0, times, part):
        k = min(part, times - start)
        entries, exits = free_entries(rng, k, n, habits) if allowed is None else allowed_entries(rng, k, n, habits, allowed)
        held = positions(entries, exits, rng.integers(0, 2, entries.shape) * 2 - 1, n)
        earned = np.zeros((k, n))
        earned[:, 1:] = held[:, :-1] * spread[1:]
        if slippage:
            earned -= slippage * np.abs(np.diff(held, axis=1, prepend=0))
        yield earned


def totals(returns: np.ndarray) -> np.ndarray:
    return np.prod(1 + returns, -1) - 1


def sharpes(returns: np.ndarray, ddof: int = 0) -> np.ndarray:
    """Geometric Sharpe ratio of every row; 0 where it does not vary."""
    n, total = returns.shape[-1], totals(returns)
    vol = returns.std(-1, ddof=ddof) * math.sqrt(252)
    annual = np.where(total > -1, np.maximum(1 + total, 0) ** (252 / n) - 1, -1.0)
    return np.where(vol > 0, annual / np.where(vol > 0, vol, 1), 0.0)


def _told(df: DataFrame, trades: DataFrame, columns: list[str]) -> DataFrame:
    told = trades.groupBy("pair").agg(F.count(F.lit(1)).alias("n_trades"), F.avg("duration_days").alias("mean_days"), F.stddev_pop("duration_days").alias("sd_days"))
    return df.select("pair", "t", *columns).join(told, "pair", "left").fillna(0, ["n_trades", "mean_days", "sd_days"])


def _habits(frame: pd.DataFrame, rarest: float = 0.0) -> Habits:
    row = frame.iloc[0]
    return Habits(int(row["n_trades"]), max(int(row["mean_days"]), 2), max(int(row["sd_days"]), 1), rarest=rarest)


def _rng(seed: int, pair: str) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(pair).encode())])


def random_schedules(df: DataFrame, trades: DataFrame, times: int = 10_000, seed: int = 42, least: int = 3) -> DataFrame:
    """(pair, n_trades, sharpe, total, p_sharpe, p_total, low, high): the actual returns against random entries, holds and sides.

    df: pair, t, net, spread_return; trades: pair, duration_days. Pairs with fewer than `least` trades get p 1 and zeros.
    """
    names = ["pair", "n_trades", "sharpe", "total", "p_sharpe", "p_total", "low", "high"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        pair, habits = frame["pair"].iloc[0], _habits(frame)
        net, spread = frame["net"].dropna().to_numpy(float), frame["spread_return"].dropna().to_numpy(float)
        if habits.trades < least or len(spread) < 4:
            return pd.DataFrame([(pair, habits.trades, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)], columns=names)
        made = [(sharpes(r), totals(r)) for r in simulated(_rng(seed, pair), spread, habits, times)]
        ratio, total = (np.concatenate(x) for x in zip(*made, strict=True))
        ours, earned = float(sharpes(net, 1)), float(totals(net))
        return pd.DataFrame([(pair, habits.trades, ours, earned, (ratio >= ours).mean(), (total >= earned).mean(), *np.percentile(ratio, [2.5, 97.5]))], columns=names)

    return _told(df, trades, ["net", "spread_return"]).groupBy("pair").applyInPandas(run, "pair string, n_trades long, sharpe double, total double, p_sharpe double, p_total double, low double, high double")


def entry_alpha(df: DataFrame, trades: DataFrame, times: int = 1000, seed: int = 42, least: int = 2, slippage_bps: float = 5.0, calmest: int = 1) -> DataFrame:
    """(pair, n_trades, total, random_mean, random_sd, alpha, p): what entries by z-score earn above random entries on the same tradeable rows.

    df: pair, t, net, spread_return, regime; random entries lie on rows of a regime of `calmest` or more and pay slippage. Pairs with
    fewer than `least` trades keep their total as alpha, with p 1.
    """
    names = ["pair", "n_trades", "total", "random_mean", "random_sd", "alpha", "p"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        pair, habits, total = frame["pair"].iloc[0], _habits(frame, rarest=0.01), float(totals(frame["net"].dropna().to_numpy(float)))
        there = frame["spread_return"].notna()
        spread, allowed = frame["spread_return"][there].to_numpy(float), (frame["regime"][there] >= calmest).to_numpy()
        if habits.trades < least or len(spread) < 4:
            return pd.DataFrame([(pair, habits.trades, total, 0.0, 0.0, total, 1.0)], columns=names)
        drawn = np.concatenate([totals(r) for r in simulated(_rng(seed, pair), spread, habits, times, allowed, slippage_bps / 1e4)])
        return pd.DataFrame([(pair, habits.trades, total, drawn.mean(), drawn.std(), total - drawn.mean(), (drawn >= total).mean())], columns=names)

    return _told(df, trades, ["net", "spread_return", "regime"]).groupBy("pair").applyInPandas(run, "pair string, n_trades long, total double, random_mean double, random_sd double, alpha double, p double")
