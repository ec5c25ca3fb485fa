"""Random schedules: gaps, holds and sides as they are defined, entries on allowed rows alone, and what is earned from them."""

import numpy as np
import pytest

from covary.operators import schedules as sc

N = 2000


def runs(held):
    """(start, length, side) of each stretch of a row of positions."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], held, [0]])))
    out = []
    for a, b in zip(edges, np.append(edges[1:], len(held)), strict=False):
        if a < len(held) and held[a]:
            out.append((a, b - a, held[a]))
    return out


def test_gaps_holds_and_sides_have_their_distributions():
    habits, rng = sc.Habits(40, 10.0, 3.0), np.random.default_rng(1)
    entries, exits = sc.free_entries(rng, 3000, N, habits)
    holds = exits - entries
    gaps = np.diff(np.concatenate([np.zeros((3000, 1), int), np.stack([entries, exits], 2).reshape(3000, -1)], 1), axis=1)[:, ::2]
    p = 40 / N
    assert gaps.min() >= 1 and gaps.mean() == pytest.approx(1 / p, rel=0.01)
    for k in (1, 5, 30):
        assert (gaps <= k).mean() == pytest.approx(1 - (1 - p) ** k, abs=0.005)
    assert holds.min() >= 2 and holds.mean() == pytest.approx(9.5, abs=0.05)  # a normal's whole part, two at least
    assert np.abs(np.corrcoef(gaps[:, 1], holds[:, 0])[0, 1]) < 0.06


def test_positions_follow_entries_and_exits():
    entries, exits = np.array([[2, 6, 17], [1, 9, 30]]), np.array([[4, 9, 30], [3, 40, 35]])
    held = sc.positions(entries, exits, np.array([[1, -1, 1], [-1, 1, 1]]), 20)
    assert held[0].tolist() == [0, 0, 1, 1, 0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0]  # closed by the last row
    assert held[1].tolist() == [0, -1, -1, 0, 0, 0, 0, 0, 0] + [1] * 10 + [0]
    assert sc.positions(np.array([[18]]), np.array([[19]]), np.array([[1]]), 20).sum() == 0


def test_entries_keep_to_allowed_rows():
    rng = np.random.default_rng(2)
    allowed = np.zeros(N, bool)
    allowed[200:260] = allowed[900:901] = allowed[1500:1990] = True
    habits = sc.Habits(12, 8.0, 2.0, rarest=0.01)
    entries, exits = sc.allowed_entries(rng, 400, N, habits, allowed)
    placed = entries < N
    assert placed.any(1).mean() > 0.9 and allowed[entries[placed]].all()
    assert placed.sum(1).max() <= 12
    for i in range(400):
        e, x = entries[i][placed[i]], exits[i][placed[i]]
        assert (e[1:] > x[:-1]).all()  # a gap of one row at least
    everywhere, _ = sc.allowed_entries(np.random.default_rng(3), 4000, N, habits, np.ones(N, bool))
    free, _ = sc.free_entries(np.random.default_rng(4), 4000, N, habits)
    assert everywhere[:, 5].mean() == pytest.approx(free[:, 5].mean(), rel=0.02)
    none, _ = sc.allowed_entries(np.random.default_rng(5), 10, N, habits, np.zeros(N, bool))
    assert (none == N).all()


def test_returns_are_of_the_row_before_and_pay_for_changes():
    rng = np.random.default_rng(6)
    spread = rng.normal(0, 0.01, 60)
    made = np.concatenate(list(sc.simulated(np.random.default_rng(7), spread, sc.Habits(4, 5.0, 1.0), 50, slippage=0.001)))
    again = np.random.default_rng(7)
    entries, exits = sc.free_entries(again, 50, 60, sc.Habits(4, 5.0, 1.0))
    sides = again.integers(0, 2, entries.shape) * 2 - 1
    for i in range(50):
        held = np.zeros(60)
        for e, x, s in zip(entries[i], exits[i], sides[i], strict=True):
            if e < 58:
                held[e : min(x, 59)] = s
        want = [0.0 - 0.001 * abs(held[0])] + [held[t - 1] * spread[t] - 0.001 * abs(held[t] - held[t - 1]) for t in range(1, 60)]
        np.testing.assert_allclose(made[i], want, atol=1e-15)
        assert len(runs(held)) <= 4


def test_skill_shows_and_luck_does_not(spark):
    rng = np.random.default_rng(8)
    rows = []
    for pair, skill in (("skilled", True), ("lucky", False)):
        spread = rng.normal(0, 0.01, 500)
        side = np.sign(spread) if skill else rng.choice([-1, 1], 500)
        rows += [(pair, t, float(side[t] * spread[t]) if t % 20 < 10 else 0.0, float(spread[t]), int(t % 9 > 1)) for t in range(500)]
    df = spark.createDataFrame(rows, "pair string, t int, net double, spread_return double, regime int")
    trades = spark.createDataFrame([(p, 9 + i % 3) for p in ("skilled", "lucky") for i in range(25)], "pair string, duration_days int")
    got = {r["pair"]: r for r in sc.random_schedules(df, trades, times=800).collect()}
    assert got["skilled"]["p_sharpe"] == 0 and 0.02 < got["lucky"]["p_total"] < 0.98
    alpha = {r["pair"]: r for r in sc.entry_alpha(df, trades).collect()}
    for r in alpha.values():
        assert r["alpha"] == pytest.approx(r["total"] - r["random_mean"]) and r["n_trades"] == 25
    assert alpha["skilled"]["p"] == 0 and alpha["skilled"]["alpha"] > 1
    few = {r["pair"]: r for r in sc.entry_alpha(df, trades.limit(1)).collect()}
    assert {(r["p"], r["alpha"] == r["total"]) for r in few.values()} == {(1.0, True)}
    assert sorted(map(str, alpha.values())) == sorted(map(str, sc.entry_alpha(df.repartition(3), trades).collect()))


def test_four_alphas_sum_up(spark):
    from covary.plans import registry
    from tests.conftest import SF

    got = registry.QUERIES["b20_attribution_whole"](spark, SF).collect()
    assert len(got) >= 5
    for r in got:
        assert r["sum_of_alphas"] == pytest.approx(r["regime_timing"] + r["mean_reversion"] + r["sizing"] + r["kalman"], rel=1e-5, abs=3e-6)
        assert r["mean_reversion"] == pytest.approx(r["total"] - r["random_mean"], rel=1e-5, abs=3e-6)


