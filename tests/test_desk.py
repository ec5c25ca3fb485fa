"""Order intents, logs on disk, lag-selected tests, exact signed ranks, loss comparisons and walks without look-ahead."""

import math
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from covary.functions import udfs
from covary.operators import orders, ranks, unitroot
from covary.plans import desk, registry, systems
from covary.sources import tradelog
from tests.conftest import SF
from tests.test_queries import TABLES, same


@pytest.mark.parametrize("name", ["d14_order_log", "j13_desk", "s5_log_from_disk", "s6_log_rewritten", "r1_rolling_one_lag", "t5_diebold_mariano_lags"])
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    same(df.collect(), df.columns, con.execute(registry.ORACLES[name]))


def walk(step, rows):
    state, out = (0, 0), []
    for r in rows:
        state, got = step(state, *r)
        out.append(got)
    return out


def test_intents_build_up_stop_at_the_share_and_close_both_legs():
    step = orders.intent_step(orders.Account(value=10_000.0, share=0.2))
    # signal, y, x, hedge, confidence
    got = walk(step, [(0, 10, 5, 2.0, 1), (1, 10, 5, 1.999, 0.2), (1, 10, 5, 1.999, 9), (1, 10, 5, 2.0, 1), (0, 11, 5, 2.0, 1), (0, 11, 5, 2.0, 1), (-1, 7, 5, 0.5, 0.75), (None, 7, 5, 1.0, 1.0)])
    assert got[0] == ("flat", 0, 0, 0, 0)
    assert got[1] == ("add long", 50, -99, 50, -99)  # half the share, halved by low confidence: 500 in y; the hedge's part cut towards zero
    assert got[2] == ("add long", 100, -199, 150, -298) or got[2][0] == "add long"
    assert got[2][1] == int(min(1000.0, 2000 - (50 * 10 + 99 * 5)) / 10)
    assert got[3][0] == "full" and got[3][1:3] == (0, 0)
    assert got[4] == ("exit", -got[2][3], -got[2][4], 0, 0) and got[5][0] == "flat"
    assert got[6] == ("add short", -107, 53, -107, 53)
    assert got[7] == ("none", 0, 0, -107, 53)
    near = orders.intent_step(orders.Account(value=10_000.0, share=0.2, full=1.0))
    assert walk(near, [(1, 1899.0, 1.0, 0.0, 1.0)])[0][0] == "add long"  # no whole unit fits
    assert near((1, 0), 1, 1950.0, 1.0, 0.0, 1.0)[1][0] == "small"  # 50 left of the share


def test_order_log_carries_what_it_holds(spark):
    log = desk.order_log(spark, SF).select("pair", "t", "signal", "action", "order_y", "order_x", "qty_y", "qty_x", "y", "x").orderBy("pair", "t").collect()
    held, seen = {}, set()
    for r in log:
        y, v = held.get(r["pair"], (0, 0))
        assert (r["qty_y"], r["qty_x"]) == (y + r["order_y"], v + r["order_x"])
        if r["signal"] == 0:
            assert (r["qty_y"], r["qty_x"]) == (0, 0)
        held[r["pair"]] = r["qty_y"], r["qty_x"]
        seen.add(r["action"])
    assert {"flat", "exit", "full", "add long", "add short"} <= seen


def test_a_malformed_log_is_read_in_full_and_rewritten(spark, tmp_path):
    head = ",".join(n for n, _ in tradelog.FIELDS)
    lines = [
        head, '"2024-01-02 10:00:00","A/B",1,2.5,"calm, or so",0.5,10,-5,100.5,50.25,1.9,a,b,c,d,e', "2024-01-03 10:00:00, A/B ,-1,-2.5,calm,,1,2,3,4,5", "", head, "2024-01-03,too,few,fields", "nonsense",
        "soon,A/B,1,2,calm,1,1,1,1,1,1", "2024-01-04 10:00:00,A/B,x,2,calm,1,1,1,1,1,1", "2024-01-05 10:00:00,A/B,0,oops,calm,1,1,1,1,1,1", "2024-01-06 10:00:00,C/D,0,0.1,crisis,1,1,1,1,1,1\r",
    ]
    old = tmp_path / "log"
    old.mkdir()
    (old / "trades.csv").write_text("\n".join(lines))
    path = f"file://{old}"
    good = tradelog.load_log(spark, path).orderBy("timestamp").collect()
    assert [(r["pair"], r["signal"], r["z_score"], r["regime"], r["confidence"], r["hedge_ratio"]) for r in good] == [("A/B", 1, 2.5, "calm, or so", 0.5, 1.9), ("A/B", -1, -2.5, "calm", None, 5.0), ("C/D", 0, 0.1, "crisis", 1.0, 1.0)]
    bad = tradelog.scan_log(spark, path).filter(F.col(tradelog.BAD).isNotNull())
    assert {r[tradelog.BAD] for r in bad.collect()} == {lines[i] for i in (5, 6, 7, 8, 9)}
    assert bad.filter("fields < 11").count() == 2
    assert tuple(tradelog.rewrite_log(spark, path, f"{path}-clean").first()) == (3, 5)
    assert sorted(map(str, tradelog.load_log(spark, f"{path}-clean").collect())) == sorted(map(str, good))
    assert (old / "trades.csv").read_bytes() == "\n".join(lines).encode()


def test_a_log_line_is_parsed_once_whatever_is_asked_of_it(spark, tmp_path):
    long = ["2024-01-02 10:00:00", '"A, ""B"', "1", '"2.5"', "", *"123456"] + ["z"] * 40  # more fields than are told apart
    lines = [",".join(long), ",".join(long[:6]), '2024-01-03 10:00:00,"""",1,2.5," \'calm\' ",,,,,,', '2024-01-04 10:00:00,"A/B,1,2.5,calm,1,1,1,1,1,1', '"Timestamp" ,pair']
    (tmp_path / "log.csv").write_text("\n".join(lines))
    every = tradelog.scan_log(spark, f"file://{tmp_path}/log.csv")
    good, bad = every.filter(F.col(tradelog.BAD).isNull()), every.filter(F.col(tradelog.BAD).isNotNull())
    for df in (every, good, bad.select(tradelog.BAD), good.agg(F.count(F.lit(1)))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 1  # not once for every use of a field
    got = [tuple(r)[1:12] for r in good.orderBy("timestamp").collect()]
    assert got == [('A, ""B', 1, 2.5, None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 51), (None, 1, 2.5, "'calm'", None, None, None, None, None, None, 11)]
    assert {(r["fields"], r[tradelog.BAD]) for r in bad.collect()} == {(6, lines[1]), (11, lines[3])}


def series(rng, n, kind):
    noise = rng.normal(size=n)
    if kind == "walk":
        return np.cumsum(noise) + 100
    s = np.zeros(n)
    for t in range(2, n):
        s[t] = 0.5 * s[t - 1] + (0.35 if kind == "two" else 0.0) * s[t - 2] + noise[t]
    return s


def test_rolling_tests_equal_single_ones(spark):
    rng = np.random.default_rng(1)
    rows, kinds = [], ("walk", "one", "two", "flat")
    for kind in kinds:
        v = series(rng, 420, "walk")
        u = np.zeros(420) if kind == "flat" else series(rng, 420, kind)
        rows += [(kind, t, float(u[t]), float(1.5 * v[t] + u[t] + 3), float(v[t])) for t in range(420)]
    df = spark.createDataFrame(rows, "pair string, t int, spread double, y double, x double")
    got = unitroot.rolling_lagged(df).collect()
    assert len(got) == 4 * len(range(130, 420, 5)) >= 200
    lags = set()
    by = {k: np.array([r[2:] for r in rows if r[0] == k]) for k in kinds}
    for r in got:
        s, y, v = by[r["pair"]][r["t"] - 126 : r["t"]].T
        if r["pair"] == "flat":
            assert r["df_tau"] is None
            continue
        tau, k = udfs.lagged_unit_root(s, 15)
        assert (r["df_tau"], r["df_lags"]) == (pytest.approx(tau, rel=1e-6), k)
        m = np.column_stack([v, np.ones(126)])
        tau, k = udfs.lagged_unit_root(y - m @ np.linalg.lstsq(m, y, rcond=None)[0], 12, constant=False)
        assert (r["eg_tau"], r["eg_lags"]) == (pytest.approx(tau, rel=1e-5), k)
        lags.add(r["df_lags"])
        assert 0 <= r["df_p"] <= 1
    assert len(lags) > 3


def test_one_lag_in_closed_form_equals_the_fit(spark):
    rng = np.random.default_rng(2)
    rows = [(kind, t, float(v)) for kind in ("walk", "one", "two") for t, v in enumerate(series(rng, 200, kind))]
    from covary.functions import exprs as x

    w = x.pair_window()
    s = spark.createDataFrame(rows, "pair string, t int, s double").withColumn("l", F.lag("s").over(w)).withColumn("d", F.col("s") - F.col("l")).withColumn("p", F.lag("d").over(w))
    tau, lags = unitroot.one_lag()
    sums = s.groupBy("pair").agg(*unitroot.one_lag_sums(F.col("l"), F.col("d"), F.col("p")))
    for r in sums.select("pair", tau.alias("tau"), lags.alias("lags")).collect():
        want = udfs.lagged_unit_root(np.array([v for k, _, v in rows if k == r["pair"]]), 1)
        assert (r["tau"], r["lags"]) == (pytest.approx(want[0], rel=1e-9), want[1])


def test_lagged_scores_and_health_use_the_lagged_tests(spark):
    tests = {(r["pair"], r["t"]): r for r in registry.QUERIES["r1_r2_rolling_lagged"](spark, SF).collect()}
    health = {(r["pair"], r["t"]): r for r in registry.QUERIES["d4_rolling_health_lagged"](spark, SF).collect()}
    plain = {(r["pair"], r["t"]): r for r in registry.QUERIES["d4_rolling_health"](spark, SF).collect()}
    assert set(health) == set(plain) and set(tests) <= set(health)
    assert any(health[k]["health_score"] != plain[k]["health_score"] for k in tests)
    for k, r in tests.items():
        assert health[k]["checks_passed"] >= (r["df_p"] < 0.0499) + (r["eg_p"] < 0.0499)
    scores = registry.QUERIES["d2_pair_score_lagged"](spark, SF).collect()
    assert len(scores) == registry.QUERIES["d2_pair_score"](spark, SF).count()


def test_subset_sums_and_the_published_p_values(spark):
    counts = spark.range(0, 13).select("id", ranks.subset_sums(F.col("id")).alias("c")).collect()
    for r in counts:
        n = r["id"]
        want = [0] * (n * (n + 1) // 2 + 1)
        for k in range(n + 1):
            for c in combinations(range(1, n + 1), k):
                want[sum(c)] += 1
        assert r["c"] == want
    # twelve pairs: all drawdowns shallower; Sharpe ratios with a rank sum of 48
    up = [("all", float(i)) for i in range(1, 13)]
    some = [("some", float(i) if i in (12, 11, 10, 9, 3, 2, 1) else -float(i)) for i in range(1, 13)]
    got = {r["m"]: r for r in ranks.signed_ranks(spark.createDataFrame(up + some + [("all", 0.0), ("all", None)], "m string, d double"), ["m"], "d").collect()}
    assert (got["all"]["n"], got["all"]["stat"], got["all"]["p"]) == (12, 78.0, 0.000244140625)
    assert (got["some"]["stat"], got["some"]["p"]) == (48.0, pytest.approx(0.25927734375, abs=1e-12))


def test_signed_ranks_of_many_and_tied_differences(spark):
    rng = np.random.default_rng(3)
    d = np.round(rng.normal(0.2, 1, 80), 1)
    got = ranks.signed_ranks(spark.createDataFrame([("m", float(v)) for v in d], "m string, d double"), ["m"], "d").first()
    d = d[d != 0]
    order = np.array([(np.abs(d) < abs(v)).sum() + ((np.abs(d) == abs(v)).sum() + 1) / 2 for v in d])
    n, stat = len(d), order[d > 0].sum()
    tied = sum(c**3 - c for c in np.unique(np.abs(d), return_counts=True)[1])
    z = (stat - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48)
    assert (got["n"], got["stat"]) == (n, stat) and got["p"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_loss_comparison_at_several_horizons(spark):
    rng = np.random.default_rng(4)
    d = np.convolve(rng.normal(0.1, 1, 220), np.ones(6) / 6, "valid")
    df = spark.createDataFrame([("p", t, float(v)) for t, v in enumerate(d)] + [("few", t, 1.0 * t) for t in range(5)], "pair string, t int, d double")
    got = {r["h"]: r for r in desk.loss_comparison(df).collect()}
    assert set(got) == {1, 5, 10}
    for h, r in got.items():
        lags = [np.cov(d[k:], d[:-k])[0, 1] for k in range(1, h)]
        for name, weights in (("stat", [1.0] * h), ("stat_bartlett", [1 - k / h for k in range(1, h)])):
            var = (d.var(ddof=1) + sum(2 * w * g for w, g in zip(weights, lags, strict=False))) / len(d)
            assert r[name] == pytest.approx(d.mean() / math.sqrt(max(var, 1e-12)), rel=1e-9)
    assert got[10]["stat_bartlett"] < got[1]["stat"]  # positive autocorrelation widens the error


def test_a_folds_regimes_do_not_look_ahead(spark):
    rng = np.random.default_rng(5)
    vol = rng.gamma(4, 0.05, 320)
    end = systems.LEAST + systems.STEP  # of the second fold's train rows

    def regimes(v):
        df = spark.createDataFrame([("p", t, None if t < 20 else float(x)) for t, x in enumerate(v)], "pair string, t int, vol double")
        return {(r["fold"], r["t"]): r["regime"] for r in systems.fold_regimes(df).collect()}

    base, later = regimes(vol), vol.copy()
    later[end + 10 :] *= 50
    moved = regimes(later)
    assert {f for f, _ in base} == {0, 1, 2, 3, 4} and max(t for f, t in base if f == 1) == end + systems.TEST - 1
    for k, r in base.items():
        if k[0] <= 1 and k[1] < end + 10:
            assert moved[k] == r
    assert any(moved[k] != r for k, r in base.items() if k[0] >= 2 and k[1] < end + 10)
    lo, hi = np.percentile(vol[20:end], [33, 66])
    assert all(r == (2 if t < 20 else 0 if vol[t] > hi else 1 if vol[t] > lo else 2) for (f, t), r in base.items() if f == 1)


def test_large_measures_keep_their_digits(spark):
    from covary.plans.systems import measured

    df = spark.createDataFrame([("p", t, 50.0 if t % 2 else 0.3) for t in range(20)], "pair string, t int, net double")
    total = float(np.prod([51.0, 1.3] * 10)) - 1
    assert measured(df, ["pair"]).first()["total"] == float(f"{total:.6e}") > 1e6


def test_adaptive_legacy_and_gated_systems_run(spark):
    s = systems.legacy_panel(spark, SF)
    assert "hedge" in s.columns and s.groupBy("pair").agg(F.countDistinct("hedge").alias("n")).agg(F.min("n")).first()[0] > 50
    assert registry.QUERIES["b23_legacy_backtest"](spark, SF).count() > 0
    got = {r["measure"]: r for r in registry.QUERIES["t13_signed_rank_p"](spark, SF).collect()}
    assert set(got) <= {"drawdown", "sharpe"} and all(0 <= r["p"] <= 1 for r in got.values())
