"""Systems, resampling and distributions against plain computations on small series."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from covary.functions import udfs
from covary.operators import folds, regimes, schedules, systems
from covary.plans import registry
from tests.conftest import SF
from tests.test_queries import TABLES, same

NEW = ["k7_distance_machine", "k11_kalman_only", "k12_regime_only", "b13_baseline_battery", "b14_ablation_battery", "b16_walk_forward_refit", "b17_refit_trend", "b19_filter_comparison", "b21_regime_value", "m12_regime_comparison", "r8_stability", "r9_stability_ranking", "d10_rotation_log", "d11_rotation_due", "m1_features_whole", "l4_table_functions", "l5_sql_functions", "a10_spearman_p", "x9_student_t", "t5_diebold_mariano_p", "t6_return_tests_p", "b15_sensitivity_whole", "k6_legacy_signals", "k10_legacy_monitor", "b23_legacy_backtest", "b16_walk_forward_whole", "b17_fold_trend_whole"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    same(df.collect(), df.columns, con.execute(registry.ORACLES[name]))


def test_student_t():
    got = udfs.t_cdf_values([0, 1, 2.0, -2.2281388520, 12.7062047362, 1.6448536270], [5, 10, 1, 10, 1, 1e7])
    assert got == pytest.approx([0.5, 0.8295534338, 0.8524163823, 0.025, 0.975, 0.95], abs=1e-6)


def test_lagged_unit_root_tells_walks_from_noise():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=400)
    assert udfs.lagged_unit_root(noise, 15)[0] < -5 < -2.8 < udfs.lagged_unit_root(np.cumsum(noise), 15)[0]


def test_distance_machine_enters_leaves_and_stops():
    z = [None, 2.5, 1.0, 0.05, -2.5, -4.5, 0.0, 2.1, 4.2]
    state, out = (0,), []
    for v in z:
        state, (p,) = systems.distance_step()(state, v)
        out.append(p)
    assert out == [0, -1, -1, 0, 1, 1, 0, -1, -1]


def test_legacy_machine():
    step, state, out = systems.legacy_step(), (0, 0, 0.0, 0), []
    rows = [  # z, z30, z60, z90, trend, regime, corr, half-life
        (None, None, None, None, None, 2, 0.9, 10), (2.5, 2.5, 2.5, 2.5, None, 2, 0.9, 10), (2.5, 2.5, 2.5, 2.5, None, 2, 0.9, 10), (0.1, 0.1, 2.0, 2.0, None, 2, 0.9, 10),
        (2.4, 2.4, 2.4, 2.4, None, 2, 0.9, 10), (3.2, 3.2, 3.2, 3.2, 2.4, 2, 0.9, 10), (-2.5, -2.5, -2.5, -1.7, 0.0, 2, 0.9, 10), (-2.5, -2.5, -2.5, -1.7, 0.0, 2, 0.2, 10), (-2.5, -2.5, -2.5, -1.7, 0.0, 0, 0.9, 10),
    ]
    for r in rows:
        state, (p,) = step(state, *r)
        out.append(p)
    # held to the least hold, stopped at 1.5 times the level, long at once below it, flat when the legs part, flat in a crisis
    assert out == [0, -1, -1, -1, -1, 0, 1, 0, 0]


def test_z_scores_are_those_of_the_expressions(spark):
    rng = np.random.default_rng(2)
    for n in (15, 50):
        s = rng.normal(size=n).cumsum()
        df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(s)], "pair string, t int, s double")
        from covary.functions import exprs as x

        want = [r["z"] for r in df.select("t", F.round(x.zscore("s", x.pair_window(), 20), 6).alias("z")).orderBy("t").collect()]
        got = systems.z_scores(s, 20)
        assert [None if math.isnan(v) else v for v in got] == [w if w is None else pytest.approx(w, abs=2e-6) for w in want]


def test_resampling_repeats_and_brackets_the_truth(spark):
    rng = np.random.default_rng(3)
    rows = [(p, i, float(a), float(b)) for p in ("u", "v") for i, (a, b) in enumerate(zip(rng.normal(0.001, 0.01, 300), rng.normal(0, 0.01, 300), strict=True))] + [("short", i, 0.01, 0.01) for i in range(5)]
    df = spark.createDataFrame(rows, "pair string, t int, net double, rm double")
    first = systems.bootstrap(df, times=2000).collect()
    assert sorted(map(str, first)) == sorted(map(str, systems.bootstrap(df.repartition(3), times=2000).collect()))
    assert {r["pair"] for r in first} == {"u", "v"} and len(first) == 10
    for r in first:
        if r["measure"] == "win_rate":
            share = np.mean([x[2] > 0 for x in rows if x[0] == r["pair"]])
            assert r["point"] == pytest.approx(share) and r["se"] == pytest.approx(math.sqrt(share * (1 - share) / 300), rel=0.1) and r["low"] < share < r["high"]
    for r in systems.paired_bootstrap(df, "net", "rm", times=2000).collect():
        assert 0 <= r["p"] <= 1 and r["low"] <= r["diff"] <= r["high"]
    trades = spark.createDataFrame([("u", d) for d in (5, 9, 12, 7)], "pair string, duration_days int")
    got = {r["pair"]: r for r in schedules.random_schedules(df.withColumn("spread_return", F.col("rm")), trades, times=300).collect()}
    assert got["v"]["p_sharpe"] == 1.0 and 0 <= got["u"]["p_sharpe"] <= 1 and got["u"]["n_trades"] == 4


def test_forest_learns_balances_and_ranks_features(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        label = int(rng.choice([0, 1, 2], p=[0.1, 0.2, 0.7]))
        rows.append((f"p{i % 3}", i // 3, label, float(rng.normal(label, 0.3)), float(rng.normal())))
    df = spark.createDataFrame(rows, "pair string, t int, label int, tells double, noise double")
    model = regimes.Forest(20, 4, 5).fit(df, ["tells", "noise"])
    got = regimes.predict(model, df)
    s = regimes.scores(got, []).first()
    assert s["accuracy"] > 0.9 and s["kappa"] > 0.8
    assert got.filter("p_normal < 0.6 and gated <> 0").count() == 0
    drop = {r["feature"]: r["importance"] for r in regimes.permutation_importance(model, df, ["tells", "noise"], repeats=3).collect()}
    assert drop["tells"] > 0.2 > 0.05 > abs(drop["noise"])


def test_shapley_values_of_a_linear_model_are_its_terms(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([("p", i, *map(float, r)) for i, r in enumerate(x)], "pair string, t int, a double, b double, c double")
    got = regimes.shapley(df, ["a", "b", "c"], lambda d: d.withColumn("value", 2 * F.col("a") - F.col("b")), rows=60, draws=800)
    values = {(r["t"], r["feature"]): r["shapley"] for r in got.collect()}
    assert len(values) == 180
    means = x.mean(0)
    for i, r in enumerate(x):
        others = (means * 60 - r) / 59  # a row is compared with all others
        assert values[i, "a"] == pytest.approx(2 * (r[0] - others[0]), abs=0.35)
        assert values[i, "b"] == pytest.approx(-(r[1] - others[1]), abs=0.18)
        assert values[i, "c"] == pytest.approx(0, abs=1e-12)
    size = {f: np.mean([abs(v) for (_, k), v in values.items() if k == f]) for f in "abc"}
    far = np.mean(np.abs(x - means), 0) * 60 / 59
    assert size["a"] == pytest.approx(2 * far[0], rel=0.02) and size["b"] == pytest.approx(far[1], rel=0.02)


def test_a_forest_does_not_depend_on_partitions(spark):
    from covary.plans.forests import in_order

    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(f"p{i % 7}", i // 7, int(v[0] + v[1] > 0) + int(v[1] > 1), *map(float, v)) for i, v in enumerate(rng.normal(size=(700, 2)))], "pair string, t int, label int, u double, v double")
    said = [sorted((r["pair"], r["t"], round(r["p_normal"], 9)) for r in regimes.predict(regimes.Forest(15, 4, 5).fit(in_order(df.repartition(n)), ["u", "v"]), df).collect()) for n in (1, 5, 9)]
    assert said[0] == said[1] == said[2]


def test_rules_of_systems_reach_the_machine():
    assert folds.Rules(stop=systems.NO_STOP).stop > 1e8


def test_corrections_of_many_tests(spark):
    """Against the definitions: ties, a p of one, and a single test."""
    from covary.plans.systems import corrected

    for ps in ([0.001, 0.013, 0.013, 0.2, 0.04, 1.0, 0.012], [0.03], [0.5, 0.5]):
        rows = {r["pair"]: r for r in corrected(spark.createDataFrame([(f"p{i}", 0.1, v) for i, v in enumerate(ps)], "pair string, diff double, p double")).collect()}
        order, m = sorted(range(len(ps)), key=lambda i: (ps[i], i)), len(ps)
        for k, i in enumerate(order):
            got = rows[f"p{i}"]
            assert got["bonferroni"] == pytest.approx(min(1, m * ps[i]))
            assert got["bh"] == pytest.approx(min(1, min(ps[j] * m / (n + 1) for n, j in enumerate(order) if n >= k)))
            assert got["holm"] == pytest.approx(min(1, max(ps[j] * (m - n) for n, j in enumerate(order) if n <= k)))
            assert [got[f"{c}_pass"] for c in ("bh", "bonferroni", "holm")] == [got[c] <= 0.05 for c in ("bh", "bonferroni", "holm")]
