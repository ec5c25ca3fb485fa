"""Folds inside the JVM give what the folds in Python give, and plan no Python stage."""

import numpy as np
import pytest

from covary.operators import folds, jvmfolds
from covary.plans.trading import backtest
from tests.conftest import SF


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(12):
        z = np.cumsum(rng.normal(0, 0.7, 200)) * 0.9
        z -= z.mean()
        for t in range(200 if k else 1):
            missing = rng.random() < 0.06
            rows.append((f"p{k}", t, None if missing else float(z[t]), None if rng.random() < 0.03 else int(rng.choice([0, 1, 2], p=[0.15, 0.3, 0.55])), bool(rng.random() < 0.6) if rng.random() < 0.9 else None, f"text {t}"))
    rows += [("nan", t, float("nan") if t % 3 else 2.0 * (-1) ** t, 2, True, None) for t in range(20)]
    return spark.createDataFrame(rows, "pair string, t int, z double, regime int, healthy boolean, extra string").repartition(5)


def told(df):
    return sorted(map(str, df.drop("z").collect()))  # through pandas a NaN comes back as null


@pytest.mark.parametrize("rules", [folds.Rules(), folds.Rules(1.0, 0.2, 1.2, 0.1, min_hold=0, max_hold=7, stop=1.3)])
def test_signals(series, rules):
    got, want = jvmfolds.signals(series, rules), folds.signals(series, rules)
    assert got.columns == want.columns and told(got) == told(want)
    assert {r["signal"] for r in got.collect()} == {-1, 0, 1}


@pytest.mark.parametrize("grace", [0, 5])
def test_gate(series, grace):
    s = folds.signals(series)
    assert told(jvmfolds.health_gate(s, grace)) == told(folds.health_gate(s, grace))


def test_of_no_rows(series):
    assert jvmfolds.signals(series.limit(0)).count() == 0


def test_the_backtest_plans_no_python(spark):
    plan = backtest(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
