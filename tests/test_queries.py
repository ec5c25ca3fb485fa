"""Every query of the reference tables against DuckDB over the same small tables, and the driver's contract."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from covary.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-4, abs_tol=2e-4)
    return a == b


def same(rows, columns, found):
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(columns)
    mine = [[None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in names] for r in rows]
    theirs = [list(r) for r in found.fetchall()]
    assert len(mine) == len(theirs)
    keys = [i for i in range(len(names)) if not any(isinstance(r[i], float) for r in theirs)]
    order = lambda r: ([str(r[i]) for i in keys], [str(v) for v in r])
    for a, b in zip(sorted(mine, key=order), sorted(theirs, key=order), strict=True):
        assert all(map(close, a, b)), (a, b)


CHOSEN = ["p1_pct_change", "j1_align", "j6_asof", "a4_value_counts", "a11_shape", "w4_rolling_corr", "k1_kalman", "k4_signals", "k5_trades", "k8_health_gate", "b1_b4_net_returns", "b6_metrics", "d2_pair_score", "r2_engle_granger", "r3_hurst", "t8_t11_corrections", "s5_read_log", "m10_transitions", "x9_distributions"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    same(df.collect(), df.columns, duck.execute(registry.ORACLES[name]))


def test_every_query_has_its_sql():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 110


def test_entry(spark):
    df = entry.entry(spark)
    assert {"pair", "sharpe"} <= set(df.columns) and df.count() > 0


def test_walks_cover_each_pairs_own_rows(spark):
    from covary.operators import joins as j

    rows = [(k, t) for k, n in {"long": 357, "short": 230, "none": 199}.items() for t in range(n)]
    got = {(r["pair"], r["fold"]): (r["a"], r["z"], r["n"]) for r in j.in_own_folds(spark.createDataFrame(rows, "pair string, t int"), 150, 30, 50).groupBy("pair", "fold").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count("t").alias("n")).collect()}
    assert got == {(k, f): (150 + 30 * f, 199 + 30 * f, 50) for k, folds in (("long", 6), ("short", 2)) for f in range(folds)}


def test_whole_walk_has_a_sixth_fold_and_its_trend(spark):
    sf = "/root/testdata/sf0.01"
    walk = {(r["pair"], r["fold"]): r for r in registry.QUERIES["b16_walk_forward_whole"](spark, sf).collect()}
    five = registry.QUERIES["b16_walk_forward"](spark, sf).collect()
    assert max(f for _, f in walk) == 5 and {(r["pair"], r["fold"]) for r in five} >= {k for k in walk if k[1] < 5}
    for r in registry.QUERIES["b17_fold_trend_whole"](spark, sf).collect():
        own = [w["total"] for (pair, _), w in walk.items() if pair == r["pair"]]
        assert r["folds"] == len(own) and r["consistency"] == pytest.approx(sum(v > 0 for v in own) / len(own), abs=1e-6)


def test_kappa_of_a_single_class_is_that_of_sql(spark, tmp_path):
    con = duckdb.connect()
    for name in ("nation", "region", "supplier", "lineitem"):
        # prices within a tenth of a percent of each other: no week is volatile, so that truth and prediction are of one class
        calm = " replace (1000 + l_extendedprice / 1e5 as l_extendedprice)" if name == "lineitem" else ""
        con.execute(f"copy (select *{calm} from '{SF}/{name}.parquet') to '{tmp_path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    assert [r[:2] for r in con.execute(registry.ORACLES["m9_confusion"]).fetchall()] == [(2, 2)]
    (accuracy, kappa), *more = con.execute(registry.ORACLES["m9_kappa"]).fetchall()
    got = registry.QUERIES["m9_kappa"](spark, str(tmp_path)).collect()
    assert not more and accuracy == 1 and math.isnan(kappa)
    assert len(got) == 1 and got[0]["accuracy"] == 1 and math.isnan(got[0]["kappa"])
