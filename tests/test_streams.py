"""Streams whose state goes on over batches, files and a restart, against batch folds; the monitor's windows and eight alerts."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from covary.operators import folds, monitor
from covary.plans import registry, streams
from covary.sources.sinks import append_table
from covary.streaming import jobs, stateful
from tests.conftest import SF
from tests.test_queries import TABLES, same


@pytest.mark.parametrize("name", ["e2_stream_system", "e3_stream_gate", "e4_sliding_monitor", "a16_alerts"])
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    same(df.collect(), df.columns, con.execute(registry.ORACLES[name]))


@pytest.fixture
def bars(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in (("long", 150), ("short", 90), ("tiny", 4)):
        v = 50 + np.cumsum(rng.normal(size=n))
        y = 2 * v + rng.normal(0, 1.5, n) + (np.arange(n) % 40 == 7) * 25
        rows += [(k, t, float(y[t]), float(v[t]), int(t % 11 % 3)) for t in range(n)]
    return spark.createDataFrame(rows, "pair string, t long, y double, x double, regime int")


def test_system_on_six_files_with_a_restart_equals_the_batch(spark, bars):
    replay = streams.Replay(bars)
    made = lambda s: stateful.stateful(s, stateful.System())
    got = {(r["pair"], r["t"]): r for r in replay.all(made).collect()}
    assert len({p["batchId"] for p in replay.progress if p["numInputRows"]}) >= 5 and len({p["runId"] for p in replay.progress}) == 2
    want = folds.kalman(bars)
    want = {(r["pair"], r["t"]): r for r in want.collect()}
    assert set(got) == set(want) and len(got) == 244
    for k, r in want.items():
        assert got[k]["innovation"] == pytest.approx(r["innovation"], rel=1e-9, abs=1e-9) and got[k]["hedge"] == pytest.approx(r["hedge"], rel=1e-9)
    for pair in ("long", "short", "tiny"):
        mine = sorted((r for (p, _), r in got.items() if p == pair), key=lambda r: r["t"])
        e = np.array([r["innovation"] for r in mine])
        state, step = (0, 0, 0), folds.signal_step(folds.Rules())
        regimes = {r["t"]: r["regime"] for r in bars.filter(F.col("pair") == pair).collect()}
        for i, r in enumerate(mine):
            z = None if i < 19 else round((e[i] - e[i - 19 : i + 1].mean()) / (e[i - 19 : i + 1].std(ddof=1) + 1e-8), 6)
            assert r["z"] == (None if z is None else pytest.approx(z, abs=2e-6))
            state, (signal,) = step(state, r["z"], regimes[r["t"]])
            assert r["signal"] == signal
    # a file that comes again changes nothing
    replay.arrive(2)
    replay.run(made)
    assert spark.read.parquet(replay.out + "/rows").count() == 244


def test_gate_remembers_how_long_a_pair_is_sick(spark):
    rows = [("a", t, 1, t < 8 or t > 40) for t in range(50)] + [("b", t, -1 if t > 3 else 0, None if t % 2 else t < 20) for t in range(30)]
    df = spark.createDataFrame(rows, "pair string, t long, signal int, healthy boolean")
    got = {(r["pair"], r["t"]): r for r in streams.Replay(df, parts=10, before=4).all(lambda s: stateful.stateful(s, stateful.Gate(grace=5))).collect()}
    want = {(r["pair"], r["t"]): r["gated"] for r in folds.health_gate(df).collect()}
    assert {k: r["gated"] for k, r in got.items()} == want
    assert got["a", 40]["sick"] == 33 and got["a", 41]["sick"] == 0


def test_idle_pairs_are_closed_by_a_timer(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("gone", t, start + dt.timedelta(hours=t), 1, True) for t in range(5)] + [("alive", t, start + dt.timedelta(hours=t), 1, True) for t in range(60)]
    df = spark.createDataFrame(rows, "pair string, t long, ts timestamp, signal int, healthy boolean")
    gate = stateful.Gate(time="ts", idle_ms=20 * 3_600_000)
    got = streams.Replay(df, parts=6, before=3).all(lambda s: stateful.stateful(s, gate)).collect()
    gone = sorted((r["t"], r["gated"]) for r in got if r["pair"] == "gone")
    assert gone == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0)]
    assert len([r for r in got if r["pair"] == "alive"]) == 60


def test_alert_levels():
    row = {"mean_z": 2.0, "flat_pct": 50.0, "active_pct": 50.0, "crisis_pct": 10.0, "per_day": 1.0, "long_pct": 30.0, "short_pct": 20.0}
    broken = lambda **m: [n for n, k, op, v in monitor.RULES if ({**row, **m}[k] < v if op == "<" else {**row, **m}[k] > v)]
    assert broken() == [] and len(monitor.RULES) == 8
    assert broken(mean_z=1.4) == ["low z-scores"] and broken(mean_z=3.6) == ["very high z-scores"] and broken(mean_z=1.5) == []
    assert broken(flat_pct=91.0, active_pct=9.0) == ["mostly flat", "hardly active"]
    assert broken(crisis_pct=50.0) == [] and broken(crisis_pct=51.0, per_day=0.4, long_pct=71.0, short_pct=70.1) == ["crisis regime", "few signals a day", "long bias", "short bias"]


def test_late_rows_count_in_no_window_but_in_the_progress(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    log = lambda days, z: spark.createDataFrame([(day(n), day(n).date(), 1, z, 2) for n in days], "ts timestamp, date date, signal int, z double, regime int")
    replay = streams.Replay(log([0], 2.0).withColumn("t", F.lit(0)))
    replay.df = log([0], 2.0)
    made = lambda s: jobs.sliding_monitor(s, "10 days", "5 days", "1 day")
    for rows in (log(range(30), 2.0), log([2, 3, 29], 9.0), log([60], 2.0)):  # the second brings two rows that are four weeks late
        append_table(rows.coalesce(1), replay.path)
        replay.run(made)
    got = {r["start"]: r for r in spark.read.parquet(replay.out + "/rows").collect()}
    assert jobs.late_groups(replay.progress) == 2  # both rows would be in the same two windows
    first = got[min(k for k in got if k >= day(0).date())]
    assert first["max_z"] == 2.0 and first["n"] == 10 and first["alerts"] == ["long bias"]
    assert max(r["max_z"] for r in got.values()) == 9.0
