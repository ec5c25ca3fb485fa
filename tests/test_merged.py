"""Merged tables, pivots, curves, zips, catalogues and snapshots against DuckDB."""

import duckdb
import pytest

from covary.plans import registry
from tests.conftest import SF
from tests.test_queries import TABLES, same


@pytest.mark.parametrize("name", ["j4_rolling_merge", "a17_sweep_pivot", "b4_equity_curves", "j14_sector_zip", "s4_universe_fallback", "d8_scan_whole", "d13_latest_whole", "d7_rotation_average", "k10_legacy_monitor", "m9_class_scores", "m13_state_vectors"])
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    same(rows, df.columns, con.execute(registry.ORACLES[name]))
