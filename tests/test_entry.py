"""Driver contract: entry runs on sf0.001; every oracle key is a query; a sample of oracles match."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF0001


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and {"mae", "mse", "rmse", "n"} <= set(df.columns)


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["hourly_round", "ema_single", "interp_linear", "binned_mi", "forecast_metrics",
                                  "ols_trend", "regularize_hourly", "rolling_mean_std"])
def test_oracle_sample_sf0001(spark, name):
    from scripts.oracle_check import canon

    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    a = entry.queries()[name](spark, SF0001).toPandas()
    b = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canon(a) == canon(b)
