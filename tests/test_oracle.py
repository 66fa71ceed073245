import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
"""Every registered sensor query against its DuckDB oracle: at sf0.001, and those
that need full windows at sf0.01, where there are some."""

import pytest

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL
from oracle_check import compare, duck
from sensorcast.plans.catalog import QUERIES, SQL as SQLS


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    ok, msg = compare(got, con.execute(SQLS[name]).df())
    assert ok, msg


@pytest.mark.parametrize("name, rows", [("windows_pairs", 10_000), ("patch_normal_equations", 57),
                                        ("patch_linear_forecast", 5_000), ("filter_linear_forecast", 5_000),
                                        ("metrics_all_models", 5), ("metrics_by_window_mode", 3)])
def test_windows_and_heads(spark, name, rows):
    got = QUERIES[name](spark, SF_MID).toPandas()
    ok, msg = compare(got, duck(SF_MID).execute(SQLS[name]).df())
    assert ok and len(got) >= rows, msg


def test_registered():
    assert set(QUERIES) <= set(E.queries()) and set(SQLS) <= set(E.oracle_sql())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"model", "series_id", "mae", "rmse", "r2"} <= set(df.columns)


@pytest.mark.parametrize("name", ["fill_gaps", "calendar_features", "kpi_rollup",
                                  "stream_resample", "decompose_forecast", "scan_csv"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        ok, msg = compare(QUERIES[name](spark, SF_SMALL).toPandas(), con.execute(SQLS[name]).df())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ok, msg
