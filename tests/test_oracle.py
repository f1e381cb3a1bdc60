"""Every query with oracle SQL must equal DuckDB on the same parquet tables
(sf0.001 here; the driver gate runs sf0.01).  Rows-only queries must run."""

import os

import pytest

from prefsight.plans.oracle_check import compare, duck_connection
from prefsight.plans.registry import load_all

SF = os.environ.get("PREFSIGHT_TEST_SF", "/root/testdata/sf0.001")
REG = load_all()
WITH_SQL = sorted(n for n, s in REG.items() if s.sql is not None)
ROWS_ONLY = sorted(n for n, s in REG.items() if s.sql is None)


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, con, name):
    r = compare(spark, REG[name], SF, con)
    assert r["status"] == "match", r


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, name):
    df = REG[name].run(spark, SF)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
