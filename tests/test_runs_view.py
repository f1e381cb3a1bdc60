"""Runs whose values make a ratio's divisor 0 (F1, F2): the DuckDB twins give infinite or NaN."""

import math

import pytest

from prefsight.functions import ieee_div
from prefsight.plans.oracle_check import compare
from prefsight.plans.registry import load_all

# (event_type, user_id, values): a least value of 0, all 0, a sum of 0, a greatest of 0, nulls, no value at all.
RUNS = [("click", 0, [0.0, 2.0, 5.0]), ("click", 1, [1.5, 4.0]), ("error", 0, [0.0, 0.0]), ("purchase", 2, [-3.0, 3.0]),
        ("view", 1, [-2.0, 0.0]), ("signup", 2, [None, 0.0, 7.0]), ("signup", 0, [None, None]), (None, 1, [0.0, 1.0])]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    import duckdb
    folder = tmp_path_factory.mktemp("runs")
    rows = [(kind, user, v) for kind, user, values in RUNS for v in values]
    spark.createDataFrame(rows, "event_type string, user_id long, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return str(folder), con


def test_runs_with_a_zero_are_stored(spark, events):
    """writing the runs failed by DIVIDE_BY_ZERO."""
    folder, con = events
    r = compare(spark, load_all()["cmp_store"], folder, con)
    assert r["status"] == "match", r


def test_division_is_that_of_ieee_doubles(spark):
    inf, nan = math.inf, math.nan
    pairs = [(1.0, 4.0), (1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (nan, 0.0), (inf, 0.0), (inf, inf), (None, 0.0), (1.0, None)]
    want = [0.25, inf, -inf, -inf, nan, nan, inf, nan, None, None]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    got = [r[0] for r in df.orderBy("i").select(ieee_div("a", "b")).collect()]
    assert [repr(x) for x in got] == [repr(x) for x in want]


def test_runs_with_a_zero_are_summarised(spark, events):
    """the mean condition number failed by DIVIDE_BY_ZERO; it is infinite if a run's is."""
    folder, con = events
    r = compare(spark, load_all()["cmp_summary"], folder, con)
    assert r["status"] == "match", r
    got = {row["optimizer"]: row for row in load_all()["cmp_summary"].run(spark, folder).collect()}
    assert got["adam"]["condition_number_mean"] == math.inf and math.isnan(got["adamw"]["condition_number_mean"])
    assert got["lion"]["flatness_mean"] == math.inf and got["sgd"]["sharpness_mean"] == math.inf
