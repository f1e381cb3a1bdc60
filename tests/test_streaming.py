"""Streaming monitors agree with their batch twins on every window."""

import pytest
from pyspark.sql import functions as F

from prefsight.plans.q_streaming import AHEAD, margins_ts, steps_ts
from prefsight.plans.registry import round_doubles
from prefsight.sources.tables import Tables
from prefsight.streaming import monitors as mo

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fn,source", [(mo.windowed_calibration, margins_ts), (mo.windowed_readiness, margins_ts),
                                       (mo.windowed_rollup, steps_ts), (mo.windowed_margin_drift, margins_ts)])
def test_stream_equals_batch(spark, fn, source):
    df = source(Tables(spark, SF))
    streamed = round_doubles(mo.run_file_stream(
        df, "ts", lambda s: fn(s, window="1 day", watermark="1 hour"), "test", mo.closing_row(df, AHEAD)))
    batch = round_doubles(fn(df, window="1 day"))
    got = sorted(map(tuple, streamed.collect()), key=repr)
    assert got and got == sorted(map(tuple, batch.select(*streamed.columns).collect()), key=repr)


def test_slices_cover_every_row_once(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i * i) for i in range(50)], "id int, o int")
    ids = [r["id"] for part in mo.slices(df, "o", 5) for r in part.collect()]
    assert sorted(ids) == list(range(50))
    nulls = df.withColumn("o", F.lit(None).cast("int"))
    assert len(mo.slices(nulls, "o")) == 1
