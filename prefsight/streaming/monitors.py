"""Structured Streaming monitors (STR-*).

Each monitor is a DataFrame -> DataFrame function that works unchanged on a
streaming DataFrame (``readStream``) and on a static one (its batch twin, which
the oracle checks).  Windowed monitors keep ONE stateful aggregate per window:
calibration uses the one-pass form (per-bin sums of p - y and counts) and the
ECE / Brier / readiness values are a projection over that state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefsight.functions import N_BINS, calibration_bin, sigmoid
from prefsight.operators.margins import difficulty
from prefsight.operators.readiness import epoch_monitor
from prefsight.session import scratch_path
from prefsight.sources import io


def event_time(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """TIMESTAMP_NTZ cannot carry a watermark: turn the wall-clock value into
    the TIMESTAMP of that UTC instant, whatever the session time zone is."""
    t = F.col(ts_col)
    utc = F.make_timestamp(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t),
                           F.date_part(F.lit("SECOND"), t), F.lit("UTC"))
    return df.withColumn(ts_col, utc)


def _window_cols(window: str):
    w = F.window("ts", window)
    return w.alias("w")


def _window_out(cols=()):
    # epoch seconds of the window start: independent of the session time zone
    return [F.unix_seconds(F.col("w.start")).alias("window_start"), *cols]


def windowed_calibration(df: DataFrame, group_cols=("grp",), margin_col="margin",
                         window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """STR-2: per (window, group) n, accuracy, mean margin, ECE, Brier and MCE,
    label = chosen (1), from a single aggregate per window."""
    if watermark:
        df = df.withWatermark("ts", watermark)
    m = F.col(margin_col)
    p = sigmoid(m)
    d = df.withColumn("_p", p).withColumn("_b", calibration_bin(F.col("_p")))
    sums = [F.sum(F.when(F.col("_b") == k, F.col("_p") - 1.0)).alias(f"_s{k}") for k in range(N_BINS)]
    cnts = [F.sum(F.when(F.col("_b") == k, 1).otherwise(0)).alias(f"_c{k}") for k in range(N_BINS)]
    agg = d.groupBy(_window_cols(window), *group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(m > 0, 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(m).alias("mean_margin"), F.avg((F.col("_p") - 1.0) * (F.col("_p") - 1.0)).alias("brier"),
        *sums, *cnts)
    ece = None
    gaps = []
    for k in range(N_BINS):
        s = F.coalesce(F.abs(F.col(f"_s{k}")), F.lit(0.0))
        ece = s if ece is None else ece + s
        gaps.append(F.when(F.col(f"_c{k}") > 0, F.abs(F.col(f"_s{k}")) / F.col(f"_c{k}")).otherwise(0.0))
    return agg.select(*_window_out(group_cols), "n", "accuracy", "mean_margin",
                      (ece / F.col("n")).alias("ece"), "brier", F.greatest(*gaps).alias("mce"))


def windowed_readiness(df: DataFrame, group_cols=("grp",), margin_col="margin",
                       window: str = "1 day", watermark: str | None = None,
                       variance_threshold: float = 2.0) -> DataFrame:
    """STR-3: the in-training readiness score of each window with its warning."""
    cal = windowed_calibration(df, group_cols, margin_col, window, watermark)
    out = epoch_monitor(cal.withColumn("_one", F.lit(0)), epoch_col="_one", accuracy="accuracy",
                        ece="ece", margin_mean="mean_margin", variance_threshold=variance_threshold)
    return out.select("window_start", *group_cols, "n", "accuracy", "ece", "mean_margin",
                      "rl_readiness", "margin_warning")


def windowed_rollup(df: DataFrame, run_col="run_id", name_col="name", value_col="value",
                    window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """STR-4: windowed mean of step metrics per run and metric."""
    if watermark:
        df = df.withWatermark("ts", watermark)
    agg = df.groupBy(_window_cols(window), run_col, name_col).agg(
        F.avg(value_col).alias("value"), F.count(F.lit(1)).alias("n_steps"))
    return agg.select(*_window_out([run_col, name_col]), "value", "n_steps")


def mislabel_alerts(df: DataFrame, margin_col="margin", threshold: float = -0.5) -> DataFrame:
    """STR-5 (stateless): pairs whose margin falls below the mislabel threshold."""
    return df.filter(F.col(margin_col) < F.lit(float(threshold)))


def windowed_margin_drift(df: DataFrame, group_cols=("grp",), margin_col="margin",
                          window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """STR-5: per window the easy / medium / hard shares and mislabel count."""
    if watermark:
        df = df.withWatermark("ts", watermark)
    b = difficulty(F.col(margin_col))
    agg = df.groupBy(_window_cols(window), *group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(b == "easy", 1).otherwise(0)).alias("_e"),
        F.sum(F.when(b == "medium", 1).otherwise(0)).alias("_m"),
        F.sum(F.when(b == "hard", 1).otherwise(0)).alias("_h"),
        F.sum(F.when(F.col(margin_col) < -0.5, 1).otherwise(0)).alias("mislabel_alerts"))
    n = F.col("n").cast("double")
    return agg.select(*_window_out(group_cols), "n", (F.col("_e") / n).alias("easy_fraction"),
                      (F.col("_m") / n).alias("medium_fraction"), (F.col("_h") / n).alias("hard_fraction"),
                      F.col("mislabel_alerts").cast("bigint").alias("mislabel_alerts"))


def slices(df: DataFrame, order_col: str, count: int = 8) -> list[DataFrame]:
    """``count`` consecutive ranges of ``order_col`` that cover every row.

    Rows without a value come with the first range."""
    bounds = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        return [df]
    c, width = F.col(order_col), (hi - lo) / count
    out = []
    for i in range(count):
        start, stop = lo + width * i, lo + width * (i + 1)
        part = F.lit(True) if i == count - 1 else c <= stop
        part = part & (F.lit(True) if i == 0 else c > start)
        out.append(df.filter(part if i else part | c.isNull()))
    return out


def run_file_stream(df: DataFrame, order_col: str, transform, name: str,
                    closing_row: DataFrame | None = None) -> DataFrame:
    """Replay a table as a file stream through ``transform`` into a parquet sink.

    The table arrives as consecutive ranges of ``order_col``.  Each range is
    written in parallel and then processed by a restart of the query from its
    checkpoint (``availableNow``), so event time moves forward as in a live feed
    whatever the number of files.  ``closing_row``, processed last, lies so far
    ahead that the watermark passes every window of the data; its own window
    stays open and is never emitted."""
    spark = df.sparkSession
    source = scratch_path(spark, f"stream-src-{name}")
    sink = scratch_path(spark, f"stream-sink-{name}")
    ckpt = scratch_path(spark, f"stream-ckpt-{name}")
    parts = slices(df, order_col) + ([closing_row] if closing_row is not None else [])
    for part in parts:
        part.select(*df.columns).write.mode("append").parquet(source)
        stream = transform(spark.readStream.schema(df.schema).parquet(source))
        q = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start(sink))
        q.awaitTermination()
    return spark.read.parquet(sink)


def closing_row(df: DataFrame, ahead: str) -> DataFrame:
    """One row ``ahead`` of the last event time, other columns null."""
    last = df.agg(F.max("ts").alias("ts"))
    return last.select(*((F.col("ts") + F.expr(f"INTERVAL {ahead}")).alias("ts") if f.name == "ts" else
                         F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields)).filter("ts is not null")


def ingest_stream(df: DataFrame, order_col: str, name: str = "ingest") -> DataFrame:
    """STR-1: streaming ingest -> validation -> quarantine + rendered valid rows.

    ``foreachBatch`` splits every micro-batch into two parquet sinks (valid
    rendered pairs, rejects with reasons); returns both read back with a
    ``status`` column."""
    from prefsight.operators.text import render
    spark = df.sparkSession
    source = scratch_path(spark, f"{name}-src")
    good = scratch_path(spark, f"{name}-valid")
    bad = scratch_path(spark, f"{name}-rejects")
    ckpt = scratch_path(spark, f"{name}-ckpt")

    def handle(batch: DataFrame, batch_id: int) -> None:
        # one folder per micro-batch, overwritten on retry: exactly-once output
        batch.persist()
        try:
            valid, rejected = io.validate_pairs(batch)
            valid.select("pair_id", render(F.col("prompt"), F.col("chosen")).alias("chosen_text"),
                         render(F.col("prompt"), F.col("rejected")).alias("rejected_text")) \
                .write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            rejected.select("pair_id", "error").write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        finally:
            batch.unpersist()

    for part in slices(df, order_col):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    v = spark.read.parquet(good).select("pair_id", F.lit("valid").alias("status"),
                                        F.lit(None).cast("string").alias("error"), "chosen_text", "rejected_text")
    r = spark.read.parquet(bad).select("pair_id", F.lit("rejected").alias("status"), "error",
                                       F.lit(None).cast("string").alias("chosen_text"),
                                       F.lit(None).cast("string").alias("rejected_text"))
    return v.unionByName(r)
