"""STR-* queries: file-replayed Structured Streaming monitors and their batch twins,
both checked by the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefsight.plans import sql_fn as S
from prefsight.plans.registry import query
from prefsight.sources import views as V
from prefsight.streaming import monitors as mo

WINDOW = "1 day"
WATERMARK = "1 hour"
#: How far the closing row of a replay lies ahead: a window and the watermark.
AHEAD = "3 DAYS"
_WSTART = "CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT)"


def margins_ts(t):
    """v_margins with event time (TIMESTAMP, session zone UTC)."""
    e = t.events.select(F.col("event_id").alias("pair_id"), F.col("event_type").alias("grp"),
                        ((F.col("value") - 30.0) / 41.0).alias("margin"), "ts")
    return mo.event_time(e)


def steps_ts(t):
    """v_metric_log rows with event time."""
    ml = V.v_metric_log(t).join(t.events.select(F.col("event_id").alias("step"), "ts"), "step")
    return mo.event_time(ml.select("run_id", "step", "name", "value", "ts"))


_MARGINS_TS = "SELECT event_id AS pair_id, event_type AS grp, (value - 30.0) / 41.0 AS margin, ts FROM events"
_CAL_SQL = f"""
WITH m AS ({_MARGINS_TS}),
c AS (SELECT *, {S.sigmoid('margin')} AS p FROM m),
cb AS (SELECT *, {S.bin_case('p')} AS bin, {_WSTART} AS window_start FROM c),
pb AS (SELECT window_start, grp, bin, sum(p - 1.0e0) AS s, count(*) AS c FROM cb
       WHERE bin IS NOT NULL GROUP BY window_start, grp, bin),
tot AS (SELECT window_start, grp, count(*) AS n,
               avg(CASE WHEN margin > 0 THEN 1.0e0 ELSE 0.0e0 END) AS accuracy,
               avg(margin) AS mean_margin, avg((p - 1.0e0) * (p - 1.0e0)) AS brier FROM cb
        GROUP BY window_start, grp)
SELECT t.window_start, t.grp, t.n, t.accuracy, t.mean_margin,
       coalesce(sum(abs(pb.s)), 0) / t.n AS ece, t.brier, coalesce(max(abs(pb.s) / pb.c), 0.0e0) AS mce
FROM tot t LEFT JOIN pb ON pb.window_start = t.window_start AND pb.grp = t.grp
GROUP BY t.window_start, t.grp, t.n, t.accuracy, t.mean_margin, t.brier
"""


_INGEST_SQL = """
SELECT pair_id, CASE WHEN error IS NULL THEN 'valid' ELSE 'rejected' END AS status, error,
       CASE WHEN error IS NULL THEN 'Prompt: ' || prompt || chr(10) || chr(10) || 'Response: ' || chosen END AS chosen_text,
       CASE WHEN error IS NULL THEN 'Prompt: ' || prompt || chr(10) || chr(10) || 'Response: ' || rejected END
         AS rejected_text
FROM (
SELECT *, CASE
  WHEN prompt IS NULL OR length(prompt) = 0 THEN 'prompt must be a non-empty string'
  WHEN chosen IS NULL OR length(chosen) = 0 THEN 'chosen must be a non-empty string'
  WHEN rejected IS NULL OR length(rejected) = 0 THEN 'rejected must be a non-empty string'
  END AS error FROM v_reject)
"""


@query("str_ingest", _INGEST_SQL)
def str_ingest(t):
    """STR-1: stream v_reject files through validation into valid / quarantine sinks."""
    return mo.ingest_stream(V.v_reject(t), "pair_id")


@query("str_ingest_batch", _INGEST_SQL)
def str_ingest_batch(t):
    """STR-1 batch twin: the same validation over the static table."""
    from prefsight.sources import io
    from prefsight.operators.text import render
    tagged = io.tag_errors(V.v_reject(t))
    ok = F.col("error").isNull()
    return tagged.select("pair_id", F.when(ok, F.lit("valid")).otherwise(F.lit("rejected")).alias("status"), "error",
                         F.when(ok, render(F.col("prompt"), F.col("chosen"))).alias("chosen_text"),
                         F.when(ok, render(F.col("prompt"), F.col("rejected"))).alias("rejected_text"))


@query("str_calibration", _CAL_SQL, rnd=["accuracy", "mean_margin", "ece", "brier", "mce"])
def str_calibration(t):
    """STR-2: daily calibration per group from a file stream (watermark 1 h, append)."""
    rows = margins_ts(t)
    return mo.run_file_stream(rows, "ts", lambda x: mo.windowed_calibration(x, window=WINDOW, watermark=WATERMARK),
                              "calibration", mo.closing_row(rows, AHEAD))


@query("str_calibration_batch", _CAL_SQL,
       rnd=["accuracy", "mean_margin", "ece", "brier", "mce"])
def str_calibration_batch(t):
    """STR-2 batch twin."""
    return mo.windowed_calibration(margins_ts(t), window=WINDOW)


_READINESS_SQL = f"""
WITH c AS ({_CAL_SQL})
SELECT window_start, grp, n, accuracy, ece, mean_margin,
       greatest(0.0e0, least(1.0e0, 0.5e0 * accuracy + 0.3e0 * greatest(0.0e0, 1 - ece * 5)
         - CASE WHEN abs(mean_margin) > 3.0e0 THEN least(0.2e0, (abs(mean_margin) - 3.0e0) * 0.1e0)
                ELSE 0.0e0 END)) AS rl_readiness,
       abs(mean_margin) > 2.0e0 AS margin_warning
FROM c
"""


@query("str_readiness", _READINESS_SQL, rnd=["accuracy", "ece", "mean_margin", "rl_readiness"])
def str_readiness(t):
    """STR-3: windowed readiness monitor with the margin warning (stream)."""
    rows = margins_ts(t)
    return mo.run_file_stream(rows, "ts", lambda x: mo.windowed_readiness(x, window=WINDOW, watermark=WATERMARK),
                              "readiness", mo.closing_row(rows, AHEAD))


@query("str_readiness_batch", _READINESS_SQL, rnd=["accuracy", "ece", "mean_margin", "rl_readiness"])
def str_readiness_batch(t):
    """STR-3 batch twin."""
    return mo.windowed_readiness(margins_ts(t), window=WINDOW)


_ROLLUP_SQL = f"""
WITH s AS (SELECT l.run_id, l.step, l.name, l.value, e.ts FROM v_metric_log l
           JOIN events e ON e.event_id = l.step)
SELECT {_WSTART} AS window_start, run_id, name, avg(value) AS value, count(*) AS n_steps
FROM s GROUP BY 1, run_id, name
"""


@query("str_rollup", _ROLLUP_SQL, rnd=["value"])
def str_rollup(t):
    """STR-4: windowed step-metric rollup per run (stream)."""
    rows = steps_ts(t)
    return mo.run_file_stream(rows, "ts", lambda x: mo.windowed_rollup(x, window=WINDOW, watermark=WATERMARK),
                              "rollup", mo.closing_row(rows, AHEAD))


@query("str_rollup_batch", _ROLLUP_SQL, rnd=["value"])
def str_rollup_batch(t):
    """STR-4 batch twin."""
    return mo.windowed_rollup(steps_ts(t), window=WINDOW)


_MARGINS_SQL = f"""
WITH m AS ({_MARGINS_TS})
SELECT {_WSTART} AS window_start, grp, count(*) AS n,
       sum(CASE WHEN margin > 0.7e0 THEN 1 ELSE 0 END) / count(*) AS easy_fraction,
       sum(CASE WHEN margin >= 0.2e0 AND margin <= 0.7e0 THEN 1 ELSE 0 END) / count(*) AS medium_fraction,
       sum(CASE WHEN margin < 0.2e0 THEN 1 ELSE 0 END) / count(*) AS hard_fraction,
       CAST(sum(CASE WHEN margin < -0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS mislabel_alerts
FROM m GROUP BY 1, grp
"""


@query("str_margins", _MARGINS_SQL, rnd=["easy_fraction", "medium_fraction", "hard_fraction"])
def str_margins(t):
    """STR-5: rolling margin drift and mislabel alerts (stream)."""
    rows = margins_ts(t)
    return mo.run_file_stream(rows, "ts", lambda x: mo.windowed_margin_drift(x, window=WINDOW, watermark=WATERMARK),
                              "drift", mo.closing_row(rows, AHEAD))


@query("str_margins_batch", _MARGINS_SQL, rnd=["easy_fraction", "medium_fraction", "hard_fraction"])
def str_margins_batch(t):
    """STR-5 batch twin."""
    return mo.windowed_margin_drift(margins_ts(t), window=WINDOW)
