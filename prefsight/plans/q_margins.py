"""MRG-* queries over v_margins / v_metric_log."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefsight.operators import margins as mg
from prefsight.operators.indexing import global_index
from prefsight.plans import sql_fn as S
from prefsight.plans.registry import query
from prefsight.sources import views as V

_BUCKET_SQL = ("CASE WHEN isnan(margin) OR margin IS NULL THEN NULL WHEN margin > 0.7e0 THEN 'easy' "
               "WHEN margin < 0.2e0 THEN 'hard' ELSE 'medium' END")


@query("mrg_stats", """
SELECT grp, count(*) AS n, avg(margin) AS mean, stddev_pop(margin) AS std, min(margin) AS min,
       max(margin) AS max, quantile_cont(margin, 0.25) AS p25, quantile_cont(margin, 0.5) AS p50,
       quantile_cont(margin, 0.75) AS p75,
       sum(CASE WHEN margin > 0.7e0 THEN 1 ELSE 0 END) / count(*) AS easy_fraction,
       (count(*) - sum(CASE WHEN margin > 0.7e0 THEN 1 ELSE 0 END)
                 - sum(CASE WHEN margin < 0.2e0 THEN 1 ELSE 0 END)) / count(*) AS medium_fraction,
       sum(CASE WHEN margin < 0.2e0 THEN 1 ELSE 0 END) / count(*) AS hard_fraction
FROM v_margins GROUP BY grp
""", rnd=["mean", "std", "min", "max", "p25", "p50", "p75", "easy_fraction", "medium_fraction",
          "hard_fraction"])
def mrg_stats(t):
    """MRG-2: margin statistics with exact quartiles, per group."""
    return mg.margin_statistics(V.v_margins(t), ["grp"])


@query("mrg_bucket", f"SELECT pair_id, margin, {_BUCKET_SQL} AS difficulty FROM v_margins",
       rnd=["margin"])
def mrg_bucket(t):
    """MRG-3: difficulty bucket per pair (edges 0.2 and 0.7 are medium)."""
    return mg.with_difficulty(V.v_margins(t)).select("pair_id", "margin", "difficulty")


@query("mrg_mislabeled", """
SELECT pair_id, grp, margin, row_number() OVER (ORDER BY margin, pair_id) - 1 AS suspicion_rank
FROM v_margins WHERE margin < -0.5e0
""", rnd=["margin"])
def mrg_mislabeled(t):
    """MRG-4: suspected mislabels (margin < -0.5), ranked most negative first."""
    sus = mg.find_mislabeled(V.v_margins(t))
    return global_index(sus, ["margin", "pair_id"], "suspicion_rank") \
        .select("pair_id", "grp", "margin", "suspicion_rank")


@query("mrg_schedule", """
WITH e AS (SELECT DISTINCT run_id, epoch FROM v_metric_log),
tot AS (SELECT run_id, max(epoch) + 1 AS total_epochs FROM e GROUP BY run_id),
p AS (SELECT e.run_id, e.epoch, tot.total_epochs,
             CAST(e.epoch AS DOUBLE) / tot.total_epochs AS progress
      FROM e JOIN tot ON e.run_id = tot.run_id)
SELECT run_id, epoch, total_epochs, progress,
       CASE WHEN progress < 0.3e0 THEN 0.5e0 WHEN progress < 0.7e0 THEN 0.2e0 ELSE 0.1e0 END AS easy_weight,
       CASE WHEN progress < 0.3e0 THEN 0.4e0 WHEN progress < 0.7e0 THEN 0.6e0 ELSE 0.5e0 END AS medium_weight,
       CASE WHEN progress < 0.3e0 THEN 0.1e0 WHEN progress < 0.7e0 THEN 0.2e0 ELSE 0.4e0 END AS hard_weight
FROM p
""", rnd=["progress", "easy_weight", "medium_weight", "hard_weight"])
def mrg_schedule(t):
    """MRG-5: curriculum weights for every logged epoch of every run."""
    e = V.v_metric_log(t).select("run_id", "epoch").distinct()
    tot = e.groupBy("run_id").agg((F.max("epoch") + 1).alias("total_epochs"))
    return mg.curriculum_schedule(e.join(tot, "run_id")) \
        .select("run_id", "epoch", "total_epochs", "progress", "easy_weight", "medium_weight",
                "hard_weight")


_CURR_N = 1000


@query("mrg_curriculum", f"""
WITH d AS (SELECT pair_id, margin, {_BUCKET_SQL} AS bucket FROM v_margins),
pos AS (SELECT pair_id, margin, bucket,
               row_number() OVER (PARTITION BY bucket ORDER BY margin, pair_id) - 1 AS bpos
        FROM d WHERE bucket IS NOT NULL),
sizes AS (SELECT bucket, count(*) AS bsize FROM pos GROUP BY bucket),
draws AS (
  SELECT 'easy' AS bucket, range AS draw FROM range({int(_CURR_N * 0.2)})
  UNION ALL SELECT 'medium', range FROM range({int(_CURR_N * 0.6)})
  UNION ALL SELECT 'hard', range FROM range({int(_CURR_N * 0.2)})),
dd AS (SELECT d.bucket, d.draw, {S.hash_key(42, 'd.bucket', 'd.draw')} AS h, s.bsize
       FROM draws d JOIN sizes s ON s.bucket = d.bucket)
SELECT {S.hash_key(43, 'dd.bucket', 'dd.draw')} AS draw_order, dd.bucket, dd.draw, p.pair_id, p.margin
FROM dd JOIN pos p ON p.bucket = dd.bucket AND p.bpos = dd.h % dd.bsize
""", rnd=["margin"])
def mrg_curriculum(t):
    """MRG-6: curriculum sample of 1000 with replacement, default weights."""
    return mg.curriculum_sample(V.v_margins(t), _CURR_N)


@query("mrg_weights", f"""
WITH d AS (SELECT pair_id, margin, {_BUCKET_SQL} AS bucket FROM v_margins),
c AS (SELECT bucket, count(*) AS bsize,
             CASE bucket WHEN 'easy' THEN 0.2e0 WHEN 'medium' THEN 0.6e0 ELSE 0.2e0 END AS bw
      FROM d WHERE bucket IS NOT NULL GROUP BY bucket),
cw AS (SELECT bucket, bw / bsize / sum(bw) OVER () AS row_w FROM c)
SELECT d.pair_id, d.margin, d.bucket, coalesce(cw.row_w, 0.0e0) AS weight
FROM d LEFT JOIN cw ON cw.bucket = d.bucket
""", rnd=["margin", "weight"])
def mrg_weights(t):
    """MRG-7: per-row sampling weight w_b / n_b, normalised."""
    return mg.sampling_weights(V.v_margins(t))
