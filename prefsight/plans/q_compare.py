"""CMP-* queries: optimizer comparison over v_runs and trained grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefsight.operators import compare as cp
from prefsight.operators import evaluate as ev
from prefsight.operators import landscape as ls
from prefsight.operators import readiness as rd
from prefsight.operators import scoring as sc
from prefsight.operators import train as tr
from prefsight.operators import train_logs as tl
from prefsight.plans import sql_fn as S
from prefsight.plans import sql_numeric as N
from prefsight.plans.q_readiness import _score_sql
from prefsight.plans.registry import query
from prefsight.sources import io
from prefsight.sources import views as V

DIM = V.FEATURE_DIM
OPTIMIZERS = ["adam", "adamw", "sgd", "muon", "lion"]
SEEDS = [0, 1, 2]
_STEPS, _LR, _WARMUP = 20, 0.05, 2


def _trained_sql(runs) -> str:
    """Training unrolled, then the evaluation (``result``) and spectrum of every run."""
    return f"""
WITH parts AS MATERIALIZED (SELECT pair_id, d, ({S.hash_key(42, 'pair_id')} % 1000000) / 1000000.0e0 AS u FROM v_pairs_feat),
train AS MATERIALIZED (SELECT pair_id, d FROM parts WHERE u < 0.8e0),
val AS MATERIALIZED (SELECT pair_id, d FROM parts WHERE u >= 0.8e0),{
    N.training_ctes("train", runs, DIM, _STEPS, _LR, _WARMUP)},{N.gram_cte("gram", "train", "weights", DIM)},{N.spectrum_ctes("gram")},
fit AS (SELECT run, avg({S.softplus_neg('m')}) AS loss, avg(CASE WHEN m > 0 THEN 1.0e0 ELSE 0.0e0 END) AS accuracy
        FROM (SELECT run, list_dot_product(d, w) AS m FROM train, weights) GROUP BY run),
vm AS MATERIALIZED (SELECT run, pair_id, list_dot_product(d, w) AS m FROM val, weights),
vb AS (SELECT *, {S.bin_case('p')} AS bin FROM (SELECT *, {S.sigmoid('m')} AS p FROM vm)),
gaps AS (SELECT run, sum(g) AS g FROM (SELECT run, bin, abs(sum(p - 1.0e0)) AS g FROM vb WHERE bin IS NOT NULL GROUP BY run, bin)
         GROUP BY run),
held AS (SELECT run, count(*) AS n, avg(CASE WHEN m > 0 THEN 1.0e0 ELSE 0.0e0 END) AS accuracy, avg({S.softplus_neg('m')}) AS loss,
                avg((p - 1) * (p - 1)) AS brier, var_pop(m) AS reward_variance, avg(m) AS margin_mean FROM vb GROUP BY run),
result AS (
  SELECT r.run, r.optimizer, CAST(r.seed AS INTEGER) AS seed, fit.loss AS final_train_loss, fit.accuracy AS final_train_accuracy,
         h.n AS n_validation, h.accuracy AS final_val_accuracy, h.loss AS final_val_loss,
         coalesce(g.g, 0.0e0) / h.n AS calibration_ece, h.brier AS calibration_brier, t.value AS top_eigenvalue,
         mo.trace AS trace_estimate, t.value / abs(b.value) AS condition_number, mo.trace * mo.trace / mo.sq AS effective_rank,
         t.value / mo.trace AS sharpness_score, 1.0e0 / t.value AS flatness_index, true AS is_full,
         h.reward_variance, h.margin_mean
  FROM runs r JOIN fit ON fit.run = r.run JOIN held h ON h.run = r.run LEFT JOIN gaps g ON g.run = r.run
  JOIN top t ON t.run = r.run JOIN bottom b ON b.run = r.run JOIN moments mo ON mo.run = r.run)"""


_RESULT = ["final_train_loss", "final_train_accuracy", "final_val_accuracy", "final_val_loss", "calibration_ece",
           "calibration_brier", "top_eigenvalue", "trace_estimate", "condition_number", "effective_rank",
           "sharpness_score", "flatness_index"]


@query("cmp_grid", f"""{_trained_sql([(o, s) for o in OPTIMIZERS for s in SEEDS])}
SELECT * EXCLUDE (run, reward_variance, margin_mean), CAST({_STEPS} AS INTEGER) AS steps FROM result
""", rnd=_RESULT)
def cmp_grid(t):
    """CMP-1: 5 optimizers x 3 seeds trained together (one pass per step for
    all 15 runs); final loss / accuracy, held-out evaluation and spectrum of each run.

    The pairs are split 80 / 20 as in CMP-2; a pass scores the held-out pairs with
    all weight vectors, and one pass gives the Hessians of all runs."""
    parts = io.split(V.v_pairs_feat(t), "pair_id", fractions=(0.8, 0.2, 0.0)).checkpoint()
    train, val = parts.filter("split = 'train'"), parts.filter("split = 'validation'")
    states = tr.fit_many(train, [(o, s) for o in OPTIMIZERS for s in SEEDS], DIM, steps=_STEPS, lr=_LR, warmup=_WARMUP)
    states = [s for s in states if not s.failed]
    rows = [(i, s.optimizer, s.seed, s.final_loss, s.final_accuracy, len(s.log)) for i, s in enumerate(states)]
    runs = t.spark.createDataFrame(rows, "run long, optimizer string, seed int, final_train_loss double, "
                                         "final_train_accuracy double, steps int")
    eigenvalues = []
    if states:
        cur = ls.ManyCurvature(train, [s.w for s in states])
        try:
            eigenvalues = [(i, float(v)) for i, values in enumerate(cur.spectra()) for v in values]
        finally:
            cur.unpersist()
    spectrum = t.spark.createDataFrame(eigenvalues, "run long, eigenvalue double")
    spec = ls.spectrum_summary(spectrum, ["run"], dim=DIM)
    margins = sc.pair_margins(val, sc.LinearModels({i: list(s.w) for i, s in enumerate(states)}))
    evaluation = ev.calibration_report(margins.withColumn("run", F.col("model_id").cast("long")), ["run"])
    return runs.join(evaluation, "run", "left").join(spec, "run", "left").select(
        "optimizer", "seed", "final_train_loss", "final_train_accuracy", "steps",
        F.col("n").alias("n_validation"), F.col("accuracy").alias("final_val_accuracy"),
        F.col("loss").alias("final_val_loss"), F.col("ece").alias("calibration_ece"),
        F.col("brier").alias("calibration_brier"), "top_eigenvalue", F.col("trace").alias("trace_estimate"),
        "condition_number", "effective_rank", "sharpness_score", "flatness_index", "is_full")


@query("cmp_run", f"""{_trained_sql([("adamw", s) for s in SEEDS])},
spread AS (SELECT avg(sd) AS dis FROM (SELECT pair_id, stddev_pop(m) AS sd FROM vm GROUP BY pair_id)),
one AS (SELECT result.*, spread.dis AS ensemble_disagreement FROM result, spread WHERE run = 0)
SELECT * EXCLUDE (run, overall_score, accuracy_score, calibration_score, stability_score, landscape_score, margin_penalty,
                  disagreement_penalty, verdict, issues), overall_score AS rl_readiness_score
FROM (SELECT *, {_score_sql('final_val_accuracy', 'calibration_ece', 'reward_variance', 'top_eigenvalue', 'margin_mean',
                            'ensemble_disagreement')} FROM one)
""", rnd=[*_RESULT, "reward_variance", "margin_mean", "ensemble_disagreement", "rl_readiness_score"])
def cmp_run(t):
    """CMP-2: train one run, evaluate it on held-out pairs, measure its spectrum and readiness.

    The pairs are split 80 / 20.  All eigenvalues and the trace enter the
    spectrum; reward variance and mean margin are those of the validation
    margins, and disagreement is their spread over three seeds trained together."""
    parts = io.split(V.v_pairs_feat(t), "pair_id", fractions=(0.8, 0.2, 0.0)).checkpoint()
    train, val = parts.filter("split = 'train'"), parts.filter("split = 'validation'")
    states = tr.fit_many(train, [("adamw", s) for s in SEEDS], DIM, steps=_STEPS, lr=_LR, warmup=_WARMUP)
    st = states[0]
    margins = sc.pair_margins(val, sc.LinearModels({s.seed: list(s.w) for s in states}))
    spread = (margins.groupBy("pair_id").agg(F.stddev_pop("margin").alias("s"))
              .agg(F.avg("s").alias("ensemble_disagreement")).withColumn("_k", F.lit(0)))
    mine = margins.filter(F.col("model_id") == st.seed)
    about = mine.agg(F.var_pop("margin").alias("reward_variance"), F.avg("margin").alias("margin_mean"))
    evaluation = ev.calibration_report(mine, ["model_id"])
    cur = ls.Curvature(train, st.w)
    try:
        eig = cur.eigenvalues_full()
    finally:
        cur.unpersist()
    run = "adamw_0"
    trace = t.spark.createDataFrame([(run, float(eig.sum()))], "run_id string, trace double")
    spec = ls.spectrum_summary(ls.spectrum_frame(t.spark, eig, run), trace=trace, dim=DIM)
    row = (evaluation.withColumn("_k", F.lit(0)).join(spec.withColumn("_k", F.lit(0)), "_k")
           .join(about.withColumn("_k", F.lit(0)), "_k").join(spread, "_k").drop("_k"))
    row = row.select(F.lit("adamw").alias("optimizer"), F.lit(st.seed).alias("seed"),
                     F.lit(st.final_loss).alias("final_train_loss"),
                     F.lit(st.final_accuracy).alias("final_train_accuracy"),
                     F.col("n").alias("n_validation"),
                     F.col("accuracy").alias("final_val_accuracy"), F.col("loss").alias("final_val_loss"),
                     F.col("ece").alias("calibration_ece"), F.col("brier").alias("calibration_brier"),
                     "top_eigenvalue", F.col("trace").alias("trace_estimate"), "condition_number",
                     "effective_rank", "sharpness_score", "flatness_index", "is_full",
                     "reward_variance", "margin_mean", "ensemble_disagreement")
    scored = rd.readiness(row, "final_val_accuracy", "calibration_ece", "reward_variance", "top_eigenvalue",
                          "margin_mean", "ensemble_disagreement", messages=False)
    return scored.drop("accuracy_score", "calibration_score", "stability_score", "landscape_score",
                       "margin_penalty", "disagreement_penalty", "verdict", "issues") \
        .withColumnRenamed("overall_score", "rl_readiness_score")


@query("cmp_summary", """
SELECT optimizer, count(*) AS runs, avg(final_val_accuracy) AS val_accuracy_mean,
       stddev_pop(final_val_accuracy) AS val_accuracy_std, avg(top_eigenvalue) AS top_eigenvalue_mean,
       stddev_pop(top_eigenvalue) AS top_eigenvalue_std, avg(condition_number) AS condition_number_mean,
       avg(sharpness_score) AS sharpness_mean, avg(flatness_index) AS flatness_mean,
       avg(training_time_seconds) AS training_time_mean
FROM v_runs GROUP BY optimizer
""", rnd=["val_accuracy_mean", "val_accuracy_std", "top_eigenvalue_mean", "top_eigenvalue_std",
          "condition_number_mean", "sharpness_mean", "flatness_mean", "training_time_mean"])
def cmp_summary(t):
    """CMP-3: the per-optimizer summary report."""
    return cp.summary_report(V.v_runs(t))


@query("cmp_metric", """
SELECT optimizer, avg(coalesce(rl_readiness_score, 0.0e0)) AS mean,
       stddev_pop(coalesce(rl_readiness_score, 0.0e0)) AS std, count(*) AS points
FROM v_runs GROUP BY optimizer
""", rnd=["mean", "std"])
def cmp_metric(t):
    """CMP-4: one metric's mean / std per optimizer (missing counts as 0)."""
    return cp.metric_by_optimizer(V.v_runs(t), "rl_readiness_score")


_NAMES = [n for n, _ in V.METRIC_LOG_NAMES]
_EPOCH_SQL = ("SELECT run_id, epoch, " + ", ".join(
    f"avg(CASE WHEN name = '{n}' THEN value END) AS {n}" for n in _NAMES)
    + " FROM v_metric_log GROUP BY run_id, epoch")


@query("cmp_curves", f"""
WITH e AS ({_EPOCH_SQL})
SELECT run_id, CAST(dense_rank() OVER (PARTITION BY run_id ORDER BY epoch) AS INTEGER) AS epoch,
       {", ".join(_NAMES)} FROM e
""", rnd=_NAMES)
def cmp_curves(t):
    """CMP-5: training curves, one row per (run, epoch from 1), one column per metric."""
    return cp.training_curves(tl.epoch_table(V.v_metric_log(t), _NAMES))


@query("cmp_best", """
SELECT optimizer, seed, final_val_accuracy AS value FROM v_runs
ORDER BY final_val_accuracy DESC, optimizer, seed LIMIT 1
""", rnd=["value"])
def cmp_best(t):
    """CMP-6: the best run by validation accuracy."""
    return cp.best_run(V.v_runs(t), "final_val_accuracy")
