"""RDY-* queries: readiness of every run / epoch / model in one projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefsight.operators import ensemble as en
from prefsight.operators import evaluate as ev
from prefsight.operators import landscape as ls
from prefsight.operators import readiness as rd
from prefsight.operators import scoring as sc
from prefsight.plans import sql_fn as S
from prefsight.plans import sql_numeric as N
from prefsight.plans.q_scoring import _MODEL_IDS_SQL, MODELS
from prefsight.plans.registry import query
from prefsight.plans.sql_views import linear_weights_sql
from prefsight.sources import views as V

_OUT = ["overall_score", "accuracy_score", "calibration_score", "stability_score",
        "landscape_score", "margin_penalty", "disagreement_penalty"]


def _score_sql(a: str, e: str, v: str, lam: str, m: str, d: str) -> str:
    """SQL twin of ``readiness.readiness`` with the default weights."""
    acc_s = f"least(1.0e0, {a})"
    cal_s = f"greatest(0.0e0, 1 - {e} * 5)"
    stab_s = f"greatest(0.0e0, 1 - ({v} - 0.5e0) / 2.5e0)"
    land_s = f"greatest(0.0e0, 1 - ({lam} - 50) / 450.0e0)"
    m_pen = f"CASE WHEN abs({m}) > 3.0e0 THEN least(0.2e0, (abs({m}) - 3.0e0) * 0.05e0) ELSE 0.0e0 END"
    d_pen = f"CASE WHEN {d} > 0.5e0 THEN least(0.15e0, ({d} - 0.5e0) * 0.3e0) ELSE 0.0e0 END"
    total = (f"(0.35e0 * {acc_s} + 0.25e0 * {cal_s} + 0.25e0 * {stab_s} + 0.15e0 * {land_s}"
             f" - {m_pen} - {d_pen})")
    overall = f"greatest(0.0e0, least(1.0e0, {total}))"
    verdict = (f"CASE WHEN {overall} >= 0.8e0 THEN '{rd.VERDICT_READY}' WHEN {overall} >= 0.6e0 "
               f"THEN '{rd.VERDICT_ACCEPTABLE}' ELSE '{rd.VERDICT_NOT}' END")
    issues = ("array_to_string(list_filter([" + ", ".join([
        f"CASE WHEN {a} < 0.7e0 THEN 'accuracy' END",
        f"CASE WHEN {e} > 0.1e0 THEN 'calibration' END",
        f"CASE WHEN {v} > 2.0e0 THEN 'variance' END",
        f"CASE WHEN {lam} > 200 THEN 'sharpness' END",
        f"CASE WHEN abs({m}) > 3.0e0 THEN 'margin' END",
        f"CASE WHEN {d} > 0.5e0 THEN 'disagreement' END"]) + "], lambda x: x IS NOT NULL), ',')")
    return (f"{overall} AS overall_score, {acc_s} AS accuracy_score, {cal_s} AS calibration_score, "
            f"{stab_s} AS stability_score, {land_s} AS landscape_score, {m_pen} AS margin_penalty, "
            f"{d_pen} AS disagreement_penalty, {verdict} AS verdict, {issues} AS issues")


def _messages_sql(a: str, e: str, v: str, lam: str, m: str, d: str, verdict: str = "verdict") -> str:
    """SQL twin of the recommendations, joined by line breaks."""
    def said(code: str, value: str) -> str:
        text, scale = rd.MESSAGES[code].replace(chr(39), chr(39) * 2), f"1e{rd.message_digits(code)}"
        return f"printf('{text}', floor(({value}) * {scale} + 0.5e0) / {scale})"
    parts = [verdict] + [f"CASE WHEN {when} THEN {said(k, value)} END" for k, when, value in (
        ("accuracy", f"{a} < 0.7e0", f"{a} * 100"), ("calibration", f"{e} > 0.1e0", e), ("variance", f"{v} > 2.0e0", v),
        ("sharpness", f"{lam} > 200", lam), ("margin", f"abs({m}) > 3.0e0", m), ("disagreement", f"{d} > 0.5e0", d))]
    return ("array_to_string(list_filter([" + ", ".join(parts)
            + "], lambda x: x IS NOT NULL), chr(10)) AS recommendations")


def _runs_inputs(t):
    r = V.v_runs(t)
    return r.select("optimizer", "seed", F.col("final_val_accuracy").alias("accuracy"),
                    F.col("calibration_ece").alias("ece"),
                    (F.col("final_val_loss") * 4).alias("reward_variance"), "top_eigenvalue",
                    (F.col("final_val_loss") * 8 - 1).alias("margin_mean"),
                    (F.col("calibration_ece") * 6).alias("ensemble_disagreement"))


@query("rdy_score", f"""
WITH i AS (SELECT optimizer, seed, final_val_accuracy AS accuracy, calibration_ece AS ece,
                  final_val_loss * 4 AS reward_variance, top_eigenvalue, final_val_loss * 8 - 1 AS margin_mean,
                  calibration_ece * 6 AS ensemble_disagreement FROM v_runs),
s AS (SELECT *, {_score_sql('accuracy', 'ece', 'reward_variance', 'top_eigenvalue',
                            'margin_mean', 'ensemble_disagreement')} FROM i)
SELECT optimizer, seed, {", ".join(_OUT)}, verdict, issues,
       {_messages_sql('accuracy', 'ece', 'reward_variance', 'top_eigenvalue', 'margin_mean', 'ensemble_disagreement')}
FROM s
""", rnd=_OUT)
def rdy_score(t):
    """RDY-1: composite readiness of every (optimizer, seed) run with recommendations."""
    out = rd.readiness(_runs_inputs(t), "accuracy", "ece", "reward_variance", "top_eigenvalue",
                       "margin_mean", "ensemble_disagreement")
    return out.select("optimizer", "seed", *_OUT, "verdict", "issues",
                      F.array_join("recommendations", "\n").alias("recommendations"))


_PIVOT_NAMES = [n for n, _ in V.METRIC_LOG_NAMES]
_PIVOT_SQL = ("SELECT run_id, epoch, " + ", ".join(
    f"avg(CASE WHEN name = '{n}' THEN value END) AS {n}" for n in _PIVOT_NAMES)
    + " FROM v_metric_log GROUP BY run_id, epoch")


def epoch_metrics(t):
    """(run, epoch) x metric table pivoted from the step log (names listed,
    so the pivot needs no extra job to discover values)."""
    return V.v_metric_log(t).groupBy("run_id", "epoch").pivot("name", _PIVOT_NAMES).avg("value")


@query("rdy_from_metrics", f"""
WITH m AS ({_PIVOT_SQL})
SELECT run_id, epoch, {_score_sql('coalesce(val_accuracy, 0.8e0)', 'coalesce(calibration_ece, 0.1e0)',
                                  '1.0e0', '100.0e0', 'coalesce(margin_mean, 0.5e0)', '0.3e0')} FROM m
""", rnd=_OUT)
def rdy_from_metrics(t):
    """RDY-2: readiness from an epoch metrics table with key fallbacks."""
    out = rd.readiness_from_metrics(epoch_metrics(t))
    return out.select("run_id", "epoch", *_OUT, "verdict", "issues")


@query("rdy_end_to_end", f"""
WITH w AS (SELECT mm.model_id AS run, {linear_weights_sql("mm.model_id")} AS w FROM {_MODEL_IDS_SQL}),{
    N.gram_cte("gram", "v_pairs_feat", "w", V.FEATURE_DIM)},{N.dominant_cte("top", "gram", "gram", 30)},
sc AS MATERIALIZED (SELECT pair_id, run AS model_id, list_dot_product(d, w) AS margin FROM v_pairs_feat, w),
p AS (SELECT pair_id, stddev_pop(margin) AS sd FROM sc GROUP BY pair_id),
d AS (SELECT avg(sd) AS dis FROM p),
cal AS (SELECT model_id, margin, {S.sigmoid('margin')} AS pr FROM sc),
cb AS (SELECT *, {S.bin_case('pr')} AS bin FROM cal),
pb AS (SELECT model_id, bin, count(*) AS c, avg(pr) - 1.0e0 AS gap FROM cb WHERE bin IS NOT NULL
       GROUP BY model_id, bin),
m AS (SELECT model_id, count(*) AS n, avg(CASE WHEN margin > 0 THEN 1.0e0 ELSE 0.0e0 END) AS accuracy,
             var_pop(margin) AS reward_variance, avg(margin) AS margin_mean FROM cb GROUP BY model_id),
e AS (SELECT m.model_id, m.accuracy, m.reward_variance, m.margin_mean, t.value AS top_eigenvalue,
             coalesce(sum(abs(pb.gap) * pb.c), 0) / m.n AS ece
      FROM m JOIN top t ON t.run = m.model_id LEFT JOIN pb ON pb.model_id = m.model_id
      GROUP BY m.model_id, m.n, m.accuracy, m.reward_variance, m.margin_mean, t.value)
SELECT e.model_id, e.accuracy, e.ece, e.reward_variance, e.top_eigenvalue, e.margin_mean,
       d.dis AS ensemble_disagreement,
       {_score_sql('e.accuracy', 'e.ece', 'e.reward_variance', 'e.top_eigenvalue', 'e.margin_mean',
                   'd.dis')}
FROM e, d
""", rnd=["accuracy", "ece", "reward_variance", "top_eigenvalue", "margin_mean",
          "ensemble_disagreement", *_OUT])
def rdy_end_to_end(t):
    """RDY-3: readiness of every linear model computed from the pairs: accuracy and ECE
    (EVL), margin variance and mean, ensemble disagreement (ENS-2) and the top eigenvalue
    of its Hessian (LND-3), all models sharing each curvature pass."""
    pairs = V.v_pairs_feat(t).checkpoint()
    s = sc.pair_margins(pairs, MODELS)
    cal = ev.calibration_report(s, ["model_id"])
    about = s.groupBy("model_id").agg(F.var_pop("margin").alias("reward_variance"), F.avg("margin").alias("margin_mean"))
    ids = sorted(MODELS.weights)
    cur = ls.ManyCurvature(pairs, [MODELS.weights[i] for i in ids])
    try:
        tops = cur.top_eigenvalues(1)
    finally:
        cur.unpersist()
    top = t.spark.createDataFrame([(i, float(v[0])) for i, v in zip(ids, tops)], "model_id int, top_eigenvalue double")
    dis = en.disagreement(en.predict(s, ["pair_id"], "margin")).select(
        F.col("mean_disagreement").alias("ensemble_disagreement"), F.lit(0).alias("_k"))
    base = (cal.select("model_id", "accuracy", "ece").join(about, "model_id").join(top, "model_id")
            .withColumn("_k", F.lit(0)).join(F.broadcast(dis), "_k").drop("_k"))
    out = rd.readiness(base, "accuracy", "ece", "reward_variance", "top_eigenvalue",
                       "margin_mean", "ensemble_disagreement", messages=False)
    return out.select("model_id", "accuracy", "ece", "reward_variance", "top_eigenvalue",
                      "margin_mean", "ensemble_disagreement", *_OUT, "verdict", "issues")


@query("rdy_epoch_monitor", f"""
WITH m AS ({_PIVOT_SQL}),
s AS (SELECT run_id, epoch, coalesce(val_accuracy, 0.0e0) AS a, coalesce(calibration_ece, 0.1e0) AS e,
             coalesce(margin_mean, 0.0e0) AS mm FROM m)
SELECT run_id, epoch,
       greatest(0.0e0, least(1.0e0, 0.5e0 * a + 0.3e0 * greatest(0.0e0, 1 - e * 5)
         - CASE WHEN abs(mm) > 3.0e0 THEN least(0.2e0, (abs(mm) - 3.0e0) * 0.1e0) ELSE 0.0e0 END))
         AS rl_readiness,
       abs(mm) > 2.0e0 AS margin_warning
FROM s
""", rnd=["rl_readiness"])
def rdy_epoch_monitor(t):
    """RDY-4: per-epoch in-training readiness with the margin warning."""
    out = rd.epoch_monitor(epoch_metrics(t))
    return out.select("run_id", "epoch", "rl_readiness", "margin_warning")
