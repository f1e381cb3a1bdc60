"""RWD-* queries: linear reward models over embeddings, v_pairs_feat and v_scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefsight.operators import scoring as sc
from prefsight.plans import sql_fn as S
from prefsight.plans.registry import query
from prefsight.plans.sql_views import linear_weights_sql
from prefsight.sources import views as V

MODELS = sc.LinearModels({m: V.linear_weights(m) for m in V.LINEAR_MODEL_IDS})
_MODEL_IDS_SQL = "(VALUES " + ", ".join(f"({m})" for m in V.LINEAR_MODEL_IDS) + ") mm(model_id)"
_W = linear_weights_sql("mm.model_id")


@query("rwd_score", f"""
SELECT e.vec_id, mm.model_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), {_W}) AS reward
FROM embeddings e, {_MODEL_IDS_SQL}
""", rnd=["reward"])
def rwd_score(t):
    """RWD-1: reward w . phi of every embedded response under every model."""
    return sc.score_all(t.embeddings, MODELS, "embedding", keep=["vec_id"])


@query("rwd_score_with", f"""
SELECT e.vec_id, mm.model_id, tanh(list_dot_product(CAST(e.embedding AS DOUBLE[]), {_W})) AS reward
FROM embeddings e, {_MODEL_IDS_SQL}
""", rnd=["reward"])
def rwd_score_with(t):
    """Scorers of the user's own: Python functions of a batch of features,
    here a bounded reward of each linear model."""
    import numpy as np

    def bounded(w):
        return lambda x: np.tanh(x @ np.asarray(w))
    scorers = {m: bounded(w) for m, w in MODELS.weights.items()}
    return sc.score_with(t.embeddings, scorers, "embedding", keep=["vec_id"])


@query("rwd_margin", f"""
SELECT p.pair_id, mm.model_id, list_dot_product(p.d, {_W}) AS margin
FROM v_pairs_feat p, {_MODEL_IDS_SQL}
""", rnd=["margin"])
def rwd_margin(t):
    """RWD-2: pair margin w . (phi_chosen - phi_rejected) per model."""
    return sc.pair_margins(V.v_pairs_feat(t), MODELS)


@query("rwd_predict", f"""
SELECT pair_id, model_id, margin, margin > 0 AS correct FROM (
  SELECT p.pair_id, mm.model_id, list_dot_product(p.d, {_W}) AS margin
  FROM v_pairs_feat p, {_MODEL_IDS_SQL})
""", rnd=["margin"])
def rwd_predict(t):
    """RWD-3: predicted preference (correct when margin > 0)."""
    return sc.predict(sc.pair_margins(V.v_pairs_feat(t), MODELS))


@query("rwd_absolute", f"""
WITH s AS (SELECT e.vec_id, e.label, mm.model_id,
                  list_dot_product(CAST(e.embedding AS DOUBLE[]), {_W}) AS reward
           FROM embeddings e, {_MODEL_IDS_SQL}),
p AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
b AS (SELECT p.label, mm.model_id, 0.5e0 * list_dot_product(CAST(p.embedding AS DOUBLE[]), {_W}) AS baseline
      FROM p, {_MODEL_IDS_SQL})
SELECT s.vec_id, s.label, s.model_id, s.reward, b.baseline, s.reward - b.baseline AS absolute_reward
FROM s JOIN b ON s.label = b.label AND s.model_id = b.model_id
""", rnd=["reward", "baseline", "absolute_reward"])
def rwd_absolute(t):
    """RWD-4: reward minus that of the prompt's empty response (label = prompt)."""
    scored = sc.score_all(t.embeddings, MODELS, "embedding", keep=["vec_id", "label"])
    empty = sc.score_all(V.v_empty_responses(t), MODELS, "embedding", keep=["label"])
    return sc.absolute_reward(scored, empty, ["label"]).select(
        "vec_id", "label", "model_id", "reward", "baseline", "absolute_reward")


@query("rwd_bt_loss", f"""
SELECT model_id, avg({S.softplus_neg('margin')}) AS loss FROM v_scores GROUP BY model_id
""", rnd=["loss"])
def rwd_bt_loss(t):
    """RWD-5: mean Bradley-Terry loss per model."""
    return sc.bt_loss(V.v_scores(t), ["model_id"])


@query("rwd_batch_metrics", f"""
SELECT model_id, pair_id // 32 AS batch_id, count(*) AS n, avg({S.softplus_neg('r_a - r_b')}) AS loss,
       avg(CASE WHEN r_a - r_b > 0 THEN 1.0e0 ELSE 0.0e0 END) AS accuracy,
       avg(r_a - r_b) AS margin_mean, stddev_samp(r_a - r_b) AS margin_std,
       avg(r_a) AS chosen_reward_mean, avg(r_b) AS rejected_reward_mean
FROM v_scores GROUP BY model_id, pair_id // 32
""", rnd=["loss", "accuracy", "margin_mean", "margin_std", "chosen_reward_mean",
          "rejected_reward_mean"])
def rwd_batch_metrics(t):
    """RWD-6: per-batch loss, accuracy, margin mean / sample std, side means."""
    s = V.v_scores(t).withColumn("batch_id", F.floor(F.col("pair_id") / 32).cast("bigint"))
    return sc.batch_metrics(s, ["model_id", "batch_id"])
