"""ENS-* queries: the three v_scores models as an ensemble over order pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefsight.operators import ensemble as en
from prefsight.operators import scoring as sc
from prefsight.plans.q_scoring import MODELS, _MODEL_IDS_SQL, _W
from prefsight.plans.registry import query
from prefsight.sources import views as V

THRESHOLD = 1.0  # the reference default 0.5 flags most pairs of this data

_PRED = f"""
SELECT pair_id, avg(margin) AS mean_reward, stddev_pop(margin) AS std_reward,
       count(*) AS n_models, min(margin) AS min_reward, max(margin) AS max_reward,
       stddev_pop(margin) > {THRESHOLD!r}e0 AS is_high_uncertainty
FROM v_scores GROUP BY pair_id
"""


def _pred(t):
    return en.predict(V.v_scores(t), ["pair_id"], "margin", threshold=THRESHOLD)


@query("ens_predict", f"""
WITH p AS ({_PRED}),
l AS (SELECT pair_id, string_agg(CAST(CAST(round(margin * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY model_id)
             AS rewards_micro FROM v_scores GROUP BY pair_id)
SELECT p.*, l.rewards_micro FROM p JOIN l ON p.pair_id = l.pair_id
""", rnd=["mean_reward", "std_reward", "min_reward", "max_reward"])
def ens_predict(t):
    """ENS-1: per-pair ensemble mean, population std, uncertainty flag and the
    individual rewards by model (written in millionths)."""
    p = en.predict(V.v_scores(t), ["pair_id"], "margin", threshold=THRESHOLD, with_list=True,
                   models=[m[0] for m in V.SCORE_MODELS])
    micro = F.transform("rewards", lambda r: F.round(r * 1000000).cast("bigint").cast("string"))
    return p.withColumn("rewards_micro", F.array_join(micro, ",")).drop("rewards")


@query("ens_disagreement", f"""
WITH p AS ({_PRED})
SELECT avg(std_reward) AS mean_disagreement, max(std_reward) AS max_disagreement,
       stddev_pop(std_reward) AS std_disagreement,
       sum(CASE WHEN is_high_uncertainty THEN 1 ELSE 0 END) / count(*) AS ood_fraction,
       CAST(sum(CASE WHEN is_high_uncertainty THEN 1 ELSE 0 END) AS BIGINT) AS ood_count
FROM p
""", rnd=["mean_disagreement", "max_disagreement", "std_disagreement", "ood_fraction"])
def ens_disagreement(t):
    """ENS-2: disagreement summary over all pairs."""
    return en.disagreement(_pred(t))


@query("ens_ood", f"WITH p AS ({_PRED}) SELECT pair_id, std_reward FROM p WHERE is_high_uncertainty",
       rnd=["std_reward"])
def ens_ood(t):
    """ENS-3: out-of-distribution pairs (std above threshold)."""
    return en.detect_ood(_pred(t)).select("pair_id", "std_reward")


@query("ens_threshold", f"""
WITH p AS ({_PRED}),
r AS (SELECT std_reward, row_number() OVER (ORDER BY std_reward, pair_id) - 1 AS pos,
             count(*) OVER () AS n FROM p)
SELECT n, pos AS position, std_reward AS threshold FROM r
WHERE pos = least(CAST(floor(n * (1 - 0.1e0)) AS BIGINT), n - 1)
""", rnd=["threshold"])
def ens_threshold(t):
    """ENS-4: threshold giving a 10 % OOD rate (order statistic int(n*0.9))."""
    return en.calibrate_threshold(_pred(t), "pair_id", 0.1)


@query("ens_score_all", f"""
WITH s AS (SELECT e.vec_id, mm.model_id,
                  list_dot_product(CAST(e.embedding AS DOUBLE[]), {_W}) AS reward
           FROM embeddings e, {_MODEL_IDS_SQL})
SELECT vec_id, avg(reward) AS mean_reward, stddev_pop(reward) AS std_reward, count(*) AS n_models
FROM s GROUP BY vec_id
""", rnd=["mean_reward", "std_reward"])
def ens_score_all(t):
    """ENS-5: score every embedded response with every ensemble member in one pass."""
    scored = sc.score_all(t.embeddings, MODELS, "embedding", keep=["vec_id"])
    return scored.groupBy("vec_id").agg(F.avg("reward").alias("mean_reward"),
                                        F.stddev_pop("reward").alias("std_reward"),
                                        F.count(F.lit(1)).alias("n_models"))
