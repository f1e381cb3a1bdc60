"""ACT-* queries: acquisition over the v_scores ensemble and the v_pool table."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefsight.functions import dot, lit_vector
from prefsight.operators import active as ac
from prefsight.operators import neighbours as nb
from prefsight.plans import sql_fn as S
from prefsight.plans import sql_numeric as N
from prefsight.plans.registry import query
from prefsight.plans.sql_views import linear_weights_sql
from prefsight.sources import views as V

_W1 = V.linear_weights(1)


@query("act_uncertainty", "SELECT pair_id, var_pop(margin) AS score FROM v_scores GROUP BY pair_id",
       rnd=["score"])
def act_uncertainty(t):
    """ACT-1: variance of the pair margin across the ensemble."""
    return ac.uncertainty_scores(V.v_scores(t), ["pair_id"])


@query("act_committee", """
WITH v AS (SELECT pair_id, avg(CASE WHEN margin > 0 THEN 1.0e0 ELSE 0.0e0 END) AS p_a
           FROM v_scores GROUP BY pair_id)
SELECT pair_id, p_a, CASE WHEN p_a = 0 OR p_a = 1 THEN 0.0e0
                          ELSE -(p_a * log2(p_a) + (1 - p_a) * log2(1 - p_a)) END AS score FROM v
""", rnd=["p_a", "score"])
def act_committee(t):
    """ACT-2: query-by-committee vote entropy (bits)."""
    return ac.committee_scores(V.v_scores(t), ["pair_id"])


@query("act_model_change", f"""
WITH m AS (SELECT pair_id, list_dot_product(d, {linear_weights_sql('1')}) AS margin,
                  list_dot_product(d, d) AS d2 FROM v_pairs_feat)
SELECT pair_id, {S.sigmoid('margin')} * (1 - {S.sigmoid('margin')}) * d2 AS score FROM m
""", rnd=["score"])
def act_model_change(t):
    """ACT-3: expected model change p(1-p)|d|^2 for linear model 1."""
    return ac.model_change_scores(V.v_pairs_feat(t), _W1)


@query("act_entropy", f"""
WITH p AS (SELECT pair_id, model_id, {S.sigmoid('margin')} AS p FROM v_scores)
SELECT pair_id, model_id, CASE WHEN p <= 0 OR p >= 1 THEN 0.0e0
                               ELSE -(p * ln(p) + (1 - p) * ln(1 - p)) END AS score FROM p
""", rnd=["score"])
def act_entropy(t):
    """ACT-4: prediction entropy in nats per (pair, model)."""
    return ac.entropy_scores(V.v_scores(t), ["pair_id", "model_id"])


_K = 100


@query("act_select", f"""
WITH s AS (SELECT pair_id, round(var_pop(margin), 9) AS acquisition_score FROM v_scores GROUP BY pair_id)
SELECT p.pair_id, p.prompt, p.response_a, p.response_b, s.acquisition_score
FROM v_pool p JOIN s ON s.pair_id = p.pair_id
ORDER BY s.acquisition_score DESC, p.pair_id LIMIT {_K}
""", rnd=["acquisition_score"])
def act_select(t):
    """ACT-7: top-100 pool pairs by ensemble uncertainty (scores rounded to 1e-9
    so float noise cannot reorder ties; earlier key wins)."""
    sc = ac.uncertainty_scores(V.v_scores(t), ["pair_id"]) \
        .withColumn("score", F.round("score", 9))
    return ac.select_top_k(V.v_pool(t), sc, "pair_id", _K)


@query("act_labeled", """
SELECT p.pair_id, p.prompt,
       CASE WHEN l.label = 1 THEN p.response_a ELSE p.response_b END AS chosen,
       CASE WHEN l.label = 1 THEN p.response_b ELSE p.response_a END AS rejected
FROM v_pool p JOIN v_pool_labels l ON l.pair_id = p.pair_id
""")
def act_labeled(t):
    """ACT-8: apply labels to pool pairs -> preference pairs."""
    return ac.apply_labels(V.v_pool(t), V.v_pool_labels(t))


@query("act_loop", f"""
WITH s AS (SELECT pair_id, round(var_pop(margin), 9) AS score FROM v_scores GROUP BY pair_id),
r AS (SELECT pair_id, score, row_number() OVER (ORDER BY score DESC, pair_id) - 1 AS rk
      FROM s WHERE pair_id IN (SELECT pair_id FROM v_pool))
SELECT CAST(r.rk // {_K} AS INTEGER) AS round, r.pair_id, r.score AS acquisition_score,
       CASE WHEN l.label = 1 THEN p.response_a ELSE p.response_b END AS chosen
FROM r JOIN v_pool p ON p.pair_id = r.pair_id JOIN v_pool_labels l ON l.pair_id = r.pair_id
WHERE r.rk < 3 * {_K}
""", rnd=["acquisition_score"])
def act_loop(t):
    """ACT-9: three rounds of uncertainty selection (k=100) with anti-join
    removal; returns what each round selected and the label's choice."""
    scores = ac.uncertainty_scores(V.v_scores(t), ["pair_id"]).withColumn("score", F.round("score", 9))
    labelled, _, chosen = ac.active_loop(V.v_pool(t), lambda pool: scores, V.v_pool_labels(t), rounds=3, k=_K)
    return chosen.join(labelled.select("pair_id", "chosen"), "pair_id").select(
        "round", "pair_id", "acquisition_score", "chosen")


_ROUNDS, _PICKS, _STEPS, _RATE = 3, 60, 5, 0.1


def _retrained_sql() -> str:
    """Rounds unrolled: scores by the weights so far, the picks, and the refit on all picks."""
    truth = f"list_dot_product(d, {linear_weights_sql('2')}) > 0"
    ctes = [f"""
pool AS MATERIALIZED (SELECT pair_id, d, CASE WHEN {truth} THEN 1 ELSE 0 END AS label,
                             list_dot_product(d, d) AS d2 FROM v_pairs_feat),
r0_weights AS (SELECT 0 AS run, {linear_weights_sql('1')} AS w),
picked0 AS (SELECT pair_id, d, label, 0 AS round, 0.0e0 AS score FROM pool LIMIT 0)"""]
    for r in range(_ROUNDS):
        ctes.append(f"""
scored{r} AS (SELECT pair_id, d, label, round(pr * (1 - pr) * d2, 9) AS score FROM (
    SELECT p.*, {S.sigmoid('list_dot_product(p.d, w.w)')} AS pr FROM pool p, r{r}_weights w
    WHERE p.pair_id NOT IN (SELECT pair_id FROM picked{r}))),
picked{r + 1} AS MATERIALIZED (SELECT * FROM picked{r} UNION ALL (
    SELECT pair_id, d, label, {r} AS round, score FROM scored{r} ORDER BY score DESC, pair_id LIMIT {_PICKS})),
signed{r + 1} AS MATERIALIZED (SELECT CASE WHEN label = 1 THEN d ELSE list_transform(d, lambda x: -x) END AS d FROM picked{r + 1}),{
    N.training_ctes(f"signed{r + 1}", [("adamw", 0)], V.FEATURE_DIM, _STEPS, _RATE, 0, f"r{r}_weights", f"r{r + 1}_")}""")
    return f"""WITH{",".join(ctes)}
SELECT CAST(round AS INTEGER) AS round, pair_id, score AS acquisition_score,
       CASE WHEN label = 1 THEN 'first of ' ELSE 'second of ' END || CAST(pair_id AS VARCHAR) AS chosen FROM picked{_ROUNDS}"""


@query("act_loop_retrained", _retrained_sql(), rnd=["acquisition_score"])
def act_loop_retrained(t):
    """ACT-9 with retraining: three rounds that pick 60 pairs by expected model change,
    learn their labels and refit from the current weights; a round is scored by the
    model the round before left.  Labels are the preferences of linear model 2."""
    feats = V.v_pairs_feat(t).checkpoint()
    truth = dot(lit_vector(V.linear_weights(2)), "d") > 0
    key = F.col("pair_id").cast("string")
    pool = feats.select("pair_id", F.concat(F.lit("pair "), key).alias("prompt"),
                        F.concat(F.lit("first of "), key).alias("response_a"),
                        F.concat(F.lit("second of "), key).alias("response_b"))
    labels = feats.select("pair_id", F.when(truth, 1).otherwise(0).alias("label"))
    learner = ac.LinearLearner(feats, labels, V.linear_weights(1), steps=_STEPS, lr=_RATE)
    labelled, _, chosen = ac.active_loop(pool, learner.scores, labels, rounds=_ROUNDS, k=_PICKS, retrain_fn=learner.retrain)
    return chosen.join(labelled.select("pair_id", "chosen"), "pair_id").select(
        "round", "pair_id", "acquisition_score", "chosen")


_NEAREST_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, min(sqrt(list_sum(list_transform(range(1, len(a.v) + 1),
                                                  lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))))
       AS nn_distance
FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id
"""


@query("act_diversity", _NEAREST_SQL, rnd=["nn_distance"])
def act_diversity(t):
    """ACT-5: distance of every embedding to its nearest other embedding
    (exact, blocked; the oracle is the brute-force self join)."""
    return ac.nearest_distance(t.embeddings, "vec_id", "embedding")


@query("act_nearest", _NEAREST_SQL, rnd=["nn_distance"])
def act_nearest(t):
    """ACT-5 at scale: the same distances from pivot partitions; a vector is compared
    only with the rings that the triangle inequality leaves."""
    return nb.nearest_distance_exact(t.embeddings, "vec_id", "embedding")


def _greedy_sql(k: int) -> str:
    """Greedy rounds unrolled: what is left with its distance, and the pick."""
    from prefsight.plans.q_scoring import _MODEL_IDS_SQL, _W
    ctes = [f"""
r AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS v, list_dot_product(CAST(e.embedding AS DOUBLE[]), {_W}) AS reward
      FROM embeddings e, {_MODEL_IDS_SQL}),
b0 AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, stddev_pop(reward) AS score, CAST(NULL AS DOUBLE) AS min_dist
                    FROM r GROUP BY vec_id),
k0 AS MATERIALIZED (SELECT * FROM b0 ORDER BY score DESC, vec_id LIMIT 1)"""]
    for i in range(1, k):
        ctes.append(f"""
b{i} AS MATERIALIZED (SELECT b.vec_id, b.v, b.score, least(b.min_dist, list_distance(b.v, p.v)) AS min_dist
                      FROM b{i - 1} b, k{i - 1} p WHERE b.vec_id <> p.vec_id),
k{i} AS MATERIALIZED (SELECT * FROM b{i} ORDER BY score * min_dist DESC, score DESC, vec_id LIMIT 1)""")
    return "WITH" + ",".join(ctes) + "\n" + "\nUNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS round, vec_id, score, min_dist FROM k{i}" for i in range(k))


@query("act_greedy_diverse", _greedy_sql(10), rnd=["score", "min_dist"])
def act_greedy_diverse(t):
    """ACT-6: 10 embeddings chosen greedily by ensemble std x distance to the
    already chosen ones."""
    from prefsight.operators import scoring as scm
    from prefsight.plans.q_scoring import MODELS
    scored = scm.score_all(t.embeddings, MODELS, "embedding", keep=["vec_id"])
    unc = scored.groupBy("vec_id").agg(F.stddev_pop("reward").alias("score"))
    items = t.embeddings.join(unc, "vec_id")
    return ac.greedy_diverse(items, "vec_id", "embedding", "score", 10)
