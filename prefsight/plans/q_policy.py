"""POL-* queries over v_candidates (lineitem rows as generated samples)."""

from __future__ import annotations

from prefsight.operators import policy as po
from prefsight.plans.registry import query
from prefsight.sources import views as V


@query("pol_best_of_n", """
SELECT prompt_id, sample_idx, response, reward FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY reward DESC, sample_idx) AS rn
  FROM v_candidates) WHERE rn = 1
""", rnd=["reward"])
def pol_best_of_n(t):
    """POL-1: best sample per prompt, first generated wins ties."""
    return po.best_of_n(V.v_candidates(t))


@query("pol_all", "SELECT prompt_id, sample_idx, response, reward FROM v_candidates", rnd=["reward"])
def pol_all(t):
    """POL-2: every scored sample."""
    return V.v_candidates(t).select("prompt_id", "sample_idx", "response", "reward")


@query("pol_reward_stats", """
WITH g AS (SELECT avg(reward) AS mean, stddev_pop(reward) AS std, max(reward) AS max,
                  min(reward) AS min FROM v_candidates),
b AS (SELECT avg(mx - av) AS best_of_n_improvement FROM (
        SELECT max(reward) AS mx, avg(reward) AS av FROM v_candidates GROUP BY prompt_id))
SELECT g.mean, g.std, g.max, g.min, b.best_of_n_improvement FROM g, b
""", rnd=["mean", "std", "max", "min", "best_of_n_improvement"])
def pol_reward_stats(t):
    """POL-3: reward statistics and mean best-of-N gain over prompts."""
    return po.reward_statistics(V.v_candidates(t, index=False))


@query("pol_grad_variance", "SELECT var_pop(reward) AS gradient_variance FROM v_candidates",
       rnd=["gradient_variance"])
def pol_grad_variance(t):
    """POL-4: population variance of rewards."""
    return po.gradient_variance(V.v_candidates(t, index=False))


@query("pol_kl", "SELECT coalesce(avg(log_prob - base_log_prob), 0.0e0) AS kl FROM v_candidates",
       rnd=["kl"])
def pol_kl(t):
    """POL-5: KL to the base policy, mean log-ratio."""
    return po.kl_divergence(V.v_candidates(t, index=False))


@query("pol_hacking", """
WITH s AS (SELECT avg(reward) AS mean_reward, stddev_pop(reward) AS std_reward, count(*) AS n
           FROM v_candidates),
k AS (SELECT unnest([1.0e0, 3.0e0]) AS threshold),
c AS (SELECT k.threshold, s.mean_reward, s.std_reward, s.n,
             CAST(sum(CASE WHEN v.reward > s.mean_reward + k.threshold * s.std_reward THEN 1 ELSE 0 END)
                  AS BIGINT) AS outlier_count
      FROM v_candidates v, s, k GROUP BY k.threshold, s.mean_reward, s.std_reward, s.n)
SELECT threshold, mean_reward, std_reward, outlier_count, outlier_count / n AS outlier_fraction,
       outlier_count / n > 0.1e0 AS potential_hacking FROM c
""", rnd=["threshold", "mean_reward", "std_reward", "outlier_fraction"])
def pol_hacking(t):
    """POL-6: reward-hacking detector at the default 3 sigma and at 1 sigma."""
    return po.detect_reward_hacking(V.v_candidates(t, index=False), thresholds=(3.0, 1.0))


@query("pol_objective", """
SELECT avg(reward) AS mean_reward, avg(log_prob - base_log_prob) AS kl,
       avg(reward) - 0.1e0 * avg(log_prob - base_log_prob) AS objective FROM v_candidates
""", rnd=["mean_reward", "kl", "objective"])
def pol_objective(t):
    """POL-7: RLHF objective E[r] - 0.1 KL."""
    return po.rlhf_objective(V.v_candidates(t, index=False), beta=0.1)


@query("pol_length_bias", r"""
SELECT coalesce(corr(CAST(length(response) AS DOUBLE), reward), 0.0e0) AS length_reward_corr,
       avg(length(response)) AS mean_length,
       1.0e0 - avg(len(list_distinct(regexp_split_to_array(response, '\s+')))
                   / len(regexp_split_to_array(response, '\s+'))) AS repeated_token_share
FROM v_candidates
""", rnd=["length_reward_corr", "mean_length", "repeated_token_share"])
def pol_length_bias(t):
    """POL-8: length-reward correlation and repeated-token share."""
    return po.length_bias(V.v_candidates(t, index=False))
