"""Best-of-N and policy-behaviour analyses over a candidates table (POL-*).

Candidates: (prompt_id, sample_idx, response, reward[, log_prob, base_log_prob]).
Per-prompt results are partial aggregates (max_by / avg), so a prompt with a
third of all samples is combined map-side instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_of_n(cands: DataFrame, prompt_col="prompt_id", idx_col="sample_idx",
              reward_col="reward", extra=("response",)) -> DataFrame:
    """POL-1: highest reward per prompt; the first generated sample wins ties."""
    key = F.struct(F.col(reward_col), (-F.col(idx_col)).alias("neg_idx"))
    best = F.max_by(F.struct(idx_col, reward_col, *extra), key)
    return cands.groupBy(prompt_col).agg(best.alias("b")).select(
        prompt_col, *[F.col(f"b.{c}").alias(c) for c in (idx_col, *extra, reward_col)])


def reward_statistics(cands: DataFrame, prompt_col="prompt_id", reward_col="reward"):
    """POL-3: mean, population std, max, min and the mean best-of-N gain
    (max - mean per prompt, averaged over prompts).  Groups are prompts, not
    positional blocks.  The two one-row aggregates meet on a constant key."""
    r = F.col(reward_col)
    glob = cands.agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"),
                     F.max(r).alias("max"), F.min(r).alias("min")).withColumn("_k", F.lit(0))
    gain = (cands.groupBy(prompt_col).agg((F.max(r) - F.avg(r)).alias("_g"))
            .agg(F.avg("_g").alias("best_of_n_improvement")).withColumn("_k", F.lit(0)))
    return glob.join(gain, "_k").drop("_k")


def gradient_variance(cands: DataFrame, reward_col="reward") -> DataFrame:
    """POL-4: Var[r] (population) as the policy-gradient variance proxy."""
    return cands.agg(F.var_pop(reward_col).alias("gradient_variance"))


def kl_divergence(cands: DataFrame, lp="log_prob", base_lp="base_log_prob") -> DataFrame:
    """POL-5: KL(pi || pi_base) ~ mean(log pi - log pi_base); 0.0 without a base."""
    if base_lp not in cands.columns:
        return cands.agg(F.lit(0.0).alias("kl"))
    return cands.agg(F.coalesce(F.avg(F.col(lp) - F.col(base_lp)), F.lit(0.0)).alias("kl"))


def detect_reward_hacking(cands: DataFrame, reward_col="reward", thresholds=(3.0,),
                          max_fraction: float = 0.1) -> DataFrame:
    """POL-6: one-sided outliers r > mean + k*std (population std) per threshold k.

    Mean and std are a one-row aggregate attached on a constant key (broadcast);
    every threshold is one conditional count of a single second pass."""
    r = F.col(reward_col)
    stats = cands.agg(F.avg(r).alias("mean_reward"), F.stddev_pop(r).alias("std_reward"),
                      F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(0))
    tagged = cands.select(reward_col).withColumn("_k", F.lit(0)).join(F.broadcast(stats), "_k")
    counts = tagged.groupBy("mean_reward", "std_reward", "n").agg(*[
        F.sum(F.when(r > F.col("mean_reward") + F.lit(float(k)) * F.col("std_reward"), 1)
              .otherwise(0)).cast("bigint").alias(f"_c{i}") for i, k in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(k)).alias("threshold"), F.col(f"_c{i}").alias("outlier_count"))
                     for i, k in enumerate(thresholds)])
    out = counts.select("mean_reward", "std_reward", "n", F.inline(rows))
    frac = F.col("outlier_count") / F.col("n")
    return out.select("threshold", "mean_reward", "std_reward", "outlier_count",
                      frac.alias("outlier_fraction"),
                      (frac > F.lit(float(max_fraction))).alias("potential_hacking"))


def rlhf_objective(cands: DataFrame, beta: float = 0.1, reward_col="reward",
                   lp="log_prob", base_lp="base_log_prob") -> DataFrame:
    """POL-7: E[r] - beta * KL."""
    return cands.agg(F.avg(reward_col).alias("mean_reward"),
                     F.avg(F.col(lp) - F.col(base_lp)).alias("kl")).select(
        "mean_reward", "kl", (F.col("mean_reward") - F.lit(beta) * F.col("kl")).alias("objective"))


def length_bias(cands: DataFrame, reward_col="reward", text_col="response") -> DataFrame:
    """POL-8: reward-length correlation and repeated-token share (whitespace tokens)."""
    toks = F.split(F.col(text_col), r"\s+")
    n_tok = F.size(toks)
    distinct_share = F.when(n_tok > 0, F.size(F.array_distinct(toks)) / n_tok)
    return cands.agg(
        F.coalesce(F.corr(F.length(text_col).cast("double"), F.col(reward_col)), F.lit(0.0))
        .alias("length_reward_corr"),
        F.avg(F.length(text_col)).alias("mean_length"),
        (F.lit(1.0) - F.avg(distinct_share)).alias("repeated_token_share"))
