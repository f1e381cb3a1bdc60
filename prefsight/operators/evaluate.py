"""Evaluation and calibration of pairwise reward margins (EVL-*).

Input: a DataFrame with a ``margin`` column (r(chosen) - r(rejected)) and any
grouping columns.  Probability p = sigmoid(margin).  The label is either the
constant 1 ("chosen is preferred", label_mode='chosen') or the model's own sign
(label_mode='sign', as the reference's ``evaluate`` does).

Calibration error is computed in one aggregate pass: for 10 fixed bins keep
sum(p - y) and count per bin as conditional sums; ECE = sum_b |S_b| / n and
MCE = max_b |S_b| / c_b.  No per-bin shuffle, no collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefsight.functions import N_BINS, calibration_bin, safe_div, sigmoid, softplus_neg


def label_col(margin: Column, label_mode: str) -> Column:
    if label_mode == "chosen":
        return F.lit(1.0)
    if label_mode == "sign":
        return F.when(margin > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    raise ValueError(f"unknown label_mode {label_mode!r} (use 'chosen' or 'sign')")


def with_probability(df: DataFrame, margin_col: str = "margin",
                     label_mode: str = "chosen", close_top: bool = False) -> DataFrame:
    m = F.col(margin_col)
    return (df.withColumn("p", sigmoid(m))
            .withColumn("y", label_col(m, label_mode))
            .withColumn("bin", calibration_bin(F.col("p"), close_top)))


def _bin_sums(p: Column, y: Column, b: Column):
    diffs, counts = [], []
    for k in range(N_BINS):
        in_k = b == k
        diffs.append(F.sum(F.when(in_k, p - y)).alias(f"_s{k}"))
        counts.append(F.sum(F.when(in_k, F.lit(1)).otherwise(F.lit(0))).alias(f"_c{k}"))
    return diffs, counts


def _ece_mce_from_sums(n: Column) -> tuple[Column, Column]:
    ece = None
    gaps = []
    for k in range(N_BINS):
        s = F.coalesce(F.abs(F.col(f"_s{k}")), F.lit(0.0))
        ece = s if ece is None else ece + s
        gaps.append(F.when(F.col(f"_c{k}") > 0, F.abs(F.col(f"_s{k}")) / F.col(f"_c{k}"))
                    .otherwise(F.lit(0.0)))
    ece = F.when(n > 0, ece / n).otherwise(F.lit(0.0))
    mce = F.greatest(*gaps)
    return ece, mce


def calibration_report(df: DataFrame, group_cols=(), margin_col: str = "margin",
                       label_mode: str = "chosen", close_top: bool = False) -> DataFrame:
    """One row per group: n, accuracy, ece, brier, mce, mean_margin, loss.

    accuracy = share of margin > 0 (zero margin is wrong); loss = mean of the
    Bradley-Terry loss -log sigmoid(margin).  Empty input -> zeros (no groups).
    By default p == 1.0 falls in no bin but counts in n (the reference's
    behaviour); ``close_top=True`` bins it.
    """
    group_cols = list(group_cols)
    d = with_probability(df, margin_col, label_mode, close_top)
    p, y, b, m = F.col("p"), F.col("y"), F.col("bin"), F.col(margin_col)
    diffs, counts = _bin_sums(p, y, b)
    agg = d.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(m > 0, 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(m).alias("mean_margin"),
        F.avg(softplus_neg(m)).alias("loss"),
        *diffs, *counts)
    ece, mce = _ece_mce_from_sums(F.col("n"))
    return agg.select(*group_cols, "n", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
                      ece.alias("ece"), F.coalesce("brier", F.lit(0.0)).alias("brier"),
                      mce.alias("mce"), "mean_margin", "loss")


def accuracy(df: DataFrame, group_cols=(), margin_col: str = "margin") -> DataFrame:
    m = F.col(margin_col)
    return df.groupBy(*group_cols).agg(
        F.coalesce(F.avg(F.when(m > 0, 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))


def expected_calibration_error(df: DataFrame, group_cols=(), margin_col="margin",
                               label_mode="chosen") -> DataFrame:
    r = calibration_report(df, group_cols, margin_col, label_mode)
    return r.select(*group_cols, "n", "ece")


def brier_score(df: DataFrame, group_cols=(), margin_col="margin", label_mode="chosen"):
    r = calibration_report(df, group_cols, margin_col, label_mode)
    return r.select(*group_cols, "brier")


def max_calibration_error(df: DataFrame, group_cols=(), margin_col="margin",
                          label_mode="chosen"):
    r = calibration_report(df, group_cols, margin_col, label_mode)
    return r.select(*group_cols, "mce")


def reliability_table(df: DataFrame, group_cols=(), margin_col="margin",
                      label_mode="chosen") -> DataFrame:
    """Per (group, bin): n, mean confidence, mean label, |gap|.  Rows with p in
    no bin (p == 1.0) are left out, as in the reference."""
    group_cols = list(group_cols)
    d = with_probability(df, margin_col, label_mode).filter(F.col("bin").isNotNull())
    return (d.groupBy(*group_cols, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_conf"), F.avg("y").alias("mean_acc"))
        .withColumn("gap", F.abs(F.col("mean_conf") - F.col("mean_acc"))))


def batch_calibration(df: DataFrame, run_cols, batch_col: str, margin_col="margin",
                      min_batches: int = 10) -> DataFrame:
    """Callback-style calibration: one probability per validation batch (sigmoid
    of the batch's mean margin), label constant 1; runs with fewer than
    ``min_batches`` batches emit nothing."""
    run_cols = list(run_cols)
    per_batch = df.groupBy(*run_cols, batch_col).agg(F.avg(margin_col).alias("batch_margin"))
    rep = calibration_report(per_batch, run_cols, "batch_margin", "chosen")
    return rep.filter(F.col("n") >= min_batches).select(*run_cols, F.col("n").alias("batches"),
                                                        "ece", "brier", "mce")


def margin_correlation(df: DataFrame, pred_col: str, true_col: str, group_cols=()):
    return df.groupBy(*group_cols).agg(
        F.coalesce(F.corr(pred_col, true_col), F.lit(0.0)).alias("margin_correlation"))


def auc(df: DataFrame, chosen_col: str, rejected_col: str, key_col: str,
        group_cols=()) -> DataFrame:
    """Mann-Whitney AUC of chosen rewards against rejected rewards per group,
    average ranks on ties.

    Scores are counted first: one row per (group, distinct score), so ties and hot
    groups are combined before the shuffle.  The number of lower scores is a prefix
    sum over range partitions (``prefix_sums``)."""
    from prefsight.operators.indexing import prefix_sums

    group_cols = list(group_cols)
    keys = group_cols or ["_all"]
    base = df if group_cols else df.withColumn("_all", F.lit(0))
    both = F.array(F.struct(F.col(chosen_col).cast("double").alias("s"), F.lit(1).alias("lab")),
                   F.struct(F.col(rejected_col).cast("double").alias("s"), F.lit(0).alias("lab")))
    scores = base.select(*keys, F.inline(both))  # one scan
    counts = scores.groupBy(*keys, "s").agg(F.sum("lab").alias("c1"), F.sum(1 - F.col("lab")).alias("c0"))
    below = prefix_sums(counts, keys, ["s"], "c0", "below")
    agg = below.groupBy(*keys).agg(
        F.sum(F.col("c1") * (F.col("below") + F.col("c0") / 2.0)).alias("u"),
        F.sum("c1").cast("double").alias("n1"), F.sum("c0").cast("double").alias("n0"))
    return agg.select(*group_cols, safe_div(F.col("u"), F.col("n1") * F.col("n0"), 0.0).alias("auc"))


def temperature_grid(lo: float = 0.05, hi: float = 20.0, n: int = 41) -> list[float]:
    import numpy as np
    return [float(x) for x in np.geomspace(lo, hi, n)]


def temperature_losses(df: DataFrame, grid, group_cols=(), margin_col="margin",
                       label_mode="chosen") -> DataFrame:
    """Mean log-loss at every temperature of ``grid`` in ONE pass: one
    conditional aggregate per grid point instead of exploding rows."""
    group_cols = list(group_cols)
    m = F.col(margin_col)
    y = label_col(m, label_mode)
    aggs = []
    for i, t in enumerate(grid):
        z = m / F.lit(float(t))
        # -[y log s(z) + (1-y) log(1-s(z))] = y*softplus(-z) + (1-y)*softplus(z)
        loss = y * softplus_neg(z) + (F.lit(1.0) - y) * softplus_neg(-z)
        aggs.append(F.avg(loss).alias(f"_l{i}"))
    wide = df.groupBy(*group_cols).agg(*aggs)
    long = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"_l{i}").alias("loss"))
                     for i, t in enumerate(grid)])
    return wide.select(*group_cols, F.inline(long))


def fit_temperature(df: DataFrame, group_cols=(), margin_col="margin", label_mode="chosen",
                    grid=None) -> DataFrame:
    """Best temperature per group by grid search (bounded to [0.05, 20])."""
    group_cols = list(group_cols)
    grid = list(grid or temperature_grid())
    losses = temperature_losses(df, grid, group_cols, margin_col, label_mode)
    best = losses.groupBy(*group_cols).agg(
        F.min_by(F.struct("temperature", "loss"), F.struct("loss", "temperature")).alias("b"))
    return best.select(*group_cols, F.col("b.temperature").alias("temperature"),
                       F.col("b.loss").alias("loss"))


def _neighbours(lo, hi, k, points):
    """Grid points k-1 and k+1 (clamped) of linspace(lo, hi, points)."""
    step = lambda i: lo + (hi - lo) * i / F.lit(points - 1)
    return step(F.greatest(k - 1, F.lit(0))), step(F.least(k + 1, F.lit(points - 1)))


def refine_temperature(df: DataFrame, bounds: DataFrame, group_cols, margin_col="margin",
                       label_mode="chosen", points: int = 21) -> DataFrame:
    """One refinement round: ``points`` temperatures spaced evenly on each
    group's [lo, hi], all scored in ONE pass as conditional aggregates; returns
    the best (temperature, loss) and the next round's [lo, hi] per group.

    ``bounds`` has one row per group (AQE broadcasts it when small)."""
    group_cols = list(group_cols)
    m = F.col(margin_col)
    y = label_col(m, label_mode)
    j = df.join(bounds.select(*group_cols, "lo", "hi"), group_cols)
    lo, hi = F.col("lo"), F.col("hi")

    def t_at(k):
        return lo + (hi - lo) * F.lit(k) / F.lit(points - 1)
    aggs = []
    for k in range(points):
        z = m / t_at(k)
        aggs.append(F.avg(y * softplus_neg(z) + (F.lit(1.0) - y) * softplus_neg(-z)).alias(f"_l{k}"))
    wide = j.groupBy(*group_cols, "lo", "hi").agg(*aggs)
    long = F.array(*[F.struct(F.lit(k).alias("k"), t_at(k).alias("temperature"),
                              F.col(f"_l{k}").alias("loss")) for k in range(points)])
    rows = wide.select(*group_cols, "lo", "hi", F.inline(long))
    best = rows.groupBy(*group_cols).agg(
        F.min_by(F.struct("k", "temperature", "loss", "lo", "hi"), F.struct("loss", "k")).alias("b"))
    nlo, nhi = _neighbours(F.col("b.lo"), F.col("b.hi"), F.col("b.k"), points)
    return best.select(*group_cols, F.col("b.temperature").alias("temperature"),
                       F.col("b.loss").alias("loss"), nlo.alias("lo"), nhi.alias("hi"))


def fit_temperature_refined(df: DataFrame, group_cols=(), margin_col="margin",
                            label_mode="chosen", grid=None, rounds: int = 2,
                            points: int = 21) -> DataFrame:
    """EVL-8: coarse bounded grid, then ``rounds`` refinements between the
    neighbours of the current best, per group; every round is one pass."""
    group_cols = list(group_cols)
    keys = group_cols or ["_all"]
    base = df if group_cols else df.withColumn("_all", F.lit(0))
    grid = list(grid or temperature_grid())
    losses = temperature_losses(base, grid, keys, margin_col, label_mode)
    idx = F.create_map(*[x for i, t in enumerate(grid) for x in (F.lit(float(t)), F.lit(i))])
    gl = F.array(*[F.lit(float(t)) for t in grid])
    best = losses.withColumn("k", F.element_at(idx, F.col("temperature"))).groupBy(*keys).agg(
        F.min_by(F.col("k"), F.struct("loss", "k")).alias("k"))
    bounds = best.select(*keys,
                         F.element_at(gl, F.greatest(F.col("k") - 1, F.lit(0)) + 1).alias("lo"),
                         F.element_at(gl, F.least(F.col("k") + 1, F.lit(len(grid) - 1)) + 1).alias("hi"))
    out = None
    for _ in range(rounds):
        out = refine_temperature(base, bounds, keys, margin_col, label_mode, points)
        bounds = out.select(*keys, "lo", "hi")
    return out.select(*group_cols, "temperature", "loss")
