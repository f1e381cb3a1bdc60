"""TRN-* queries: fitting on v_pairs_feat, bookkeeping on v_metric_log."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from prefsight.operators import evaluate as ev
from prefsight.operators import scoring as sc
from prefsight.operators import train as tr
from prefsight.operators import train_logs as tl
from prefsight.plans import sql_fn as S
from prefsight.plans.registry import query
from prefsight.sources import views as V

DIM = V.FEATURE_DIM
_NAMES = [n for n, _ in V.METRIC_LOG_NAMES]


def _adamw_sql(steps: int, seed: int, lr: float, warmup: int) -> str:
    """The training loop unrolled: a CTE of (j, weight, moments) per step."""
    cfg = tr.OPTIMIZER_DEFAULTS["adamw"]
    (b1, b2), eps, decay = cfg["betas"], cfg["eps"], cfg["weight_decay"]
    start = np.random.default_rng(seed).standard_normal(DIM) * 0.01
    ctes = [f"""
pf AS MATERIALIZED (SELECT d FROM v_pairs_feat),
s0 AS MATERIALIZED (SELECT j, ({S.list_lit(start)})[j + 1] AS w, 0.0e0 AS m, 0.0e0 AS v FROM range({DIM}) x(j))"""]
    logs = []
    for i in range(steps):
        rate = S.dbl(tr.lr_at(i, lr, warmup, steps))
        c1, c2 = S.dbl(1 - b1 ** (i + 1)), S.dbl(1 - b2 ** (i + 1))
        ctes.append(f"""
p{i} AS MATERIALIZED (SELECT d, list_dot_product(d, (SELECT list(w ORDER BY j) FROM s{i})) AS m FROM pf),
g{i} AS MATERIALIZED (SELECT j, avg(-(1 - {S.sigmoid('m')}) * d[j + 1]) AS g FROM p{i}, range({DIM}) x(j) GROUP BY j),
n{i} AS MATERIALIZED (SELECT sqrt(sum(g * g)) AS norm FROM g{i}),
c{i} AS MATERIALIZED (SELECT j, CASE WHEN norm > {S.dbl(tr.GRAD_CLIP)} THEN g * {S.dbl(tr.GRAD_CLIP)} / norm ELSE g END AS g
          FROM g{i}, n{i}),
m{i} AS MATERIALIZED (SELECT s.j, s.w * (1 - {rate} * {S.dbl(decay)}) AS w, {S.dbl(b1)} * s.m + {S.dbl(1 - b1)} * c.g AS m,
          {S.dbl(b2)} * s.v + {S.dbl(1 - b2)} * c.g * c.g AS v FROM s{i} s JOIN c{i} c ON c.j = s.j),
s{i + 1} AS MATERIALIZED (SELECT j, w - {rate} * (m / {c1}) / (sqrt(v / {c2}) + {S.dbl(eps)}) AS w, m, v FROM m{i})""")
        logs.append(f"""SELECT 'adamw' AS optimizer, CAST({seed} AS INTEGER) AS seed, CAST({i} AS INTEGER) AS step,
       avg({S.softplus_neg('m')}) AS loss, avg(CASE WHEN m > 0 THEN 1.0e0 ELSE 0.0e0 END) AS accuracy,
       {rate} AS lr, (SELECT norm FROM n{i}) AS grad_norm FROM p{i}""")
    return "WITH" + ",".join(ctes) + "\n" + "\nUNION ALL ".join(logs)


@query("trn_fit_bt", _adamw_sql(30, 42, 0.05, 3), rnd=["loss", "accuracy", "lr", "grad_norm"])
def trn_fit_bt(t):
    """TRN-1: 30 AdamW steps (warm-up + cosine, clip 1.0); returns the step log."""
    st = tr.fit_bradley_terry(V.v_pairs_feat(t), DIM, "adamw", seed=42, steps=30, lr=0.05,
                              warmup=3)
    return tr.step_log_frame(t.spark, [st])


@query("trn_fit_exact")
def trn_fit_exact(t):
    """TRN-2: exact optimum by logistic regression on mirrored rows, evaluated."""
    pairs = V.v_pairs_feat(t)
    w, _ = tr.fit_exact(pairs)
    m = sc.pair_margins(pairs, sc.LinearModels({0: list(w)}))
    return ev.calibration_report(m, ["model_id"]).select(
        "n", "accuracy", "loss", "ece", F.lit(float((w ** 2).sum() ** 0.5)).alias("weight_norm"))


def _strengths_sql(rounds: int, prior: float = 1e-3) -> str:
    """The MM rounds unrolled: one CTE of normalised strengths per round."""
    ctes = ["""
c AS (SELECT CASE WHEN a.l_extendedprice >= b.l_extendedprice THEN a.l_suppkey ELSE b.l_suppkey END AS wi,
             CASE WHEN a.l_extendedprice >= b.l_extendedprice THEN b.l_suppkey ELSE a.l_suppkey END AS lo
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
       AND a.l_suppkey <> b.l_suppkey),
pairs AS MATERIALIZED (SELECT least(wi, lo) AS i, greatest(wi, lo) AS j, count(*) AS n FROM c GROUP BY 1, 2),
both_sides AS MATERIALIZED (SELECT i AS item, j AS other, n FROM pairs UNION ALL SELECT j, i, n FROM pairs),
items AS MATERIALIZED (
  SELECT g.item, coalesce(w.wins, 0) AS wins, g.games FROM (SELECT item, CAST(sum(n) AS BIGINT) AS games FROM both_sides GROUP BY item) g
  LEFT JOIN (SELECT wi AS item, count(*) AS wins FROM c GROUP BY wi) w ON w.item = g.item),
t0 AS (SELECT item, 1.0e0 AS theta FROM items)"""]
    for r in range(rounds):
        ctes.append(f"""
r{r + 1} AS MATERIALIZED (
  SELECT x.item, greatest(CAST(x.wins AS DOUBLE), {prior!r}) / d.den AS raw FROM items x JOIN (
    SELECT b.item, sum(b.n / (p.theta + q.theta)) AS den FROM both_sides b
    JOIN t{r} p ON p.item = b.item JOIN t{r} q ON q.item = b.other GROUP BY b.item) d ON d.item = x.item),
t{r + 1} AS MATERIALIZED (SELECT item, exp(ln(raw) - (SELECT avg(ln(raw)) FROM r{r + 1})) AS theta FROM r{r + 1})""")
    return ("WITH" + ",".join(ctes) + f"""
SELECT x.item, t.theta AS strength, ln(t.theta) AS log_strength, x.wins, x.games, CAST({rounds} AS INTEGER) AS rounds
FROM t{rounds} t JOIN items x ON x.item = t.item""")


@query("trn_item_strengths", _strengths_sql(10), rnd=["strength", "log_strength"])
def trn_item_strengths(t):
    """TRN-3: supplier strengths from consecutive-line comparisons (the line
    with the higher extended price wins), MM iteration."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    a = li.alias("a")
    b = li.alias("b")
    j = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey"))
               & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)
               & (F.col("a.l_suppkey") != F.col("b.l_suppkey")))
    a_wins = F.col("a.l_extendedprice") >= F.col("b.l_extendedprice")
    comps = j.select(F.when(a_wins, F.col("a.l_suppkey")).otherwise(F.col("b.l_suppkey")).alias("winner"),
                     F.when(a_wins, F.col("b.l_suppkey")).otherwise(F.col("a.l_suppkey")).alias("loser"))
    out, rounds = tr.item_strengths(comps, iterations=10, tol=0.0)
    return out.withColumn("rounds", F.lit(rounds))


def _epochs(t):
    return tl.epoch_table(V.v_metric_log(t), _NAMES)


_EPOCH_SQL = ("SELECT run_id, epoch, " + ", ".join(
    f"avg(CASE WHEN name = '{n}' THEN value END) AS {n}" for n in _NAMES)
    + " FROM v_metric_log GROUP BY run_id, epoch")


@query("trn_epoch_rollup", """
SELECT run_id, epoch, name, avg(value) AS value, count(*) AS n_steps FROM v_metric_log
GROUP BY run_id, epoch, name
""", rnd=["value"])
def trn_epoch_rollup(t):
    """TRN-4: epoch means of step values (unweighted mean of batch means)."""
    return tl.epoch_rollup(V.v_metric_log(t))


@query("trn_topk_checkpoints", f"""
WITH e AS ({_EPOCH_SQL}),
r AS (SELECT run_id, epoch, val_accuracy AS value,
             row_number() OVER (PARTITION BY run_id ORDER BY val_accuracy DESC, epoch) AS rank,
             max(epoch) OVER (PARTITION BY run_id) AS last FROM e)
SELECT run_id, epoch, value, CASE WHEN rank <= 3 THEN CAST(rank AS INTEGER) END AS rank,
       epoch = last AS is_last
FROM r WHERE rank <= 3 OR epoch = last
""", rnd=["value"])
def trn_topk_checkpoints(t):
    """TRN-5: top-3 epochs by validation accuracy plus the last epoch."""
    return tl.topk_checkpoints(_epochs(t), "val_accuracy").withColumn("rank", F.col("rank").cast("int"))


@query("trn_early_stop", f"""
WITH e AS ({_EPOCH_SQL}),
a AS (SELECT run_id, epoch, val_accuracy AS v,
             max(val_accuracy) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before,
             row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS pos FROM e),
b AS (SELECT *, best_before IS NULL OR v > best_before AS improved FROM a),
c AS (SELECT *, max(CASE WHEN improved THEN pos END) OVER (PARTITION BY run_id ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM b),
c2 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v DESC, pos) AS best_rank FROM c)
SELECT run_id, min(CASE WHEN pos - last_imp >= 3 THEN epoch END) AS stop_epoch,
       max(CASE WHEN best_rank = 1 THEN epoch END) AS best_epoch, max(v) AS best_value
FROM c2 GROUP BY run_id
""", rnd=["best_value"])
def trn_early_stop(t):
    """TRN-6: early-stopping epoch (patience 3, mode max) and the best epoch."""
    return tl.early_stop(_epochs(t), "val_accuracy")
