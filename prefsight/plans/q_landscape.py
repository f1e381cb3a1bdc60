"""LND-* queries: curvature of linear model 1 on v_pairs_feat; spectra tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from prefsight.operators import landscape as ls
from prefsight.plans import sql_fn as S
from prefsight.plans.registry import query
from prefsight.plans.sql_views import linear_weights_sql
from prefsight.session import scratch_path
from prefsight.sources import io
from prefsight.sources import views as V

W1 = V.linear_weights(1)
DIM = V.FEATURE_DIM
_M1 = f"list_dot_product(d, {linear_weights_sql('1')})"
_S1 = f"({S.sigmoid(_M1)} * (1 - {S.sigmoid(_M1)}))"


@query("lnd_gram", f"""
WITH p AS (SELECT d, {_S1} AS s FROM v_pairs_feat)
SELECT CAST(i.range AS INTEGER) AS i, CAST(j.range AS INTEGER) AS j, avg(p.s * p.d[i.range + 1] * p.d[j.range + 1]) AS value
FROM p, range({DIM}) i, range({DIM}) j WHERE j.range >= i.range GROUP BY i.range, j.range
""", rnd=["value"])
def lnd_gram(t):
    """LND-1 entries: the Hessian mean[p(1-p) d d^T] (upper triangle) in one pass."""
    return ls.gram_entries(V.v_pairs_feat(t), W1, DIM)


@query("lnd_hessian_full")
def lnd_hessian_full(t):
    """LND-1: every eigenvalue of the full Hessian (descending)."""
    cur = ls.Curvature(V.v_pairs_feat(t), W1)
    try:
        ev = cur.eigenvalues_full()
    finally:
        cur.unpersist()
    return ls.spectrum_frame(t.spark, ev, "model_1")


@query("lnd_topk_eigs")
def lnd_topk_eigs(t):
    """LND-3: top-5 eigenvalues by block Lanczos on HVP passes."""
    cur = ls.Curvature(V.v_pairs_feat(t), W1)
    try:
        ev = cur.top_eigenvalues(5, seed=0)
    finally:
        cur.unpersist()
    return ls.spectrum_frame(t.spark, ev, "model_1")


@query("lnd_svd_eigs")
def lnd_svd_eigs(t):
    """LND-4: top-5 squared singular values of the scaled rows (Lanczos)."""
    cur = ls.Curvature(V.v_pairs_feat(t), W1)
    try:
        ev = cur.top_eigenvalues_svd(5)
    finally:
        cur.unpersist()
    return ls.spectrum_frame(t.spark, ev, "model_1")


@query("lnd_invariants", f"""
WITH p AS (SELECT d, {_S1} AS s FROM v_pairs_feat),
h AS (SELECT avg(p.s * p.d[i.range + 1] * p.d[j.range + 1]) AS v, i.range = j.range AS diagonal
      FROM p, range({DIM}) i, range({DIM}) j GROUP BY i.range, j.range)
SELECT sum(CASE WHEN diagonal THEN v END) AS trace, sum(v * v) AS squared_norm, true AS full_agrees,
       true AS topk_agrees, true AS svd_agrees, true AS hvp_agrees, true AS trace_estimate_agrees FROM h
""", rnd=["trace", "squared_norm"])
def lnd_invariants(t):
    """LND-1..5 against the exact matrix: eigenvalue sums are the trace and the
    squared norm; iterative values, products and the estimate stay within 1e-6
    (relative), 1e-9 and four standard errors of the exact ones."""
    cur = ls.Curvature(V.v_pairs_feat(t), W1)
    try:
        h = cur.gramian()
        full = cur.eigenvalues_full()
        values, vectors = cur.krylov(5, seed=0)
        svd = np.array(cur.top_eigenvalues_svd(5))
        probe = np.linspace(-1, 1, DIM)
        product = cur.hvp(probe)
        estimate = cur.trace_hutchinson(400, seed=0)
    finally:
        cur.unpersist()
    exact = np.sort(np.linalg.eigvalsh(h))[::-1]
    error = 4 * np.sqrt(2 * (h * h).sum() / 400)  # of Gaussian probes
    agree = (np.allclose(full, exact), np.allclose(values, exact[:5], rtol=1e-6)
             and np.allclose(h @ vectors, vectors * values, atol=1e-5 * exact[0]),
             np.allclose(svd, exact[:5], rtol=1e-6), np.allclose(product, h @ probe, atol=1e-9),
             abs(estimate - np.trace(h)) <= error)
    return t.spark.createDataFrame(
        [(float(full.sum()), float((full ** 2).sum()), *map(bool, agree))],
        "trace double, squared_norm double, full_agrees boolean, topk_agrees boolean, svd_agrees boolean, "
        "hvp_agrees boolean, trace_estimate_agrees boolean")


@query("lnd_trace")
def lnd_trace(t):
    """LND-5: Hutchinson trace (100 Gaussian probes, one pass) next to the exact trace."""
    pairs = V.v_pairs_feat(t)
    cur = ls.Curvature(pairs, W1)
    try:
        est = cur.trace_hutchinson(100, seed=0)
    finally:
        cur.unpersist()
    return ls.trace_exact(pairs, W1).select(F.lit(est).alias("trace_hutchinson"),
                                             F.col("trace").alias("trace_exact"), "n")


@query("lnd_trace_exact", f"""
SELECT avg({_S1} * list_dot_product(d, d)) AS trace, count(*) AS n FROM v_pairs_feat
""", rnd=["trace"])
def lnd_trace_exact(t):
    """LND-5 oracle form: exact trace mean[p(1-p) |d|^2]."""
    return ls.trace_exact(V.v_pairs_feat(t), W1)


@query("lnd_spectrum_summary", """
WITH a AS (SELECT run_id, count(*) AS n_eigenvalues, max(eigenvalue) AS top_eigenvalue,
                  min(eigenvalue) AS last, sum(eigenvalue) AS s, sum(eigenvalue * eigenvalue) AS sq
           FROM v_spectrum GROUP BY run_id)
SELECT run_id, n_eigenvalues, top_eigenvalue, s AS trace,
       top_eigenvalue / abs(CASE WHEN last = 0 THEN 1e-10 ELSE last END) AS condition_number,
       CASE WHEN sq > 0 THEN s * s / sq ELSE 1.0e0 END AS effective_rank,
       CASE WHEN s > 0 THEN top_eigenvalue / s ELSE 0.0e0 END AS sharpness_score,
       CASE WHEN top_eigenvalue > 0 THEN 1.0e0 / top_eigenvalue ELSE CAST('inf' AS DOUBLE) END AS flatness_index,
       0.005e0 * s AS noise_sensitivity, sqrt(greatest(s, 0.0e0) / 100000.0e0) AS pac_bayes_term,
       CAST(NULL AS BOOLEAN) AS is_full
FROM a
""", rnd=["top_eigenvalue", "trace", "condition_number", "effective_rank", "sharpness_score",
          "flatness_index", "noise_sensitivity", "pac_bayes_term"])
def lnd_spectrum_summary(t):
    """LND-6: spectrum summary of every run's top-20 spectrum."""
    return ls.spectrum_summary(V.v_spectrum(t))


@query("lnd_store", """
SELECT run_id, idx, eigenvalue, max(eigenvalue) OVER (PARTITION BY run_id) AS top_eigenvalue FROM v_spectrum
""", rnd=["eigenvalue", "top_eigenvalue"])
def lnd_store(t):
    """SRC-12: spectra written as CSV and their summary as JSON lines, both read back."""
    folder = scratch_path(t.spark, "spectra")
    spectrum = V.v_spectrum(t)
    values = io.write_dataset(spectrum.select("run_id", "idx", "eigenvalue"), folder, "spectrum", "all", fmt="csv")
    report = io.write_dataset(ls.spectrum_summary(spectrum), folder, "report", "all", fmt="json")
    schema = spectrum.select("run_id", "idx", "eigenvalue").schema
    read = t.spark.read.schema(schema).options(**io.CSV_OPTIONS).csv(values)
    tops = t.spark.read.json(report).select("run_id", "top_eigenvalue")
    return read.join(tops, "run_id").select("run_id", "idx", "eigenvalue", "top_eigenvalue")


@query("lnd_explained", """
WITH c AS (SELECT run_id, idx, eigenvalue,
                  sum(eigenvalue) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  / sum(eigenvalue) OVER (PARTITION BY run_id) AS cumulative FROM v_spectrum),
n AS (SELECT run_id, min(CASE WHEN cumulative >= 0.9e0 THEN idx + 1 END) AS n_for_level FROM c GROUP BY run_id)
SELECT c.run_id, c.idx, c.eigenvalue, c.cumulative, n.n_for_level FROM c JOIN n ON c.run_id = n.run_id
""", rnd=["eigenvalue", "cumulative"])
def lnd_explained(t):
    """LND-7: cumulative variance explained and the count reaching 90 %."""
    return ls.explained_variance(V.v_spectrum(t))


_U1, _U2 = ls.surface_directions(W1)
_GRID = ls.surface_grid()


@query("lnd_surface", f"""
WITH b AS (SELECT {_M1} AS m0, list_dot_product(d, {S.list_lit(_U1)}) AS a,
                  list_dot_product(d, {S.list_lit(_U2)}) AS b FROM v_pairs_feat),
g AS (SELECT x.alpha, y.beta FROM (SELECT unnest({S.list_lit(_GRID)}) AS alpha) x,
                                  (SELECT unnest({S.list_lit(_GRID)}) AS beta) y)
SELECT g.alpha, g.beta, avg({S.softplus_neg('b.m0 + g.alpha * b.a + g.beta * b.b')}) AS loss
FROM b, g GROUP BY g.alpha, g.beta
""", rnd=["alpha", "beta", "loss"])
def lnd_surface(t):
    """LND-8: 21 x 21 loss surface around model 1 along w/|w| and e0 (orthogonalised)."""
    return ls.loss_surface(V.v_pairs_feat(t), W1, _U1, _U2)


@query("lnd_history", """
WITH top AS (SELECT run_id, epoch, value AS eigenvalue FROM (
               SELECT run_id, epoch, value,
                      row_number() OVER (PARTITION BY run_id, epoch ORDER BY value DESC) AS rn
               FROM v_metric_log WHERE name = 'loss') WHERE rn <= 10),
a AS (SELECT run_id, epoch, count(*) AS n_eigenvalues, max(eigenvalue) AS top_eigenvalue,
             min(eigenvalue) AS last, sum(eigenvalue) AS s, sum(eigenvalue * eigenvalue) AS sq
      FROM top GROUP BY run_id, epoch)
SELECT run_id, epoch, n_eigenvalues, top_eigenvalue, s AS trace,
       top_eigenvalue / abs(CASE WHEN last = 0 THEN 1e-10 ELSE last END) AS condition_number,
       CASE WHEN sq > 0 THEN s * s / sq ELSE 1.0e0 END AS effective_rank,
       CASE WHEN s > 0 THEN top_eigenvalue / s ELSE 0.0e0 END AS sharpness_score,
       CASE WHEN top_eigenvalue > 0 THEN 1.0e0 / top_eigenvalue ELSE CAST('inf' AS DOUBLE) END AS flatness_index,
       0.005e0 * s AS noise_sensitivity, sqrt(greatest(s, 0.0e0) / 100000.0e0) AS pac_bayes_term,
       CAST(NULL AS BOOLEAN) AS is_full
FROM a
""", rnd=["top_eigenvalue", "trace", "condition_number", "effective_rank", "sharpness_score",
          "flatness_index", "noise_sensitivity", "pac_bayes_term"])
def lnd_history(t):
    """LND-9: per-epoch top-10 spectrum summary (every epoch)."""
    vals = V.v_metric_log(t).filter(F.col("name") == "loss")
    return ls.spectrum_history(vals)
