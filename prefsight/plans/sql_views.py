"""DuckDB twins of ``prefsight.sources.views`` as CTE bodies.

``with_views(sql)`` prefixes exactly the CTEs a query mentions (and their
dependencies), so every oracle string is self-contained over the base tables.
"""

from __future__ import annotations

import re

from prefsight.sources.views import (
    METRIC_LOG_NAMES,
    OPTIMIZER_OF_EVENT,
    SCORE_MODELS,
)

_models_values = ", ".join(f"({m}, {p1}, {q}, {mul}, {p2})" for (m, p1, q, mul, p2) in SCORE_MODELS)
_opt_case = "CASE " + " ".join(f"WHEN event_type = '{e}' THEN '{o}'"
                               for e, o in OPTIMIZER_OF_EVENT.items()) + " END"
_name_case = ("CASE user_id % 4 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in
                                             enumerate(METRIC_LOG_NAMES)) + " END")
_div_case = ("CASE user_id % 4 " + " ".join(f"WHEN {i} THEN {d!r}e0" for i, (_, d) in
                                            enumerate(METRIC_LOG_NAMES)) + " END")

VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_margins": ("""
SELECT event_id AS pair_id, event_type AS grp, (value - 30.0) / 41.0 AS margin FROM events
""", []),
    "v_scores": (f"""
SELECT o.o_orderkey AS pair_id, m.model_id,
       (o.o_totalprice % CAST(m.p1 AS DOUBLE)) / CAST(m.q AS DOUBLE) AS r_a,
       CAST((o.o_custkey * m.mul) % m.p2 AS DOUBLE) * 4.0e0 / CAST(m.p2 AS DOUBLE) AS r_b,
       (o.o_totalprice % CAST(m.p1 AS DOUBLE)) / CAST(m.q AS DOUBLE)
         - CAST((o.o_custkey * m.mul) % m.p2 AS DOUBLE) * 4.0e0 / CAST(m.p2 AS DOUBLE) AS margin
FROM orders o, (VALUES {_models_values}) m(model_id, p1, q, mul, p2)
""", []),
    "v_cand_base": ("""
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
          l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS sample_idx
FROM lineitem
""", []),
    "v_candidates": ("""
SELECT l_orderkey AS prompt_id, sample_idx, 'part ' || CAST(l_partkey AS VARCHAR) AS response,
       l_extendedprice * (1 - l_discount) / 100 AS reward, -l_quantity AS log_prob,
       -(l_quantity + 10 * l_tax) AS base_log_prob
FROM v_cand_base
""", ["v_cand_base"]),
    "v_completions_long": ("""
SELECT l_orderkey AS prompt_id, 'prompt ' || CAST(l_orderkey AS VARCHAR) AS prompt,
       sample_idx AS completion_idx, 'part ' || CAST(l_partkey AS VARCHAR) AS response,
       l_quantity AS overall_score
FROM v_cand_base
""", ["v_cand_base"]),
    "v_tr_base": ("""
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN chr(10) || chr(10) || 'Human: '
                                WHEN 'assistant' THEN chr(10) || chr(10) || 'Assistant: '
                                ELSE chr(10) || chr(10) || 'System: ' END || text, ''
                           ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id
""", []),
    "v_transcripts": ("""
SELECT a.conv_id, a.transcript AS chosen, b.transcript AS rejected
FROM v_tr_base a JOIN v_tr_base b ON b.conv_id = a.conv_id + 1
""", ["v_tr_base"]),
    "v_ab": ("""
SELECT o_orderkey AS pair_id, 'priority ' || o_orderpriority AS history,
       'status ' || o_orderstatus || ' customer ' || CAST(o_custkey AS VARCHAR) AS human_ref_A,
       'order ' || CAST(o_orderkey AS VARCHAR) || ' customer ' || CAST(o_custkey AS VARCHAR) AS human_ref_B,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 0 ELSE NULL END AS INTEGER) AS labels
FROM orders
""", []),
    "v_single": ("""
SELECT doc_id AS ord, lang AS prompt, text AS response, n_chars % 5 AS helpfulness FROM documents
""", []),
    "v_dl": ("""
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality,
       row_number() OVER (PARTITION BY l.quality, d.lang ORDER BY d.doc_id) - 1 AS r
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""", []),
    "v_dl_n0": ("""
SELECT lang, count(*) AS n0 FROM v_dl WHERE quality = 0 GROUP BY lang
""", ["v_dl"]),
    "v_text_pairs": ("""
SELECT c.doc_id AS pair_id, 'Write a ' || c.lang || ' text from ' || c.source AS prompt,
       c.text AS chosen, x.text AS rejected, CAST(c.n_chars % 101 AS DOUBLE) / 100.0 AS margin
FROM v_dl c JOIN v_dl_n0 n ON c.lang = n.lang
JOIN v_dl x ON x.quality = 0 AND x.lang = c.lang AND x.r = c.r % n.n0
WHERE c.quality = 1
""", ["v_dl", "v_dl_n0"]),
    "v_reject": ("""
SELECT pair_id,
       CASE WHEN pair_id % 7 = 1 THEN '' WHEN pair_id % 7 = 4 THEN '   ' ELSE prompt END AS prompt,
       CASE WHEN pair_id % 7 = 2 THEN CAST(NULL AS VARCHAR) ELSE chosen END AS chosen,
       CASE WHEN pair_id % 7 = 3 THEN '' ELSE rejected END AS rejected,
       CASE WHEN pair_id % 7 = 5 THEN CAST(NULL AS DOUBLE) ELSE margin END AS margin
FROM v_text_pairs
""", ["v_text_pairs"]),
    "v_emb_ranked": ("""
SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r
FROM embeddings
""", []),
    "v_pairs_feat": ("""
SELECT a.vec_id AS pair_id,
       list_transform(range(1, len(a.embedding) + 1),
                      lambda i: CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) AS d
FROM v_emb_ranked a JOIN v_emb_ranked b ON b.label = (a.label + 1) % 10 AND b.r = a.r
""", ["v_emb_ranked"]),
    "v_pool": ("""
SELECT o_orderkey AS pair_id, 'priority ' || o_orderpriority AS prompt,
       'status ' || o_orderstatus || ' for customer ' || CAST(o_custkey AS VARCHAR) AS response_a,
       'order ' || CAST(o_orderkey AS VARCHAR) || ' status ' || o_orderstatus AS response_b
FROM orders
""", []),
    "v_pool_labels": ("""
SELECT o_orderkey AS pair_id, CAST(o_orderkey % 2 AS INTEGER) AS label FROM orders
""", []),
    "v_runs": (f"""
SELECT {_opt_case} AS optimizer, user_id % 3 AS seed,
       avg(value) / 59.0 AS final_val_accuracy, avg(value) / 97.0 AS final_val_loss,
       stddev_pop(value) / 499.0 AS calibration_ece, max(value) AS top_eigenvalue,
       max(value) / min(value) AS condition_number, max(value) / sum(value) AS sharpness_score,
       1.0e0 / max(value) AS flatness_index, sum(value) AS trace_estimate,
       CAST(count(*) AS DOUBLE) AS training_time_seconds, avg(value) / 97.0 AS rl_readiness_score
FROM events GROUP BY 1, 2
""", []),
    "v_metric_log": (f"""
SELECT event_type AS run_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
       event_id AS step, {_name_case} AS name, value / {_div_case} AS value
FROM events
""", []),
    "v_spectrum": ("""
SELECT run_id, CAST(idx AS INTEGER) AS idx, eigenvalue FROM (
  SELECT event_type AS run_id, value AS eigenvalue,
         row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS idx
  FROM events) WHERE idx < 20
""", []),
}


def linear_weights_sql(model_expr: str, dim: int = 64) -> str:
    """SQL list of the linear model weights; twin of ``views.linear_weights``."""
    return (f"list_transform(range({dim}), lambda j: CAST((((j * (2 * {model_expr} + 1) + "
            f"{model_expr}) % 11) - 5) AS DOUBLE) / 5.0e0)")


def _deps(name: str, seen: list[str]) -> None:
    body, deps = VIEWS[name]
    for d in deps:
        _deps(d, seen)
    if name not in seen:
        seen.append(name)


def with_views(sql: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix the CTEs for every ``v_*`` view named in ``sql`` (and in extra CTEs)."""
    text = sql + " ".join(b for _, b in (extra_ctes or []))
    needed: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            _deps(name, needed)
    ctes = [f"{n} AS ({VIEWS[n][0].strip()})" for n in needed]
    ctes += [f"{n} AS ({b.strip()})" for n, b in (extra_ctes or [])]
    if not ctes:
        return sql.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + sql.strip()
