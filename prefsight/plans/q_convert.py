"""CNV-* queries over v_transcripts / v_completions_long / v_ab / v_single."""

from __future__ import annotations

from prefsight.operators import convert as cv
from prefsight.plans import sql_fn as S
from prefsight.plans.registry import query
from prefsight.sources import views as V

_SEP = "chr(10) || chr(10) || 'Assistant:'"
_HUM = "chr(10) || chr(10) || 'Human:'"


@query("cnv_transcript", f"""
WITH s AS (SELECT conv_id, chosen, rejected,
                  string_split(chosen, {_SEP})[-1] AS c_tail,
                  string_split(rejected, {_SEP})[-1] AS r_tail,
                  contains(chosen, {_SEP}) AS has_c, contains(rejected, {_SEP}) AS has_r
           FROM v_transcripts)
SELECT conv_id,
       CASE WHEN has_c THEN {S.py_strip(f"replace(substring(chosen, 1, length(chosen) - length(c_tail) - 12), {_HUM}, '')")}
            ELSE '' END AS prompt,
       CASE WHEN has_c THEN {S.py_strip('c_tail')} ELSE chosen END AS chosen,
       CASE WHEN has_r THEN {S.py_strip('r_tail')} ELSE rejected END AS rejected
FROM s
""")
def cnv_transcript(t):
    """CNV-1: split transcripts at the last assistant turn."""
    return cv.split_transcripts(V.v_transcripts(t), keep=["conv_id"])


@query("cnv_best_worst", """
WITH r AS (SELECT prompt_id, prompt, response,
                  row_number() OVER (PARTITION BY prompt_id ORDER BY overall_score DESC, completion_idx) AS rb,
                  row_number() OVER (PARTITION BY prompt_id ORDER BY overall_score, completion_idx DESC) AS rw,
                  count(*) OVER (PARTITION BY prompt_id) AS n
           FROM v_completions_long)
SELECT prompt_id, max(prompt) AS prompt, max(CASE WHEN rb = 1 THEN response END) AS chosen,
       max(CASE WHEN rw = 1 THEN response END) AS rejected
FROM r WHERE n >= 2 GROUP BY prompt_id
""")
def cnv_best_worst(t):
    """CNV-2: best and worst completion per prompt (stable-sort tie rules)."""
    return cv.best_worst_long(V.v_completions_long(t), ["prompt_id"])


@query("cnv_ab_label", """
SELECT pair_id, history AS prompt,
       CASE WHEN labels = 1 THEN human_ref_A ELSE human_ref_B END AS chosen,
       CASE WHEN labels = 1 THEN human_ref_B ELSE human_ref_A END AS rejected
FROM v_ab
""")
def cnv_ab_label(t):
    """CNV-3: A/B comparisons with a label (1 = A preferred)."""
    return cv.ab_label(V.v_ab(t), keep=["pair_id"])


@query("cnv_consecutive", """
WITH r AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS idx, prompt, response,
                  CAST(coalesce(helpfulness, 0) AS DOUBLE) AS s FROM v_single),
p AS (SELECT idx // 2 AS pair_idx, count(*) AS n,
             max(CASE WHEN idx % 2 = 0 THEN prompt END) AS prompt,
             max(CASE WHEN idx % 2 = 0 THEN response END) AS r1,
             max(CASE WHEN idx % 2 = 1 THEN response END) AS r2,
             max(CASE WHEN idx % 2 = 0 THEN s END) AS s1,
             max(CASE WHEN idx % 2 = 1 THEN s END) AS s2
      FROM r GROUP BY idx // 2)
SELECT pair_idx, coalesce(prompt, '') AS prompt, CASE WHEN s1 > s2 THEN r1 ELSE r2 END AS chosen,
       CASE WHEN s1 > s2 THEN r2 ELSE r1 END AS rejected
FROM p WHERE n = 2
""")
def cnv_consecutive(t):
    """CNV-4: consecutive single responses paired by helpfulness."""
    return cv.consecutive_pairs(V.v_single(t), ["ord"])
