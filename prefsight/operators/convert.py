"""Dataset converters to (prompt, chosen, rejected) (CNV-*)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefsight.functions import py_strip
from prefsight.operators.indexing import global_index

# Transcript turn markers.
HUMAN_TAG = "\n\nHuman:"
ASSISTANT_TAG = "\n\nAssistant:"


def split_transcripts(df: DataFrame, chosen_col="chosen", rejected_col="rejected",
                      keep=()) -> DataFrame:
    """CNV-1: cut each transcript at its LAST assistant tag.

    prompt = the chosen transcript's head with every human tag removed,
    stripped; responses are stripped tails.  Without a tag the prompt is ''
    and the whole text is the (unstripped) response.  The rejected
    transcript's own head is dropped."""
    c, r = F.col(chosen_col), F.col(rejected_col)
    c_tail = F.substring_index(c, ASSISTANT_TAG, -1)
    c_head = F.left(c, F.length(c) - F.length(c_tail) - F.lit(len(ASSISTANT_TAG)))
    has_c = F.instr(c, ASSISTANT_TAG) > 0
    has_r = F.instr(r, ASSISTANT_TAG) > 0
    prompt = F.when(has_c, py_strip(F.replace(c_head, F.lit(HUMAN_TAG), F.lit("")))).otherwise(F.lit(""))
    chosen = F.when(has_c, py_strip(c_tail)).otherwise(c)
    rejected = F.when(has_r, py_strip(F.substring_index(r, ASSISTANT_TAG, -1))).otherwise(r)
    return df.select(*keep, prompt.alias("prompt"), chosen.alias("chosen"),
                     rejected.alias("rejected"))


def best_worst_long(df: DataFrame, group_cols, idx_col="completion_idx", score_col="overall_score",
                    response_col="response", prompt_col="prompt") -> DataFrame:
    """CNV-2 on long rows (one row per completion): highest score (earliest on
    ties) is chosen, lowest score (latest on ties) is rejected; prompts with
    fewer than two completions are skipped.  Partial aggregation only."""
    s = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0))
    resp = F.coalesce(F.col(response_col), F.lit(""))
    key = F.struct((-s).alias("ns"), F.col(idx_col).alias("i"))
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first(F.coalesce(F.col(prompt_col), F.lit(""))).alias("_prompt"),
        F.min_by(resp, key).alias("chosen"), F.max_by(resp, key).alias("rejected"))
    return agg.filter(F.col("_n") >= 2).select(*group_cols, F.col("_prompt").alias("prompt"),
                                               "chosen", "rejected")


def best_worst_array(df: DataFrame, completions_col="completions", keep=()) -> DataFrame:
    """CNV-2 on rows that carry an array<struct<response, overall_score>>:
    a per-row array sort on (-score, position), no shuffle."""
    prompt = (F.coalesce(F.col("instruction"), F.col("prompt"), F.lit(""))
              if "instruction" in df.columns and "prompt" in df.columns
              else F.coalesce(F.col("instruction"), F.lit("")) if "instruction" in df.columns
              else F.coalesce(F.col("prompt"), F.lit("")) if "prompt" in df.columns else F.lit(""))
    keyed = F.transform(F.col(completions_col), lambda x, i: F.struct(
        (-F.coalesce(x["overall_score"].cast("double"), F.lit(0.0))).alias("ns"), i.alias("i"),
        F.coalesce(x["response"], F.lit("")).alias("response")))
    srt = F.array_sort(keyed)
    out = df.select(*keep, prompt.alias("prompt"), srt.alias("_s"))
    return out.filter(F.size("_s") >= 2).select(
        *keep, "prompt", F.element_at("_s", 1)["response"].alias("chosen"),
        F.element_at("_s", -1)["response"].alias("rejected"))


def ab_label(df: DataFrame, keep=()) -> DataFrame:
    """CNV-3: label 1 -> A is chosen; any other value (including an explicit
    NULL, as in the reference) -> B; a missing label column means 1."""
    lab = F.col("labels") if "labels" in df.columns else F.lit(1)
    a_wins = F.coalesce(lab == 1, F.lit(False))
    a = F.coalesce(F.col("human_ref_A"), F.lit(""))
    b = F.coalesce(F.col("human_ref_B"), F.lit(""))
    return df.select(*keep, F.coalesce(F.col("history"), F.lit("")).alias("prompt"),
                     F.when(a_wins, a).otherwise(b).alias("chosen"),
                     F.when(a_wins, b).otherwise(a).alias("rejected"))


def consecutive_pairs(df: DataFrame, order_cols, score_col="helpfulness") -> DataFrame:
    """CNV-4: pair rows (0,1), (2,3), ... in order; the odd last row is dropped.
    The first row is chosen only when its score is strictly higher.

    Positions come from ``global_index`` (no single-task window); each pair is
    a 2-row group aggregated with min_by / max_by."""
    idx = global_index(df, order_cols, "_idx")
    s = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0))
    rows = idx.select((F.col("_idx") / 2).cast("bigint").alias("pair_idx"), F.col("_idx"),
                      F.coalesce(F.col("prompt"), F.lit("")).alias("p"),
                      F.col("response").alias("r"), s.alias("s"))
    g = rows.groupBy("pair_idx").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct("p", "r", "s"), "_idx").alias("first"),
        F.max_by(F.struct("r", "s"), "_idx").alias("second"))
    first_wins = F.col("first.s") > F.col("second.s")
    return g.filter(F.col("_n") == 2).select(
        "pair_idx", F.col("first.p").alias("prompt"),
        F.when(first_wins, F.col("first.r")).otherwise(F.col("second.r")).alias("chosen"),
        F.when(first_wins, F.col("second.r")).otherwise(F.col("first.r")).alias("rejected"))


CONVERTERS: dict[str, Callable[..., DataFrame]] = {
    "transcripts": split_transcripts,
    "scored_completions": best_worst_array,
    "ab_labels": ab_label,
    "single_responses": consecutive_pairs,
}


def convert(name: str, df: DataFrame, **kwargs) -> DataFrame:
    """CNV-5: dispatch by source kind; unknown names raise."""
    if name not in CONVERTERS:
        raise ValueError(f"Unknown dataset kind: {name!r}; known: {sorted(CONVERTERS)}")
    return CONVERTERS[name](df, **kwargs)
