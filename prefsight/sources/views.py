"""Input views derived from the mounted tables (Spark side).

Each view turns generic tables into the inputs our operators take: preference
pairs, per-model scores, generated candidates, step logs, spectra.  The DuckDB
twins in ``prefsight.plans.sql_views`` use the same arithmetic.  Per-group
positions go through ``index_within_group`` (no window over a hot key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from prefsight.functions import ieee_div, vec_sub
from prefsight.operators.indexing import index_within_group
from prefsight.sources.tables import Tables

# The three synthetic scorers of v_scores as (model_id, p1, q, mul, p2);
# r_a = (o_totalprice % p1) / q and r_b = ((o_custkey * mul) % p2) * 4 / p2.
SCORE_MODELS = [(1, 1000, 250, 1, 97), (2, 700, 175, 3, 89), (3, 1300, 325, 7, 101)]

# event_type -> optimizer name for the v_runs / v_metric_log views.
OPTIMIZER_OF_EVENT = {"click": "adam", "error": "adamw", "purchase": "sgd",
                      "signup": "muon", "view": "lion"}

# Metric names of v_metric_log by user_id % 4, and their divisors
# (coprime to 10, so averages do not land on decimal rounding boundaries).
METRIC_LOG_NAMES = [("loss", 97.0), ("val_accuracy", 499.0),
                    ("calibration_ece", 1999.0), ("margin_mean", 47.0)]

FEATURE_DIM = 64
LINEAR_MODEL_IDS = (1, 2, 3)


def linear_weights(model_id: int, dim: int = FEATURE_DIM) -> list[float]:
    """Weight vector of linear reward model ``model_id``: ((j*(2m+1)+m) % 11 - 5) / 5."""
    return [float(((j * (2 * model_id + 1) + model_id) % 11) - 5) / 5.0 for j in range(dim)]


def v_margins(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("pair_id"),
        F.col("event_type").alias("grp"),
        ((F.col("value") - 30.0) / 41.0).alias("margin"))


def v_scores(t: Tables) -> DataFrame:
    models = F.array(*[
        F.struct(F.lit(m).alias("model_id"), F.lit(float(p1)).alias("p1"),
                 F.lit(float(q)).alias("q"), F.lit(mul).cast("bigint").alias("mul"),
                 F.lit(p2).cast("bigint").alias("p2"))
        for (m, p1, q, mul, p2) in SCORE_MODELS])
    o = t.orders.select("o_orderkey", "o_totalprice", "o_custkey", F.inline(models))
    r_a = (F.col("o_totalprice") % F.col("p1")) / F.col("q")
    r_b = ((F.col("o_custkey") * F.col("mul")) % F.col("p2")).cast("double") * 4.0 / F.col("p2")
    return o.select(F.col("o_orderkey").alias("pair_id"), "model_id",
                    r_a.alias("r_a"), r_b.alias("r_b"), (r_a - r_b).alias("margin"))


_CAND_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
               "l_quantity", "l_discount", "l_tax"]


def _candidates_base(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", *_CAND_ORDER)
    return index_within_group(li, ["l_orderkey"], _CAND_ORDER, "sample_idx")


def v_candidates(t: Tables, index: bool = True) -> DataFrame:
    """Generated samples; ``index=False`` leaves out sample_idx and its sort."""
    b = _candidates_base(t) if index else t.lineitem
    return b.select(
        F.col("l_orderkey").alias("prompt_id"), *(["sample_idx"] if index else []),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("response"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100).alias("reward"),
        (-F.col("l_quantity")).alias("log_prob"),
        (-(F.col("l_quantity") + 10 * F.col("l_tax"))).alias("base_log_prob"))


def v_completions_long(t: Tables) -> DataFrame:
    """Scored completions in long form: one row per (prompt, completion)."""
    b = _candidates_base(t)
    return b.select(
        F.col("l_orderkey").alias("prompt_id"),
        F.concat(F.lit("prompt "), F.col("l_orderkey").cast("string")).alias("prompt"),
        F.col("sample_idx").alias("completion_idx"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("response"),
        F.col("l_quantity").alias("overall_score"))


def v_transcripts(t: Tables) -> DataFrame:
    piece = F.concat(F.when(F.col("role") == "user", F.lit("\n\nHuman: "))
                     .when(F.col("role") == "assistant", F.lit("\n\nAssistant: "))
                     .otherwise(F.lit("\n\nSystem: ")), F.col("text"))
    tr = (t.conversations.groupBy("conv_id")
          .agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), piece.alias("piece"))))
               .alias("turns"))
          .select("conv_id", F.array_join(F.transform("turns", lambda x: x["piece"]), "")
                  .alias("transcript")))
    nxt = tr.select((F.col("conv_id") - 1).alias("conv_id"), F.col("transcript").alias("rejected"))
    return tr.join(nxt, "conv_id").select("conv_id", F.col("transcript").alias("chosen"),
                                          "rejected")


def v_ab(t: Tables) -> DataFrame:
    o = t.orders
    k = F.col("o_orderkey")
    return o.select(
        k.alias("pair_id"),
        F.concat(F.lit("priority "), F.col("o_orderpriority")).alias("history"),
        F.concat(F.lit("status "), F.col("o_orderstatus"), F.lit(" customer "),
                 F.col("o_custkey").cast("string")).alias("human_ref_A"),
        F.concat(F.lit("order "), k.cast("string"), F.lit(" customer "),
                 F.col("o_custkey").cast("string")).alias("human_ref_B"),
        F.when(k % 3 == 0, F.lit(1)).when(k % 3 == 1, F.lit(0))
        .otherwise(F.lit(None)).cast("int").alias("labels"))


def v_single(t: Tables) -> DataFrame:
    d = t.documents
    return d.select(F.col("doc_id").alias("ord"), F.col("lang").alias("prompt"),
                    F.col("text").alias("response"),
                    (F.col("n_chars") % 5).alias("helpfulness"))


def v_text_pairs(t: Tables) -> DataFrame:
    """Pairs of a good text and a bad one of its language.

    Positions are made on keys only; texts are joined to the finished pairs."""
    keys = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id")
    ranked = index_within_group(keys, ["quality", "lang"], ["doc_id"], "r")
    rej = ranked.filter(F.col("quality") == 0)
    n0 = rej.groupBy("lang").agg(F.count(F.lit(1)).alias("n0"))
    c = ranked.filter(F.col("quality") == 1).join(n0, "lang") \
        .select(F.col("doc_id").alias("pair_id"), "lang", (F.col("r") % F.col("n0")).alias("r"))
    pairs = c.join(rej.select("lang", "r", F.col("doc_id").alias("rejected_id")), ["lang", "r"])
    good = t.documents.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("chosen"), "source", "n_chars")
    bad = t.documents.select(F.col("doc_id").alias("rejected_id"), F.col("text").alias("rejected"))
    return pairs.join(good, "pair_id").join(bad, "rejected_id").select(
        "pair_id", F.concat(F.lit("Write a "), F.col("lang"), F.lit(" text from "), F.col("source")).alias("prompt"),
        "chosen", "rejected", ((F.col("n_chars") % 101).cast("double") / 100.0).alias("margin"))


def v_reject(t: Tables) -> DataFrame:
    p = v_text_pairs(t)
    k = F.col("pair_id") % 7
    return p.select(
        "pair_id",
        F.when(k == 1, F.lit("")).when(k == 4, F.lit("   ")).otherwise(F.col("prompt"))
        .alias("prompt"),
        F.when(k == 2, F.lit(None).cast("string")).otherwise(F.col("chosen")).alias("chosen"),
        F.when(k == 3, F.lit("")).otherwise(F.col("rejected")).alias("rejected"),
        F.when(k == 5, F.lit(None).cast("double")).otherwise(F.col("margin")).alias("margin"))


def v_empty_responses(t: Tables) -> DataFrame:
    """Features of each prompt with an empty response: half the prompt's first vector."""
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first.select("label", F.transform("embedding", lambda x: x.cast("double") * 0.5).alias("embedding"))


def v_embeddings_ranked(t: Tables) -> DataFrame:
    return index_within_group(t.embeddings, ["label"], ["vec_id"], "r")


def v_pairs_feat(t: Tables) -> DataFrame:
    e = v_embeddings_ranked(t)
    a = e.select(F.col("vec_id").alias("pair_id"), F.col("label").alias("a_label"),
                 F.col("r").alias("a_r"), F.col("embedding").alias("a_emb"))
    b = e.select(F.col("label").alias("b_label"), F.col("r").alias("b_r"),
                 F.col("embedding").alias("b_emb"))
    j = a.join(b, (b["b_label"] == (a["a_label"] + 1) % 10) & (b["b_r"] == a["a_r"]))
    return j.select("pair_id", vec_sub("a_emb", "b_emb").alias("d"))


def v_pool(t: Tables) -> DataFrame:
    o = t.orders
    k = F.col("o_orderkey")
    return o.select(
        k.alias("pair_id"),
        F.concat(F.lit("priority "), F.col("o_orderpriority")).alias("prompt"),
        F.concat(F.lit("status "), F.col("o_orderstatus"), F.lit(" for customer "),
                 F.col("o_custkey").cast("string")).alias("response_a"),
        F.concat(F.lit("order "), k.cast("string"), F.lit(" status "),
                 F.col("o_orderstatus")).alias("response_b"))


def v_pool_labels(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("pair_id"),
                           (F.col("o_orderkey") % 2).cast("int").alias("label"))


def _optimizer_col(c: str):
    expr = None
    for ev, opt in OPTIMIZER_OF_EVENT.items():
        expr = (F.when(F.col(c) == ev, F.lit(opt)) if expr is None
                else expr.when(F.col(c) == ev, F.lit(opt)))
    return expr


def v_runs(t: Tables) -> DataFrame:
    """One row per (optimizer, seed) with the run-result fields of a comparison;
    a run whose least, total or greatest value is 0 has an infinite or NaN ratio."""
    e = t.events.select(_optimizer_col("event_type").alias("optimizer"),
                        (F.col("user_id") % 3).alias("seed"), "value")
    v = F.col("value")
    return (e.groupBy("optimizer", "seed").agg(
        (F.avg(v) / 59.0).alias("final_val_accuracy"),
        (F.avg(v) / 97.0).alias("final_val_loss"),
        (F.stddev_pop(v) / 499.0).alias("calibration_ece"),
        F.max(v).alias("top_eigenvalue"),
        ieee_div(F.max(v), F.min(v)).alias("condition_number"),
        ieee_div(F.max(v), F.sum(v)).alias("sharpness_score"),
        ieee_div(F.lit(1.0), F.max(v)).alias("flatness_index"),
        F.sum(v).alias("trace_estimate"),
        F.count(F.lit(1)).cast("double").alias("training_time_seconds"),
        (F.avg(v) / 97.0).alias("rl_readiness_score")))


def v_metric_log(t: Tables) -> DataFrame:
    k = F.col("user_id") % 4
    name = F.when(k == 0, F.lit(METRIC_LOG_NAMES[0][0])).when(k == 1, F.lit(METRIC_LOG_NAMES[1][0])) \
        .when(k == 2, F.lit(METRIC_LOG_NAMES[2][0])).otherwise(F.lit(METRIC_LOG_NAMES[3][0]))
    div = F.when(k == 0, F.lit(METRIC_LOG_NAMES[0][1])).when(k == 1, F.lit(METRIC_LOG_NAMES[1][1])) \
        .when(k == 2, F.lit(METRIC_LOG_NAMES[2][1])).otherwise(F.lit(METRIC_LOG_NAMES[3][1]))
    epoch = F.datediff(F.to_date(F.col("ts")), F.to_date(F.lit("2024-01-01")))
    return t.events.select(F.col("event_type").alias("run_id"), epoch.alias("epoch"),
                           F.col("event_id").alias("step"), name.alias("name"),
                           (F.col("value") / div).alias("value"))


def v_spectrum(t: Tables, k: int = 20) -> DataFrame:
    # row_number <= k over a partitioned window is planned as WindowGroupLimit:
    # each input partition keeps <= k rows per run before the shuffle.
    w = Window.partitionBy("event_type").orderBy(F.col("value").desc(), F.col("event_id"))
    return (t.events.select("event_type", "event_id", "value")
            .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
            .select(F.col("event_type").alias("run_id"), (F.col("rn") - 1).alias("idx"),
                    F.col("value").alias("eigenvalue")))
