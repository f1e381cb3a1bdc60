"""Reward scoring with linear Bradley-Terry models (RWD-*, ENS-5).

A model is a weight vector w; the reward of a response with features phi is
w . phi, the margin of a pair is w . (phi_chosen - phi_rejected).  Models are
few and small: they are collected once (behind a size check) and inlined into
the plan as literal arrays, so scoring every model is a per-row Generate
(no join, no shuffle) and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefsight.functions import dot, lit_vector, sigmoid, softplus_neg

# Upper bound on model weights inlined into a plan (models x dims doubles).
MAX_INLINE_WEIGHTS = 1_000_000


class LinearModels:
    """A bounded set of linear reward models {model_id: weights}."""

    def __init__(self, weights: dict[int, list[float]]):
        total = sum(len(w) for w in weights.values())
        if total > MAX_INLINE_WEIGHTS:
            raise ValueError(f"{total} weights exceed the inline bound {MAX_INLINE_WEIGHTS}; "
                             "score models in batches")
        dims = {len(w) for w in weights.values()}
        if len(dims) > 1:
            raise ValueError(f"models disagree on dimension: {sorted(dims)}")
        self.weights = {int(k): [float(x) for x in v] for k, v in weights.items()}

    @classmethod
    def from_frame(cls, models: DataFrame, id_col="model_id", w_col="w") -> "LinearModels":
        """Collect a models table after checking its size (never a data table)."""
        n = models.count()
        if n > 10_000:
            raise ValueError(f"{n} models: too many to inline")
        return cls({r[id_col]: list(r[w_col]) for r in models.select(id_col, w_col).collect()})

    @property
    def dim(self) -> int:
        return len(next(iter(self.weights.values())))

    def as_array(self) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("model_id"), lit_vector(w).alias("w"))
                         for k, w in sorted(self.weights.items())])

    def add(self, model_id: int, w) -> "LinearModels":
        """ENS-5: extend the ensemble with one more model."""
        d = dict(self.weights)
        d[int(model_id)] = list(w)
        return LinearModels(d)

    @property
    def size(self) -> int:
        return len(self.weights)


def score_all(df: DataFrame, models: LinearModels, feat_col: str, keep=(),
              out_col: str = "reward") -> DataFrame:
    """RWD-1 / ENS-5: one row per (input row, model) with reward = w . phi."""
    expanded = df.select(*keep, feat_col, F.inline(models.as_array()))
    return expanded.select(*keep, "model_id", dot("w", feat_col).alias(out_col))


def pair_margins(df: DataFrame, models: LinearModels, diff_col: str = "d", keep=("pair_id",)):
    """RWD-2: margin r(chosen) - r(rejected) = w . d for every model."""
    return score_all(df, models, diff_col, keep, "margin")


def predict(df: DataFrame, margin_col: str = "margin") -> DataFrame:
    """RWD-3: (correct, margin); a zero margin counts as wrong."""
    return df.withColumn("correct", F.col(margin_col) > 0)


def absolute_reward(scored: DataFrame, empty: DataFrame, prompt_cols, reward_col: str = "reward",
                    model_col: str = "model_id") -> DataFrame:
    """RWD-4: r(prompt, response) - r(prompt, "").

    ``empty`` has one scored row per prompt and model: the reward of the features of
    the prompt with an empty response.  It is aggregated per prompt before the join,
    so a hot prompt joins one row per model (AQE broadcasts or splits it); a prompt
    without such a row has a null baseline."""
    keys = [*prompt_cols, model_col]
    base = empty.groupBy(*keys).agg(F.avg(reward_col).alias("baseline"))
    return scored.join(base, keys, "left").withColumn(
        "absolute_reward", F.col(reward_col) - F.col("baseline"))


def score_with(df: DataFrame, scorers: dict, feat_col: str, keep=(), out_col: str = "reward") -> DataFrame:
    """Rewards of user scorers ``{model_id: function}``, one row per (input row, model).

    A function takes a batch of features (n x d doubles) and returns n rewards; it
    runs inside the tasks on Arrow batches, so any model that can be pickled fits."""
    from prefsight.operators.linalg import batch_matrix
    src = df.select(*keep, feat_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != feat_col]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = batch_matrix(pdf[feat_col])
            for model_id, scorer in sorted(scorers.items()):
                yield pdf[list(keep)].assign(model_id=model_id, **{out_col: scorer(x)})
    return src.mapInPandas(run, ", ".join([*fields, "model_id int", f"{out_col} double"]))


def bt_loss(df: DataFrame, group_cols=(), margin_col="margin") -> DataFrame:
    """RWD-5: mean Bradley-Terry loss -log sigmoid(margin), overflow-free."""
    return df.groupBy(*group_cols).agg(F.avg(softplus_neg(F.col(margin_col))).alias("loss"))


def batch_metrics(df: DataFrame, group_cols, chosen_col="r_a", rejected_col="r_b") -> DataFrame:
    """RWD-6: loss, accuracy, margin mean / sample std, chosen and rejected means."""
    m = F.col(chosen_col) - F.col(rejected_col)
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(softplus_neg(m)).alias("loss"),
        F.avg(F.when(m > 0, 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(m).alias("margin_mean"),
        F.stddev_samp(m).alias("margin_std"),
        F.avg(chosen_col).alias("chosen_reward_mean"),
        F.avg(rejected_col).alias("rejected_reward_mean"))


def preference_probability(margin: Column) -> Column:
    """RWD-7: P(chosen > rejected) = sigmoid(margin)."""
    return sigmoid(margin)
