"""Training bookkeeping over step / epoch logs (TRN-4..6).

Windows here are partitioned by run and range over epochs, so their size is
bounded by the number of epochs of one run, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_rollup(steps: DataFrame, run_col="run_id", epoch_col="epoch", name_col="name",
                 value_col="value") -> DataFrame:
    """TRN-4: epoch value = unweighted mean of the step (batch-mean) values."""
    return steps.groupBy(run_col, epoch_col, name_col).agg(
        F.avg(value_col).alias("value"), F.count(F.lit(1)).alias("n_steps"))


def epoch_table(steps: DataFrame, names, run_col="run_id", epoch_col="epoch",
                name_col="name", value_col="value") -> DataFrame:
    """Pivot epoch means to one column per metric (names listed: no extra job)."""
    return steps.groupBy(run_col, epoch_col).pivot(name_col, list(names)).avg(value_col)


def topk_checkpoints(epochs: DataFrame, metric: str, k: int = 3, run_col="run_id",
                     epoch_col="epoch") -> DataFrame:
    """TRN-5: the k best epochs by ``metric`` (earlier epoch on ties) plus the
    last epoch of each run.  row_number <= k is planned as WindowGroupLimit."""
    w = Window.partitionBy(run_col).orderBy(F.col(metric).desc(), F.col(epoch_col))
    last = epochs.groupBy(run_col).agg(F.max(epoch_col).alias("_last"))
    ranked = epochs.select(run_col, epoch_col, F.col(metric).alias("value"),
                           F.row_number().over(w).alias("rank"))
    j = ranked.join(last, run_col)
    return j.filter((F.col("rank") <= k) | (F.col(epoch_col) == F.col("_last"))).select(
        run_col, epoch_col, "value", F.when(F.col("rank") <= k, F.col("rank")).alias("rank"),
        (F.col(epoch_col) == F.col("_last")).alias("is_last"))


def early_stop(epochs: DataFrame, metric: str, patience: int = 3, mode: str = "max",
               run_col="run_id", epoch_col="epoch") -> DataFrame:
    """TRN-6: first epoch at which ``patience`` epochs passed without a strict
    improvement of the best value so far (NULL when training never stops)."""
    v = F.col(metric) if mode == "max" else -F.col(metric)
    w_prev = Window.partitionBy(run_col).orderBy(epoch_col).rowsBetween(
        Window.unboundedPreceding, -1)
    w_upto = Window.partitionBy(run_col).orderBy(epoch_col).rowsBetween(
        Window.unboundedPreceding, 0)
    w_pos = Window.partitionBy(run_col).orderBy(epoch_col)
    e = epochs.select(run_col, epoch_col, v.alias("_v"), F.col(metric).alias("value"))
    e = e.withColumn("_best_before", F.max("_v").over(w_prev)) \
        .withColumn("_pos", F.row_number().over(w_pos))
    e = e.withColumn("_improved", F.col("_best_before").isNull() | (F.col("_v") > F.col("_best_before")))
    e = e.withColumn("_last_imp", F.max(F.when(F.col("_improved"), F.col("_pos"))).over(w_upto))
    e = e.withColumn("_stop", (F.col("_pos") - F.col("_last_imp")) >= patience)
    return e.groupBy(run_col).agg(
        F.min(F.when(F.col("_stop"), F.col(epoch_col))).alias("stop_epoch"),
        F.max_by(F.col(epoch_col), F.struct(F.col("_v"), -F.col("_pos"))).alias("best_epoch"),
        F.max_by(F.col("value"), F.struct(F.col("_v"), -F.col("_pos"))).alias("best_value"))
