"""Run comparison tables (CMP-3..6) over a runs table (one row per optimizer x seed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary_report(runs: DataFrame, opt_col="optimizer") -> DataFrame:
    """CMP-3: per optimizer mean and population std of validation accuracy and
    top eigenvalue, means of condition number, sharpness, flatness and time.
    Optimizers without runs do not appear."""
    return runs.groupBy(opt_col).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("final_val_accuracy").alias("val_accuracy_mean"),
        F.stddev_pop("final_val_accuracy").alias("val_accuracy_std"),
        F.avg("top_eigenvalue").alias("top_eigenvalue_mean"),
        F.stddev_pop("top_eigenvalue").alias("top_eigenvalue_std"),
        F.avg("condition_number").alias("condition_number_mean"),
        F.avg("sharpness_score").alias("sharpness_mean"),
        F.avg("flatness_index").alias("flatness_mean"),
        F.avg("training_time_seconds").alias("training_time_mean"))


def metric_by_optimizer(runs: DataFrame, metric: str, opt_col="optimizer") -> DataFrame:
    """CMP-4: mean / population std / count of any metric; a missing value counts as 0."""
    v = F.coalesce(F.col(metric).cast("double"), F.lit(0.0)) if metric in runs.columns else F.lit(0.0)
    return runs.groupBy(opt_col).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
                                     F.count(F.lit(1)).alias("points"))


def training_curves(epoch_table: DataFrame, run_col="run_id", epoch_col="epoch",
                    metrics=None) -> DataFrame:
    """CMP-5: (run, epoch) rows with one column per metric, epochs renumbered
    from 1 in order.  The window is per run over its epochs (bounded by the
    number of epochs, not by data volume)."""
    w = Window.partitionBy(run_col).orderBy(epoch_col)
    cols = [c for c in epoch_table.columns if c not in (run_col, epoch_col)]
    metrics = metrics or cols
    return epoch_table.select(run_col, F.dense_rank().over(w).alias("epoch"),
                              *[F.col(m) for m in metrics])


def best_run(runs: DataFrame, metric: str, maximize: bool = True, key_cols=("optimizer", "seed")):
    """CMP-6: the run with the best value of ``metric``; ties go to the
    smallest key.  One partial-aggregated min_by, no sort of the runs table."""
    v = F.col(metric)
    order = F.struct((-v if maximize else v).alias("_v"), *[F.col(k) for k in key_cols])
    best = runs.agg(F.min_by(F.struct(*key_cols, metric), order).alias("b"))
    return best.select(*[F.col(f"b.{k}").alias(k) for k in key_cols],
                       F.col(f"b.{metric}").alias("value"))
