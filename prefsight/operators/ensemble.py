"""Ensemble uncertainty over a long scores table (item, model, reward) (ENS-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefsight.operators.selection import order_statistics

DEFAULT_UNCERTAINTY_THRESHOLD = 0.5


def predict(scores: DataFrame, item_cols, reward_col="reward", model_col="model_id",
            threshold: float = DEFAULT_UNCERTAINTY_THRESHOLD, with_list: bool = False, models=None):
    """ENS-1: per item mean, population std and a strict ``std > threshold`` flag.

    The per-item reward list in the order of the models is optional.  With the ids of
    the ``models`` it is made of one hash-aggregated column each (one reward per item
    and model); without them it is collected."""
    r = F.col(reward_col)
    aggs = [F.avg(r).alias("mean_reward"), F.stddev_pop(r).alias("std_reward"),
            F.count(F.lit(1)).alias("n_models"), F.min(r).alias("min_reward"),
            F.max(r).alias("max_reward")]
    if with_list and models is not None:
        aggs.append(F.array_compact(F.array(*[F.max(F.when(F.col(model_col) == m, r)) for m in sorted(models)])).alias("rewards"))
    elif with_list:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct(model_col, reward_col))),
                                lambda s: s[reward_col]).alias("rewards"))
    out = scores.groupBy(*item_cols).agg(*aggs)
    return out.withColumn("is_high_uncertainty", F.col("std_reward") > F.lit(float(threshold)))


def disagreement(pred: DataFrame, group_cols=()) -> DataFrame:
    """ENS-2: mean / max / population std of per-item std, OOD fraction and count."""
    u = F.col("std_reward")
    flag = F.when(F.col("is_high_uncertainty"), 1).otherwise(0)
    return pred.groupBy(*group_cols).agg(
        F.avg(u).alias("mean_disagreement"), F.max(u).alias("max_disagreement"),
        F.stddev_pop(u).alias("std_disagreement"),
        (F.sum(flag) / F.count(F.lit(1))).alias("ood_fraction"),
        F.sum(flag).cast("bigint").alias("ood_count"))


def detect_ood(pred: DataFrame) -> DataFrame:
    """ENS-3: items whose ensemble std exceeds the threshold."""
    return pred.filter(F.col("is_high_uncertainty"))


def calibrate_threshold(pred: DataFrame, item_col: str, target_ood_rate: float = 0.1):
    """ENS-4: the std at 0-based sorted position int(n * (1 - rate)).

    The place is found by counting passes; nothing is sorted, and ``item_col`` is not
    read, as equal values need no order.  Rate 0 clamps to the last element."""
    n = pred.count()
    if n == 0:
        raise ValueError("cannot calibrate a threshold on an empty table")
    k = min(int(n * (1 - target_ood_rate)), n - 1)
    spark = pred.sparkSession
    place = spark.createDataFrame([(0, k)], "_all int, place long")
    found = order_statistics(pred.select(F.lit(0).alias("_all"), "std_reward"), ["_all"], "std_reward", place)
    return found.select(F.lit(n).cast("bigint").alias("n"), F.col("place").alias("position"),
                        F.col("value").alias("threshold"))
