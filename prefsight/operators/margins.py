"""Margin analysis and curriculum sampling (MRG-*).

Percentiles are exact (numpy's linear interpolation) but never hold a group's
values in one buffer and sort nothing: the two order statistics around each quantile
come from counting passes (``selection.order_statistics``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefsight.functions import hash_key
from prefsight.operators.indexing import index_within_group
from prefsight.operators.selection import FEW_PLACES, order_statistics

# Difficulty thresholds and curriculum weights of the reference.
EASY_THRESHOLD = 0.7
HARD_THRESHOLD = 0.2
DEFAULT_WEIGHTS = {"easy": 0.2, "medium": 0.6, "hard": 0.2}
PHASE_WEIGHTS = [  # progress < 0.3, < 0.7, otherwise
    {"easy": 0.5, "medium": 0.4, "hard": 0.1},
    {"easy": 0.2, "medium": 0.6, "hard": 0.2},
    {"easy": 0.1, "medium": 0.5, "hard": 0.4},
]
BUCKETS = ("easy", "medium", "hard")


def difficulty(m: Column, easy=EASY_THRESHOLD, hard=HARD_THRESHOLD) -> Column:
    """'easy' (> easy), 'hard' (< hard), 'medium' (between, both edges included);
    NaN is in no bucket (Spark orders NaN above every number, so test it first)."""
    return (F.when(F.isnan(m) | m.isNull(), F.lit(None).cast("string"))
            .when(m > F.lit(float(easy)), F.lit("easy"))
            .when(m < F.lit(float(hard)), F.lit("hard"))
            .otherwise(F.lit("medium")))


def exact_quantiles(df: DataFrame, group_cols, value_col: str, key_col: str | None = None,
                    qs=(0.25, 0.5, 0.75), names=None) -> DataFrame:
    """numpy.percentile (linear) per group: the two order statistics around each quantile.

    Equal values need no order among them, so ``key_col`` is not read."""
    group_cols = list(group_cols)
    names = names or [f"p{int(round(q * 100))}" for q in qs]
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    few = sizes.limit(FEW_PLACES + 1).collect()
    if len(few) <= FEW_PLACES:
        sizes = df.sparkSession.createDataFrame(few, sizes.schema)
    # per group and quantile: lower index floor(q*(n-1)) and fraction
    at = [F.lit(float(q)) * (F.col("_n") - 1) for q in qs]
    targets = sizes.select(*group_cols, F.col("_n"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("_qi"), F.floor(x).cast("bigint").alias("_lo"), (x - F.floor(x)).alias("_frac"))
        for i, x in enumerate(at)])))
    places = targets.select(*group_cols, F.explode(F.array("_lo", F.col("_lo") + 1)).alias("place"))
    found = order_statistics(df, group_cols, value_col, places)
    low = found.select(*group_cols, F.col("place").alias("_lo"), F.col("value").alias("_vlo"))
    high = found.select(*group_cols, (F.col("place") - 1).alias("_lo"), F.col("value").alias("_vhi"))
    picked = targets.join(low, [*group_cols, "_lo"]).join(high, [*group_cols, "_lo"], "left")
    val = F.when(F.col("_vhi").isNull(), F.col("_vlo")).otherwise(
        F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
    return picked.groupBy(*group_cols).agg(*[
        F.max(F.when(F.col("_qi") == i, val)).alias(nm) for i, nm in enumerate(names)])


def margin_statistics(df: DataFrame, group_cols=(), margin_col: str = "margin",
                      key_col: str = "pair_id", easy=EASY_THRESHOLD,
                      hard=HARD_THRESHOLD) -> DataFrame:
    """mean, population std, min, max, p25/p50/p75, easy/medium/hard fractions.

    medium = n - easy - hard, so NaN counts as medium, as in the reference."""
    group_cols = list(group_cols)
    m = F.col(margin_col)
    basic = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"),
        F.min(m).alias("min"), F.max(m).alias("max"),
        F.sum(F.when(m > F.lit(float(easy)), 1).otherwise(0)).alias("_easy"),
        F.sum(F.when(m < F.lit(float(hard)), 1).otherwise(0)).alias("_hard"))
    if not group_cols:  # one-row sides joined on a constant key, not a cross join
        df = df.withColumn("_all", F.lit(0))
        basic = basic.withColumn("_all", F.lit(0))
    keys = group_cols or ["_all"]
    q = exact_quantiles(df, keys, margin_col, key_col)
    out = basic.join(q, keys)
    n = F.col("n").cast("double")
    return out.select(*group_cols, "n", "mean", "std", "min", "max", "p25", "p50", "p75",
                      (F.col("_easy") / n).alias("easy_fraction"),
                      ((F.col("n") - F.col("_easy") - F.col("_hard")) / n).alias("medium_fraction"),
                      (F.col("_hard") / n).alias("hard_fraction"))


def with_difficulty(df: DataFrame, margin_col="margin", easy=EASY_THRESHOLD,
                    hard=HARD_THRESHOLD) -> DataFrame:
    return df.withColumn("difficulty", difficulty(F.col(margin_col), easy, hard))


def find_mislabeled(df: DataFrame, margin_col="margin", threshold: float = -0.5) -> DataFrame:
    """Pairs whose margin is strictly below ``threshold``; callers order by
    (margin, key) -- most negative first -- when they need the ranking."""
    return df.filter(F.col(margin_col) < F.lit(float(threshold)))


def phase_weights(progress: Column) -> Column:
    """Struct (easy, medium, hard) of curriculum weights for training progress."""
    def s(w):
        return F.struct(*[F.lit(w[b]).alias(b) for b in BUCKETS])
    return (F.when(progress < 0.3, s(PHASE_WEIGHTS[0]))
            .when(progress < 0.7, s(PHASE_WEIGHTS[1]))
            .otherwise(s(PHASE_WEIGHTS[2])))


def curriculum_schedule(epochs: DataFrame, epoch_col="epoch", total_col="total_epochs"):
    """Weights per epoch row; progress = epoch / total (epoch 0 included)."""
    progress = F.col(epoch_col).cast("double") / F.col(total_col)
    return epochs.withColumn("progress", progress) \
        .withColumn("w", phase_weights(F.col("progress"))) \
        .select("*", F.col("w.easy").alias("easy_weight"), F.col("w.medium").alias("medium_weight"),
                F.col("w.hard").alias("hard_weight")).drop("w")


def curriculum_sample(df: DataFrame, n: int, key_col="pair_id", margin_col="margin",
                      weights: dict | None = None, seed: int = 42,
                      easy=EASY_THRESHOLD, hard=HARD_THRESHOLD) -> DataFrame:
    """Draw ``int(n * w_b)`` rows with replacement from each non-empty bucket.

    Draw j of bucket b picks in-bucket position pmod(hash(seed, b, j), size_b).
    The draws table has int(n * w) rows per bucket (the requested sample size),
    the pool is joined on (bucket, position): no collect, no per-bucket task.
    Result order is a keyed shuffle; total may be < n because of truncation.
    """
    weights = weights or DEFAULT_WEIGHTS
    spark = df.sparkSession
    d = df.select(key_col, margin_col).withColumn("bucket", difficulty(F.col(margin_col), easy, hard)) \
        .filter(F.col("bucket").isNotNull())
    pos = index_within_group(d, ["bucket"], [margin_col, key_col], "bpos")
    sizes = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("bsize"))
    per_bucket = [(b, int(n * weights[b])) for b in BUCKETS if int(n * weights[b]) > 0]
    draws = None
    for b, k in per_bucket:
        part = spark.range(k).select(F.lit(b).alias("bucket"), F.col("id").alias("draw"))
        draws = part if draws is None else draws.unionByName(part)
    if draws is None:
        return pos.limit(0).select(F.lit(0).alias("draw_order"), key_col, margin_col, "bucket")
    draws = draws.join(sizes, "bucket")  # empty buckets have no size row -> skipped
    draws = draws.withColumn("bpos", F.pmod(hash_key(seed, "bucket", "draw"), F.col("bsize")))
    picked = draws.join(pos.select("bucket", "bpos", key_col, margin_col), ["bucket", "bpos"])
    return picked.select(hash_key(seed + 1, "bucket", "draw").alias("draw_order"),
                         "bucket", "draw", key_col, margin_col)


def sampling_weights(df: DataFrame, key_col="pair_id", margin_col="margin",
                     weights: dict | None = None, easy=EASY_THRESHOLD,
                     hard=HARD_THRESHOLD) -> DataFrame:
    """Per-row weight w_b / n_b normalised over rows of non-empty buckets.

    Bucket counts are a 3-row aggregate; Spark broadcasts it back."""
    weights = weights or DEFAULT_WEIGHTS
    d = df.select(key_col, margin_col).withColumn("bucket", difficulty(F.col(margin_col), easy, hard))
    counts = d.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("bsize"))
    wmap = F.create_map(*[x for b in BUCKETS for x in (F.lit(b), F.lit(float(weights[b])))])
    counts = counts.withColumn("bw", F.element_at(wmap, F.col("bucket")))
    # at most three bucket rows: a whole-frame window over them is bounded
    cw = counts.withColumn("total_w", F.sum("bw").over(Window.partitionBy()))
    cw = cw.withColumn("row_w", F.when(F.col("total_w") > 0,
                                       F.col("bw") / F.col("bsize") / F.col("total_w")))
    out = d.join(F.broadcast(cw.select("bucket", "row_w")), "bucket", "left")
    return out.select(key_col, margin_col, "bucket",
                      F.coalesce(F.col("row_w"), F.lit(0.0)).alias("weight"))
