"""Row positions without a single-task window.

An unpartitioned ``row_number()`` moves every row into one task; a window
partitioned by a hot key moves a third of the table into one task.  Instead we
range-partition on the full (unique) order key, number rows inside each
partition with ``monotonically_increasing_id`` and add per-partition offsets
computed from at most ``num_partitions`` counts.  The ordered table is
checkpointed (reliably, into ``spark.checkpoint.dir``) so the counts and the
numbering see the same partitioning, and so the job survives losing executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefsight.session import ensure_checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id = (partition << 33) + row-in-partition


def _as_sort_col(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c).asc_nulls_first()


def global_index(df: DataFrame, order_cols, idx_col: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Append a 0-based position ``idx_col`` following ``order_cols``.

    ``order_cols`` must be a total order (append a unique key); otherwise ties
    are numbered in an unspecified but fixed order.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sort_cols = [_as_sort_col(c) for c in order_cols]
    # Without an explicit count the range shuffle has spark.sql.shuffle.partitions
    # partitions and AQE may coalesce neighbouring ones by data size (order is
    # kept); the checkpoint freezes whatever partitioning ran.
    ranged = (df.repartitionByRange(num_partitions, *sort_cols) if num_partitions
              else df.repartitionByRange(*sort_cols))
    ordered = (ranged
               .sortWithinPartitions(*sort_cols)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    # One row per partition: the prefix sum runs over <= n rows.
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    prefix = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(prefix), F.lit(0)).alias("_off"))
    low = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), _ROW_BITS)
    return (ordered.join(F.broadcast(offsets), "_pid")
            .withColumn(idx_col, (F.col("_off") + low).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def index_within_group(df: DataFrame, group_cols, order_cols, idx_col: str = "idx",
                       num_partitions: int | None = None) -> DataFrame:
    """0-based position inside each group, skew-safe.

    A hot group is spread over several range partitions; its start position is
    a partial-aggregated ``min`` that AQE joins back (broadcast when small).
    """
    group_cols = list(group_cols)
    g = global_index(df, [*group_cols, *order_cols], "_gidx", num_partitions)
    starts = g.groupBy(*group_cols).agg(F.min("_gidx").alias("_start"))
    renamed = starts.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], "_start")
    cond = None
    for c in group_cols:
        e = g[c].eqNullSafe(renamed[f"_g_{c}"])
        cond = e if cond is None else cond & e
    out = g.join(renamed, cond, "inner")
    return (out.withColumn(idx_col, (F.col("_gidx") - F.col("_start")).cast("bigint"))
            .drop("_gidx", "_start", *[f"_g_{c}" for c in group_cols]))


def prefix_sums(df: DataFrame, group_cols, order_cols, value_col: str, out_col: str) -> DataFrame:
    """Sum of ``value_col`` over the rows before each row of its group, skew-safe.

    Rows are range-partitioned by (group, order); a window inside each (partition,
    group) gives local sums, and one total per (partition, group) the offsets.  A
    group that spans many partitions is never gathered."""
    group_cols = list(group_cols)
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (df.repartitionByRange(*[_as_sort_col(c) for c in [*group_cols, *order_cols]])
               .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    local = Window.partitionBy("_pid", *group_cols).orderBy(*[_as_sort_col(c) for c in order_cols]).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = ordered.groupBy("_pid", *group_cols).agg(F.sum(value_col).alias("_t"))
    # one row per partition and group that meets it
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    rows = ordered.withColumn("_in", F.coalesce(F.sum(value_col).over(local), F.lit(0)))
    return (rows.join(offsets, ["_pid", *group_cols])
            .withColumn(out_col, F.col("_off") + F.col("_in")).drop("_pid", "_off", "_in"))
