"""Exact order statistics by narrowing histograms, without sorting the table.

A place (0-based position in the order of a group's values) lies in a range of values,
at first from the least to the greatest.  A counting pass cuts every range that is
still wanted into cells, and the running counts of at most ``cells`` cells tell in which
of them each place lies; the least and greatest value of that cell are the next range.
When a range holds one value, or at most ``small`` rows, its places are read off.  Two
or three passes do for values that are spread out.  If most rows of a range fell into
one cell, the next pass cuts it by sign, and by exponents where it spans many; each
pass takes at least the least and the greatest value away, so it ends for any values.

Rows are counted per (range, cell) with partial aggregation, so a group that holds all
rows costs a task no more than its cells.  Up to ``FEW_PLACES`` places are followed on
the driver, which gets the counts of a pass (at most ``cells`` for each place); more
places, as of very many groups, are followed in a table.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from prefsight.session import ensure_checkpoint_dir

CELLS = 4096
SMALL = 512
#: Places followed on the driver.
FEW_PLACES = 256
#: Ranges that are broadcast to the rows; beyond, the join shuffles.
MAX_BROADCAST_RANGES = 50_000


def order_statistics(df: DataFrame, group_cols, value_col: str, places: DataFrame, place_col: str = "place",
                     cells: int = CELLS, small: int = SMALL) -> DataFrame:
    """(group columns, place, value) for every row of ``places`` (group columns, place).

    Values are ordered as Spark orders them: null first, NaN last.  A place beyond the
    group, or of a group without rows, is not in the result; rows of a null group are
    not looked at.  Places may repeat; each distinct one is returned once."""
    if cells < 8 or small < 1:
        raise ValueError("at least eight cells and one row")
    ensure_checkpoint_dir(df.sparkSession)
    keys = list(group_cols)
    v = F.col("_v")
    rows = df.select(*keys, F.col(value_col).cast("double").alias("_v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        asked = places.select(*keys, F.col(place_col).cast("long").alias("_place")).distinct()
        few = asked.limit(FEW_PLACES + 1).collect()
        if len(few) > FEW_PLACES:
            return _select(rows, keys, v, asked, place_col, cells, small)
        found = _select_few(rows, keys, few, cells, small)
        schema = StructType([*(asked.schema[k] for k in keys), StructField(place_col, LongType()), StructField("value", DoubleType())])
        return df.sparkSession.createDataFrame(found, schema)
    finally:
        rows.unpersist()


def _edges(rows: DataFrame, keys) -> DataFrame:
    """Per group: nulls, -inf, finite values, inf, NaN, and the least and greatest finite value."""
    v, inf = F.col("_v"), F.lit(float("inf"))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)

    def count(condition):
        return F.sum(F.when(condition, 1).otherwise(0))
    return rows.groupBy(*keys).agg(
        count(v.isNull()).alias("_null"), count(v == -inf).alias("_low"), count(finite).alias("_n"),
        count(v == inf).alias("_high"), count(F.isnan(v)).alias("_nan"),
        F.min(F.when(finite, v)).alias("_lo"), F.max(F.when(finite, v)).alias("_hi"))


def _cell(cells: int):
    """Cell of a value in its range [_lo, _hi]; each scale is monotone in the value."""
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    linear = (v * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5)  # halves keep the width finite
    above = (F.log(v) - F.log(lo)) / (F.log(hi) - F.log(lo))
    under = (F.log(-lo) - F.log(-v)) / (F.log(-lo) - F.log(-hi))
    share = (F.when(~F.col("_hard"), linear)
             .when((lo < 0) & (hi > 0), F.when(v < 0, 0.0).when(v == 0, 0.5).otherwise(0.99))
             .when((lo > 0) & (hi * 2.0 ** -10 > lo), above).when((hi < 0) & (lo * 2.0 ** -10 < hi), under)
             .otherwise(linear))
    place = F.floor(F.coalesce(F.when(F.isnan(share), 0.0).otherwise(share), F.lit(0.0)) * (cells - 2))
    return F.when(v == lo, 0).when(v == hi, cells - 1).otherwise(1 + F.least(place, F.lit(cells - 3)))


def _select_few(rows: DataFrame, keys, asked, cells: int, small: int) -> list[tuple]:
    """(group, place, value) of at most ``FEW_PLACES`` places; one job a pass."""
    spark = rows.sparkSession
    n = len(keys)
    if not asked:
        return []
    groups = sorted({tuple(r[:n]) for r in asked}, key=repr)
    extent = {tuple(r[:n]): r for r in _edges(rows, keys).join(F.broadcast(
        spark.createDataFrame(groups, rows.select(*keys).schema)), keys).collect()}
    found: list[tuple] = []
    open_: dict[tuple, list[tuple[int, int]]] = {}  # (group, lo, hi, hard, rows in the range): (place, rows before it)
    for r in asked:
        group, place = tuple(r[:n]), r["_place"]
        e = extent.get(group)
        if e is None:
            continue
        below = e["_null"] + e["_low"]
        end = below + e["_n"]
        if 0 <= place < end + e["_high"] + e["_nan"]:
            if below <= place < end and e["_lo"] < e["_hi"]:
                open_.setdefault((group, e["_lo"], e["_hi"], False, e["_n"]), []).append((place, below))
            else:
                found.append((*group, place, None if place < e["_null"] else -math.inf if place < below
                              else e["_lo"] if place < end else math.inf if place < end + e["_high"] else math.nan))

    def inside(ranges) -> DataFrame:
        schema = StructType([*rows.select(*keys).schema.fields, StructField("_lo", DoubleType()), StructField("_hi", DoubleType()),
                             StructField("_hard", BooleanType()), StructField("_range", IntegerType())])
        table = spark.createDataFrame([(*g, lo, hi, hard, i) for i, (g, lo, hi, hard, _) in enumerate(ranges)], schema)
        return rows.join(F.broadcast(table), keys).where("_v >= _lo and _v <= _hi")

    while wide := [r for r in open_ if r[4] > small]:
        counted: dict[int, list] = {}
        for r in (inside(wide).groupBy("_range", _cell(cells).alias("_cell"))
                  .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()):
            counted.setdefault(r["_range"], []).append((r["_cell"], r["c"], r["lo"], r["hi"]))
        for i, key in enumerate(wide):
            group, _, _, _, total = key
            wanted = sorted(open_.pop(key))
            before = 0
            for _, c, lo, hi in sorted(counted[i]):
                for place, below in wanted:
                    if before <= place - below < before + c:
                        if lo == hi:
                            found.append((*group, place, lo))
                        else:
                            open_.setdefault((group, lo, hi, 4 * c > total, c), []).append((place, below + before))
                before += c
    if open_:
        ranges = list(open_)
        lists = {r["_range"]: r["l"] for r in inside(ranges).groupBy("_range").agg(
            F.sort_array(F.collect_list("_v")).alias("l")).collect()}  # at most ``small`` rows each
        found += [(*r[0], place, lists[i][place - below]) for i, r in enumerate(ranges) for place, below in open_[r]]
    return found


def _small_plan(state: DataFrame) -> DataFrame:
    """The rows without the plan that made them, so that passes do not add up."""
    kept = state.checkpoint()
    if kept.count() > MAX_BROADCAST_RANGES:
        return kept
    return state.sparkSession.createDataFrame(kept.collect(), kept.schema)


def _select(rows, keys, v, places, place_col, cells, small) -> DataFrame:
    inf = F.lit(float("inf"))
    edges = _edges(rows, keys)
    below = F.col("_null") + F.col("_low")
    place = F.col("_place")
    end = below + F.col("_n")
    known = (F.when(place < F.col("_null"), F.lit(None).cast("double")).when(place < below, -inf)
             .when(place < end, F.col("_lo")).when(place < end + F.col("_high"), inf).otherwise(F.lit(float("nan"))))
    state = (places.join(edges, keys)
             .where((place >= 0) & (place < end + F.col("_high") + F.col("_nan")))
             .select(*keys, "_place", known.alias("_value"), ((place >= below) & (place < end)).alias("_in"), "_lo", "_hi",
                     below.alias("_below"), F.col("_n")).checkpoint())

    def inside(ranges: DataFrame) -> DataFrame:
        """Rows with the ranges of their group that they lie in."""
        few = ranges.count() <= MAX_BROADCAST_RANGES
        return rows.join(F.broadcast(ranges) if few else ranges, keys).where((v >= F.col("_lo")) & (v <= F.col("_hi")))

    span = [*keys, "_lo", "_hi", "_hard"]
    state = state.withColumn("_hard", F.lit(False))
    done = state.where("not _in or _lo = _hi").select(*keys, "_place", "_value")
    open_ = state.where("_in and _lo < _hi").select(*keys, "_place", "_lo", "_hi", "_below", "_n", "_hard")
    while True:
        wide = open_.where(F.col("_n") > small)
        ranges = wide.select(*span).distinct().checkpoint()
        if ranges.isEmpty():
            break
        counted = (inside(ranges).groupBy(*span, _cell(cells).alias("_cell"))
                   .agg(F.count(F.lit(1)).alias("_c"), F.min(v).alias("_least"), F.max(v).alias("_most")))
        running = Window.partitionBy(*span).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # <= cells rows
        counted = counted.withColumn("_before", F.coalesce(F.sum("_c").over(running), F.lit(0)))
        offset = place - F.col("_below")
        nearer = (wide.join(counted, span).where((offset >= F.col("_before")) & (offset < F.col("_before") + F.col("_c")))
                  .select(*keys, "_place", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"),
                          (F.col("_below") + F.col("_before")).alias("_below"), F.col("_c").alias("_n"),
                          (F.col("_c") * 4 > F.col("_n")).alias("_hard")))
        nearer = _small_plan(nearer)
        done = done.union(nearer.where("_lo = _hi").select(*keys, "_place", F.col("_lo").alias("_value")))
        open_ = _small_plan(open_.where(F.col("_n") <= small).unionByName(nearer.where("_lo < _hi")))
    # At most ``small`` rows a range.
    left = open_.select(*span).distinct().checkpoint()
    if not left.isEmpty():
        lists = inside(left).groupBy(*span).agg(F.sort_array(F.collect_list(v)).alias("_list"))
        done = done.union(open_.join(lists, span).select(
            *keys, "_place", F.element_at("_list", (place - F.col("_below") + 1).cast("int")).alias("_value")))
    return done.select(*keys, place.alias(place_col), F.col("_value").alias("value")).checkpoint()
