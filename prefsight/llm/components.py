"""Distributed connected components: alternating large-star and small-star.

Both steps are a partial-aggregated minimum per vertex joined back to the
edges, so a vertex with very many neighbours is never gathered in one task
(adaptive skew joins split its rows).  Each round is written by ``checkpoint()``
into the shared folder, and its shuffle files are removed then; only two numbers per
round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefsight.session import checkpointed, ensure_checkpoint_dir, shuffles_removed


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """For (u, v) neighbour pairs, with m the least of u and u's neighbours."""
    least = (pairs.groupBy("u").agg(F.min("v").alias("m"))
             .select("u", F.least("u", "m").alias("m")))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         max_rounds: int = 60) -> DataFrame:
    """Component of every vertex that has an edge: columns (node, component).

    ``edges`` are undirected; ``component`` is the least vertex of the component.
    Self loops, repeated edges and edges with a null end are ignored, so a vertex
    with no other edge is not in the result.  No edges give an empty result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = checkpointed(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
                     .where("a is not null and b is not null and a <> b")
                     .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _toward_minimum(large.distinct())
        e = checkpointed(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                         .union(small.select("u", F.col("m").alias("v"))).distinct())
        with shuffles_removed(e.sparkSession):
            now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(e.select("v", "v")).distinct())
