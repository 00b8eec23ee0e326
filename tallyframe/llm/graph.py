"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import cut


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) for every endpoint of ``edges`` (columns a, b): the smallest id reachable.

    Alternates large-star and small-star rounds: each vertex hands the smallest
    neighbour to its larger, then to its smaller neighbours, until the edges form
    stars. The number of rounds is about the logarithm of the longest path; minima
    are pre-aggregated, so a vertex with many edges costs one row per task. Each
    round is written to the shared folder. Self-loops and nulls are ignored.
    """
    e = edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct()
    e = cut(e)
    for _ in range(max_rounds):
        before = e
        both = e.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(e.select(F.col("high").alias("u"), F.col("low").alias("v")))
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.join(least.withColumnRenamed("u", "low"), "low").select(F.col("m").alias("low"), "high").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = large.join(least, "high")
        small = joined.select(F.col("m").alias("low"), F.col("low").alias("high")).where("low < high").unionByName(least.select(F.col("m").alias("low"), "high"))
        e = cut(small.distinct())
        changed = e.join(before, ["low", "high"], "left_anti").limit(1).count() or before.join(e, ["low", "high"], "left_anti").limit(1).count()
        if not changed:
            break
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return e.select(F.col("high").alias("id"), F.col("low").alias("component")).unionByName(e.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct())
