"""Connected components by alternating star rewrites, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmatch.llm.skew import spread_join
from planmatch.llm.storage import cut_for_joins as cut


#: Edges of a node from which it is dealt over several tasks.
HUB = 1 << 14


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node of ``edges`` (a, b); self-loops and repeats do no harm.

    Each round hangs the larger neighbours of a node below its smallest neighbour, then the smaller ones; stars remain, and the
    rounds end when nothing changes. A hub's minimum is pre-aggregated before the shuffle, and its edges are dealt over salts in both joins, as Spark doesn't split
    joins with an aggregate.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = spread_join(both, least, "u", rows=2 * state["n"], least=HUB).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", rows=2 * state["n"], least=HUB).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return own.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
