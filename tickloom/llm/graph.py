"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of edges(a long, b long) with the smallest node it can reach.

    Returns (node, component) for the nodes that have an edge.  Only minima are aggregated, so a hub
    with very many neighbours is combined before the shuffle; joins on a hub are ordinary sort-merge
    joins, which adaptive execution splits.  Each round is a table in the shared folder.  Self loops
    and repeated edges do no harm; an empty table gives an empty table.
    """
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(edges.select(hi, lo).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if (state.n, state.h) == before:
            break
        before = (state.n, state.h)
        if not state.n:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return labels.unionByName(roots)
