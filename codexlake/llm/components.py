"""Connected components of an edge list by alternating large-star and small-star steps.

Each step is a grouped minimum and a join back; the minima are written, so that adaptive execution can split a node
with many neighbours. Every round is
written to the shared folder, which cuts the lineage; rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b). Large: each node ties its greater neighbours to the least of its neighbours and itself; small: the smaller ones and itself."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written, so that both sides of the join are exchanged for it and a hub's partition can be split
    least = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "least")
    tied = both.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the least node of the component."""
    edges = written(edges.where("a != b").distinct(), "edges")
    sign = None
    while True:
        edges = written(_star(_star(edges, True), False), "edges")
        got = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if got == sign or not got[0]:
            break
        sign = got
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
