"""Connected components of a graph given as a table of edges, by alternating star contractions.

Every round links each node's larger neighbours to the smallest node around it, then each node's smaller neighbours likewise, until
nothing changes; the number of rounds grows with the logarithm of the component size.  Edges live in written tables between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the smallest of them (edges have a < b)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge to another: the smallest node of its component."""
    now = settle(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    mark = None
    while True:
        now = settle(_small_star(_large_star(now)), "edges")
        # a forest of stars is a fixed point: its edges keep their number and sums
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("a") > F.col("b"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
