"""Connected components of a table of links, by turns of two joins (small star, large star).

Each turn hangs every node on the smallest node it knows of; links that say nothing new vanish. The number
of turns grows with the logarithm of the longest path. Nothing is gathered per node: the smallest
neighbour is a minimum with a map-side combine, and the joins split hot nodes where Spark finds them skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest node reachable."""
    big, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(links.where("a != b").select(big, small).distinct())
    while True:
        # Large star: neighbours above a node go to its smallest neighbour, or itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = stored(large)
        # Small star: neighbours below a node go to the smallest of them, as does the node.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a != b")
            .distinct()
        )
        after = stored(small_star)
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
