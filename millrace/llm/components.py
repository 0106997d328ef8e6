"""Connected components of a large edge table by alternating star contraction.

Each round hangs the larger neighbours of a node, then its smaller ones, on the smallest label around; the number of
rounds grows with the logarithm of the longest path. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.frames import written


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) for every node of the edges ``a``, ``b`` (both long).

    Direction, repeated edges, loops and edges with a null end do not matter; a node with only loops is its own
    component and, like nodes without edges, is not returned.
    """
    stars = written(_downward(edges.select("a", "b")), "edges")
    state = None
    while True:
        found = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(_downward(large), "edges")
        least = written(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        stars = written(_downward(small.unionByName(least.select("a", F.col("least").alias("b")))), "edges")
    roots = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionByName(roots.select("node", F.col("node").alias("component")))


def _downward(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
